"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


#: Deletions of what may be read in the shared folder until this driver ends.
_kept: list[Callable[[], None]] = []


def deletion(spark: SparkSession, pattern: str) -> Callable[[], None]:
    """What deletes all that matches a path pattern, in whatever store it lies, even when the session has ended."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def run() -> None:
        for found in store.globStatus(path) or []:
            store.delete(found.getPath(), True)

    return run


def keep_to_end(spark: SparkSession, path: str) -> str:
    """Have ``path`` deleted when this driver ends, as results are read from it until then."""
    if not _kept:
        atexit.register(_delete_kept)
    _kept.append(deletion(spark, path))
    return path


def _delete_kept() -> None:
    for run in _kept:
        with contextlib.suppress(Exception):  # the virtual machine may be gone
            run()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a master of one machine (``local`` or ``local[...]``) may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="orthoquad-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for its maker to delete."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
