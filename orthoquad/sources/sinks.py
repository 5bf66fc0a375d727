"""Sinks: JSON-lines annotations and image files."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dataset import FIELDS, stored
from .dataset_source import store_of


def write_annotations(df: DataFrame, path: str) -> None:
    """One JSON line per image, in part files under ``path``; whole coordinates are written without a fraction.

    A null field is left out of its line, so a record without corners is read
    back as a reject.
    """
    cast = lambda kind: F.transform("corners", lambda p: F.transform(p, lambda v: v.cast(kind)))
    record = lambda corners: F.to_json(F.struct(*(corners.alias(c) if c == "corners" else F.col(c) for c in FIELDS)))
    whole = F.forall(F.flatten("corners"), lambda v: v == F.floor(v))
    line = F.when(whole, record(cast("long"))).otherwise(record(cast("double")))
    stored(df).select(line.alias("value")).write.text(path)


def write_images(images: DataFrame, path: str, name: str = "image", content: str = "content") -> DataFrame:
    """Write each row's bytes to ``path``/<image>; returns names and sizes when evaluated.

    ``path`` is a file path or a URI that Arrow's file systems know, and all
    executors see it.  A file is written beside its place, under a name of its
    own, and then moved, so a task that runs twice does no harm; a failed one may
    leave such a file.  ``dataset_source`` writes with commit and abort.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = store_of(path)
        made: set[str] = set()
        for batch in batches:
            for n, data in zip(batch["_n"], batch["_c"], strict=True):
                target = posixpath.normpath(posixpath.join(root, n))
                if not target.startswith(posixpath.normpath(root) + "/"):
                    raise ValueError(f"{n} leaves the folder")
                folder = posixpath.dirname(target)
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                beside = f"{target}.part-{uuid.uuid4().hex}"
                with store.open_output_stream(beside) as out:
                    out.write(data)
                store.move(beside, target)
            yield pd.DataFrame({"image": batch["_n"], "bytes": [len(c) for c in batch["_c"]]})

    return images.select(F.col(name).alias("_n"), F.col(content).alias("_c")).mapInPandas(run, "image STRING, bytes BIGINT")
