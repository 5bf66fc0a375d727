"""A dataset of ``<split>/images/*`` and ``<split>/annotations.jsonl`` as a data source named ``quads``.

    register(spark)
    spark.read.format("quads").load(root).where("split = 'train'")
    rows.write.format("quads").mode("append").option("path", root).save()

A row is an annotation with its split and the bytes of its image.  One pass
reads both: a partition holds a range of bytes of an annotation file, and its
tasks open the images that these lines name, so nothing is shuffled or joined,
and images are read where a filter on split leaves their split.  Filters on
``split`` (equality or a list) choose the folders that are listed.

A writer's task puts its images and one file of annotations into a folder of
its own attempt, ``_attempts/<job>/<attempt>``; the commit, on the driver, moves the
images and then the annotation file of each task that Spark took into place.  Files of attempts that failed or were doubled are deleted then, or
on abort, so a reader never sees them.
"""

from __future__ import annotations

import io
import json
import os
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from ..schema import ANNOTATION, SPLITS

SCHEMA = f"split STRING, {ANNOTATION}, content BINARY, reject STRING"
#: Bytes of annotations in a partition.
SLICE = 4_000_000
ATTEMPTS = "_attempts"
#: Files that a commit moves at once.
MOVERS = 32
#: Rows of a batch, and bytes of images at which it is closed before.
BATCH_ROWS, BATCH_BYTES = 1024, 64_000_000


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI; ``s3a`` and ``s3n`` are what Arrow calls ``s3``."""
    for alias in ("s3a://", "s3n://"):
        if path.startswith(alias):
            path = "s3://" + path.removeprefix(alias)
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def inside(root: str, name: str) -> str:
    """The path of ``name`` below ``root``; names that leave it are an error."""
    found = posixpath.normpath(posixpath.join(root, name))
    if not found.startswith(posixpath.normpath(root) + "/"):
        raise ValueError(f"{name} leaves the folder")
    return found


@dataclass
class Lines(InputPartition):
    """Lines of an annotation file that begin in [start, end)."""

    split: str
    file: str
    start: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, root: str, slice_bytes: int):
        self.root, self.slice_bytes, self.splits = root, slice_bytes, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            wanted = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if wanted is None or f.attribute != ("split",):
                yield f
            else:
                self.splits = set(wanted) if self.splits is None else self.splits & set(wanted)

    def partitions(self) -> list[Lines]:
        store, root = store_of(self.root)
        folders = [i.base_name for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.type == fs.FileType.Directory and not i.base_name.startswith(("_", "."))]
        out = []
        for split in sorted(folders):
            if self.splits is None or split in self.splits:
                files = store.get_file_info(fs.FileSelector(f"{root}/{split}"))
                for i in sorted((i for i in files if i.is_file and i.base_name.startswith("annotations") and i.extension == "jsonl"), key=lambda i: i.path):
                    out += [Lines(split, i.path, at, min(at + self.slice_bytes, i.size)) for at in range(0, i.size, self.slice_bytes)]
        return out

    def read(self, partition: Lines | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what a scan without partitions asks for
            return
        store, root = store_of(self.root)
        schema, rows, held = arrow_schema(), [], 0
        for line in lines(store, partition):
            row = record(line) | {"split": partition.split}
            if row["image"] is not None:
                row |= image_of(store, f"{root}/{partition.split}", row)
            rows.append(row)
            held += len(row.get("content") or b"")
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def arrow_schema() -> pa.Schema:
    text = pa.string()
    corners = pa.list_(pa.list_(pa.float64()))
    return pa.schema([("split", text), ("image", text), ("width", pa.int32()), ("height", pa.int32()), ("label", text), ("corners", corners), ("corner_order", pa.list_(text)), ("content", pa.binary()), ("reject", text)])


def lines(store: fs.FileSystem, part: Lines) -> Iterator[bytes]:
    """A line belongs to the partition in which its first byte lies."""
    with io.BufferedReader(store.open_input_file(part.file), 1 << 20) as file:
        at = part.start
        if at:  # the line that runs into this range is another partition's
            file.seek(at - 1)
            at += len(file.readline()) - 1
        file.seek(at)
        while at < part.end and (line := file.readline()):
            at += len(line)
            if line.strip():
                yield line


def record(line: bytes) -> dict:
    """The fields of a line; one that is no record, or has fields of other kinds, is a reject."""
    empty = dict.fromkeys(arrow_schema().names)
    try:
        found = json.loads(line)
        corners = found.get("corners")
        row = {
            "image": found["image"],
            "width": found.get("width"),
            "height": found.get("height"),
            "label": found.get("label"),
            "corners": None if corners is None else [[float(v) for v in p] for p in corners],
            "corner_order": found.get("corner_order"),
        }
        pa.RecordBatch.from_pylist([empty | row], arrow_schema())
    except (ValueError, TypeError, KeyError, AttributeError, OverflowError, pa.ArrowException):
        return empty | {"reject": "not a record"}
    sound = row["corners"] is not None and len(row["corners"]) == 4 and all(len(p) == 2 and all(abs(v) < float("inf") for v in p) for p in row["corners"])
    return empty | row | {"reject": None if sound else "not four finite points"}


def image_of(store: fs.FileSystem, folder: str, row: dict) -> dict:
    try:
        with store.open_input_file(inside(folder, row["image"])) as file:
            return {"content": file.read()}
    except ValueError:
        return {"reject": "image outside the split"}
    except FileNotFoundError:
        return {"reject": row["reject"] or "no image"}


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    splits: list[str]


class Writer(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.job = root, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        store, root = store_of(self.root)
        attempt = uuid.uuid4().hex
        folder = f"{root}/{ATTEMPTS}/{self.job}/{attempt}"
        files: dict[str, fs.NativeFile] = {}
        made: set[str] = set()
        try:
            for row in rows:
                if row["split"] not in SPLITS:
                    raise ValueError(f"{row['split']} is no split")
                base = f"{folder}/{row['split']}"
                if row["split"] not in files:
                    store.create_dir(base, recursive=True)
                    files[row["split"]] = store.open_output_stream(f"{base}/annotations.jsonl")
                kept = {c: v for c, v in row.asDict(recursive=True).items() if c not in ("split", "content", "reject") and v is not None}
                if row["content"] is not None:
                    target = inside(base, row["image"])
                    if (parent := posixpath.dirname(target)) not in made:
                        store.create_dir(parent, recursive=True)
                        made.add(parent)
                    with store.open_output_stream(target) as out:
                        out.write(bytes(row["content"]))
                files[row["split"]].write(json.dumps(kept, ensure_ascii=False).encode() + b"\n")
        finally:
            for file in files.values():
                file.close()
        return Written(attempt, sorted(files))

    def commit(self, messages: list[Written | None]) -> None:
        """Images of the tasks that Spark took are moved first, then their annotations, which make them visible."""
        store, root = store_of(self.root)
        taken = [m for m in messages if m]
        if self.overwrite:
            for split in SPLITS:
                if store.get_file_info(f"{root}/{split}").type == fs.FileType.Directory:
                    store.delete_dir(f"{root}/{split}")
        for m in taken:
            for split in m.splits:
                base = f"{root}/{ATTEMPTS}/{self.job}/{m.attempt}/{split}"
                found = [i.path for i in store.get_file_info(fs.FileSelector(base, recursive=True)) if i.is_file and i.path != f"{base}/annotations.jsonl"]
                folders = {posixpath.dirname(posixpath.join(root, split, posixpath.relpath(p, base))) for p in found}
                for f in folders | {f"{root}/{split}"}:
                    store.create_dir(f, recursive=True)
                with ThreadPoolExecutor(MOVERS) as pool:
                    list(pool.map(lambda p: store.move(p, posixpath.join(root, split, posixpath.relpath(p, base))), found))  # noqa: B023
                store.move(f"{base}/annotations.jsonl", f"{root}/{split}/annotations-{m.attempt}.jsonl")
        self._clean(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*store_of(self.root))

    def _clean(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{ATTEMPTS}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{ATTEMPTS}/{self.job}")


class QuadDataset(DataSource):
    """Options: ``path``, the dataset's folder; ``slice_bytes``, annotations of a partition."""

    @classmethod
    def name(cls) -> str:
        return "quads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("slice_bytes", SLICE)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(QuadDataset)
