"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..sources.shared import deletion, keep_to_end, shared_path

HELD_OUT_BUCKET = 2
FOLDS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str) -> Column:
    """True for keys of the evaluation fold; a null key is never learned from."""
    fold = F.crc32(F.col(key).cast("string")) % F.lit(FOLDS)
    return F.coalesce(fold == HELD_OUT_BUCKET, F.lit(True))


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, cutting its lineage; it goes when the driver ends."""
    spark = df.sparkSession
    path = keep_to_end(spark, shared_path(spark, name))
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that go when their work is done."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, shared_path(spark, name)
        self.made = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete the tables of a name, or all."""
        deletion(self.spark, f"{self.root}/*-{name}" if name else self.root)()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.drop()


def bounded_sample(rows: DataFrame, key: str, n: int) -> list:
    """About ``n`` distinct rows (at most ``n``) by a hash of ``key`` and the other columns, on the driver.

    The share of rows to fetch follows from their count, so that what tasks send
    is about ``n`` rows however many tasks there are; repeated rows, which share
    their hash, are made one before.
    """
    total = rows.count()
    if total > n:
        bits = 1 << 30
        share = min(bits, int(bits * (n + 4 * n**0.5) / total) + 1)
        rows = rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(bits)) < share)
    found = rows.distinct().withColumn("_hash", F.xxhash64(*rows.columns)).collect()
    return sorted(found, key=lambda r: (r["_hash"], *map(repr, r)))[:n]


def spread(text: Column, most: int, seam: Column, pieces: int = 32) -> Column:
    """A text or its bytes whole if no longer than ``most``, else pieces of that length together, evenly spaced over all of it."""
    size = most // pieces
    cut = [F.substring(text, (1 + F.floor((F.length(text) - size) * i / (pieces - 1))).cast("int"), F.lit(size)) for i in range(pieces)]
    joined = [x for c in cut for x in (seam, c)][1:]
    return F.when(F.length(text) <= most, text).otherwise(F.concat(*joined))


#: log2 of the words of the bit maps that thin out a join's larger side (16 M bits, under 16 MB as a table).
BITMAP_WORDS = 18


def _marked(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` with _hit: false where ``key`` is surely not in ``wanted``, by a bit map of fixed size."""
    hashed = F.xxhash64(key)
    word, bit = F.pmod(hashed, F.lit(1 << BITMAP_WORDS)), F.pmod(F.shiftright(hashed, BITMAP_WORDS), F.lit(64)).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bits = wanted.select(word.alias("_w"), mask.alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_bits"))
    joined = rows.withColumn("_w", word).join(F.broadcast(bits), "_w", "left")
    return joined.withColumn("_hit", F.coalesce(mask.bitwiseAND(F.col("_bits")) != 0, F.lit(False))).drop("_w", "_bits")


def thin_out(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Drop rows whose ``key`` is surely not in ``wanted``, without a shuffle of ``rows``."""
    return _marked(rows, key, wanted).where("_hit").drop("_hit")


def drop_ids(rows: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is not in ``dropped``; only rows that a bit map can't clear are shuffled."""
    dropped = materialize(dropped, "dropped")
    marked = _marked(rows, key, dropped)
    return marked.where("NOT _hit").drop("_hit").unionByName(marked.where("_hit").drop("_hit").join(dropped, key, "left_anti"))


def drop_repeats(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``rows`` with one of those that share ``key`` and ``text``; rows with a null key stay, and only repeated keys are shuffled."""
    twice = materialize(rows.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key), "repeated")
    marked = _marked(rows, key, twice)
    return marked.where("NOT _hit").drop("_hit").unionByName(marked.where("_hit").drop("_hit").dropDuplicates([key, text]))


def trim() -> None:
    """Give freed memory back, as Python workers live on and stay as large as their largest task made them."""
    pa.default_memory_pool().release_unused()
    if release := getattr(ctypes.CDLL(None), "malloc_trim", None):
        release(0)


def slices(batches: Iterable[pa.RecordBatch], column: str, max_chars: int = 4_000_000, max_rows: int = 2000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut Arrow batches into runs of rows with about ``max_chars`` bytes of ``column``.

    A single longer row makes a run of its own; no row is dropped or cut.
    """
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and (total + n > max_chars or i - start >= max_rows):
                part = batch.slice(start, i - start)
                yield part, part.column(column).to_pylist()
                start, total = i, 0
            total += n
        if len(sizes) > start:
            part = batch.slice(start)
            yield part, part.column(column).to_pylist()
        del batch
        trim()


def map_texts(df: DataFrame, id_col: str, text_col: str, schema: str, make: Callable[[], Callable[[list], dict]]) -> DataFrame:
    """Apply a function of a run of texts, in Arrow batches.

    ``make`` runs once per task and returns a function from a list of texts
    (null entries included) to columns (name -> list or Arrow array) besides
    the id, in the order of ``schema``.  Other columns of ``df`` are ignored.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    kinds = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for part, texts in slices(batches, "_text"):
            work = work or make()
            out = work(texts)
            yield pa.RecordBatch.from_arrays([part.column("_id"), *(out[n] if isinstance(out[n], pa.Array) else pa.array(out[n], kind) for n, kind in kinds.items())], names=[id_col, *kinds])

    picked = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return picked.mapInArrow(run, f"`{id_col}` {id_type}, {schema}")
