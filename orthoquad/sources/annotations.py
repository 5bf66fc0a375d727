"""JSON-lines annotations and polygon files, read with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import corners_ok
from ..schema import ANNOTATION, LABELME, REJECT


def scan_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good records, and rejects (unparsable line or bad corners) with their reason.

    ``path`` is a file or folder of JSON lines.  Corners are doubles, so that
    fractional coordinates survive.
    """
    rows = spark.read.schema(f"{ANNOTATION}, _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return split_rejects(rows)


def split_rejects(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    reason = F.when(F.col("_corrupt").isNotNull(), "not a record").when(~corners_ok("corners"), "not four finite points")
    marked = rows.withColumn(REJECT, reason)
    return marked.where(F.col(REJECT).isNull()).drop(REJECT, "_corrupt"), marked.where(F.col(REJECT).isNotNull())


def scan_dataset(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """All splits of ``root``/<split>/annotations.jsonl with a ``split`` column, and rejects."""
    rows = spark.read.schema(f"{ANNOTATION}, _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt").json(f"{root}/*/annotations.jsonl")
    return split_rejects(rows.withColumn("split", F.regexp_extract(F.input_file_name(), r"([^/]+)/annotations\.jsonl", 1)))


def scan_polygons(spark: SparkSession, path: str) -> DataFrame:
    """One row per polygon file, point order as clicked."""
    return spark.read.schema(LABELME).option("multiLine", True).json(path)
