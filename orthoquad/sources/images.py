"""Image folders: bytes, or decoded pixels as Spark's image source gives them (rows of B, G, R)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import REJECT


#: Partitions of small files that a task reads, about.  Spark counts a file as 4 MB or more when it plans, so one holds 32 files at most.
GATHERED = 32


def gathered(files: DataFrame) -> DataFrame:
    """A scan of files, about 1,000 small ones a task instead of 32, without a shuffle; a few tasks a core at least."""
    planned = files.rdd.getNumPartitions()
    return files.coalesce(max(4 * files.sparkSession.sparkContext.defaultParallelism, -(-planned // GATHERED)))


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    """``root``/<split>/images/*.jpg as split, image (relative to its split) and content.

    Spark reads no bytes where ``content`` is not used.
    """
    files = gathered(spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(f"{root}/*/images"))
    return files.select(F.regexp_extract("path", r"([^/]+)/images/[^/]+$", 1).alias("split"), F.regexp_extract("path", r"(images/[^/]+)$", 1).alias("image"), "content", "length")


def scan_folder(spark: SparkSession, path: str, glob: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """All images under a folder of backgrounds or of inference inputs: path, length, content."""
    files = gathered(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path))
    return files.select("path", "length", "content")


def decode_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Decoded images (image, height, width, channels, data), and rejects that can't be decoded."""
    rows = gathered(spark.read.format("image").load(path)).select(F.col("image.origin").alias("image"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    marked = rows.withColumn(REJECT, F.when(F.col("height") < 0, "not an image"))
    return marked.where(F.col(REJECT).isNull()).drop(REJECT), marked.where(F.col(REJECT).isNotNull()).select("image", REJECT)
