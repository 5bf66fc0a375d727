"""The annotation flow as a stream: the same projections over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.geometry import to_portrait
from ..operators.dataset import stored
from ..schema import ANNOTATION
from ..sources.annotations import split_rejects


def stream_annotations(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Good records and rejects of JSON-lines files that appear under ``path``."""
    reader = spark.readStream.schema(f"{ANNOTATION}, _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt")
    return split_rejects(reader.option("maxFilesPerTrigger", files_per_trigger).json(path))


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Rotate records to portrait and append them as Parquet, once each, until the present files are done."""
    good, _ = stream_annotations(spark, path)
    writer = stored(to_portrait(good)).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(out)
