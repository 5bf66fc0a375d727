"""Model parameters as rows of (name, shape): strict loading with one exception, and the wider head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = "regression_headers"


def in_header(name: Column | str, header: str = HEADER) -> Column:
    n = F.col(name) if isinstance(name, str) else name
    return F.startswith(n, F.lit(header))


def manifest_diff(model: DataFrame, checkpoint: DataFrame, header: str = HEADER) -> DataFrame:
    """Names whose shapes differ or that one side lacks, with ``allowed`` for the old header."""
    joined = model.select("name", F.col("shape").alias("model_shape")).join(checkpoint.select("name", F.col("shape").alias("checkpoint_shape")), "name", "full_outer")
    return joined.where(~F.col("model_shape").eqNullSafe(F.col("checkpoint_shape"))).withColumn("allowed", in_header("name", header))


def check_load(model: DataFrame, checkpoint: DataFrame, header: str = HEADER) -> None:
    """Raise unless all parameters outside the header agree; the message names the first few that don't."""
    wrong = [r.name for r in manifest_diff(model, checkpoint, header).where(~F.col("allowed")).orderBy("name").limit(20).collect()]
    if wrong:
        raise ValueError(f"parameters do not match: {', '.join(wrong)}")


def last_convolutions(model: DataFrame, header: str = HEADER) -> DataFrame:
    """Per header level, the weight and bias of its last convolution: level, name, shape.

    Names are ``header.level[.layer].weight`` or ``.bias``.
    """
    number = lambda i: F.try_element_at(F.split("name", r"\."), F.lit(i)).try_cast("int")
    parts = model.where(in_header("name", header)).withColumns({"level": number(2), "layer": F.coalesce(number(3), F.lit(0))})
    last = parts.groupBy("level").agg(F.max("layer").alias("layer"))
    return parts.join(last, ["level", "layer"]).select("level", "name", "shape")


def widen_header(model: DataFrame, old_values: int = 4, new_values: int = 8, header: str = HEADER) -> DataFrame:
    """The manifest with the last convolutions' first dimension grown from anchors x old to anchors x new, and ``reinitialise`` for these."""
    ends = last_convolutions(model, header).select("name", F.lit(True).alias("_end"))
    joined = model.join(ends, "name", "left")
    grown = F.concat(F.array((F.col("shape")[0] * new_values / old_values).cast("long")), F.slice("shape", 2, F.greatest(F.size("shape") - 1, F.lit(0))))
    return joined.select("name", F.when(F.col("_end"), grown).otherwise(F.col("shape")).alias("shape"), F.coalesce("_end", F.lit(False)).alias("reinitialise"))


def header_reshape(raw: DataFrame, values: int = 8, column: str = "header") -> DataFrame:
    """One row per anchor of a cell's header output: anchor and its ``values`` numbers."""
    cut = F.transform(F.sequence(F.lit(0), (F.size(column) / values).cast("int") - 1), lambda a: F.slice(column, a * values + 1, values))
    return raw.select(*(c for c in raw.columns if c != column), F.posexplode(cut).alias("anchor", "values"))
