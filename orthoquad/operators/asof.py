"""As-of join: to each row the last row of another table, of its key and not later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import keep_to_end, shared_path
from .numbering import ROW_BITS


def asof_join(left: DataFrame, right: DataFrame, key: Sequence[str], time: str, columns: Sequence[str], ties: Sequence[str] = (), within: Column | None = None) -> DataFrame:
    """All rows of ``left`` with ``columns`` of the last row of ``right`` of the same ``key`` whose ``time`` is not later.

    Rows of both tables are dealt together into ranges of key and time and
    sorted there, so a hot key lies in many ranges, each of bounded size.  In a
    range, a row takes the last right row before it; where there is none, the
    last one of the key in an earlier range, which comes from a table of one row
    per key and range.  Right rows of one time are ordered by ``ties``.
    ``within`` is a largest age, as an interval: an older row is no match.

    Rows of ``left`` without a match, or with a null key or time, have nulls;
    rows of ``right`` with a null key or time match nothing.  Repeated rows stay.
    The sorted rows are written to the shared folder until the driver ends.
    """
    spark, keys = left.sparkSession, [f"_k{i}" for i in range(len(key))]
    named = [F.col(f"`{c}`").alias(k) for c, k in zip(key, keys, strict=True)]
    taken = F.struct(*(F.col(f"`{c}`") for c in columns), F.col(f"`{time}`").alias("_at"))
    whole = F.struct(*(F.col(f"`{c}`") for c in left.columns))
    order = F.struct(*(F.col(f"`{c}`") for c in ties), F.lit(0).alias("_o"))
    present = F.col(f"`{time}`").isNotNull()
    for c in key:
        present = present & F.col(f"`{c}`").isNotNull()
    ours = left.select(*named, F.col(f"`{time}`").alias("_t"), F.lit(1).alias("_side"), whole.alias("_left"))
    theirs = right.where(present).select(*named, F.col(f"`{time}`").alias("_t"), F.lit(0).alias("_side"), order.alias("_tie"), taken.alias("_right"))
    both = ours.unionByName(theirs, allowMissingColumns=True)
    by = [*keys, "_t", "_side", "_tie"]
    path = keep_to_end(spark, shared_path(spark, "asof"))
    # rows alike in all of these are dealt by their hash, so that one instant with many rows is split too
    both.repartitionByRange(*by, F.xxhash64("_left")).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("_range", F.shiftright("_place", ROW_BITS))
    seen = Window.partitionBy("_range", *keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumn("_own", F.last("_right", ignorenulls=True).over(seen)).where("_side = 1")
    ends = placed.groupBy(*keys, "_range").agg(F.max_by("_right", F.when(F.col("_side") == 0, F.col("_place"))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*(F.col(k).alias(f"{k}c") for k in keys), F.col("_range").alias("_of"), F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}c"))
    found = own.join(carried, same, "left").withColumn("_match", F.when(F.col("_t").isNotNull(), F.coalesce("_own", "_carry")))
    if within is not None:
        found = found.withColumn("_match", F.when(F.col("_match._at") >= F.col("_t") - within, F.col("_match")))
    return found.select("_left.*", *(F.col(f"_match.`{c}`") for c in columns))
