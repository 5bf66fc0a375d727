"""Dense numbers in a global order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import keep_to_end, shared_path

#: Bits of ``monotonically_increasing_id`` that count the rows of a partition.
ROW_BITS = 33


def number(rows: DataFrame, order: Sequence[Column | str], groups: Sequence[str] = (), name: str = "index") -> DataFrame:
    """``rows`` with ``name``: 0, 1, 2, ... along ``order``, anew in each of ``groups``.

    Rows are dealt into ranges of (groups, order) and sorted there; a row's
    number is its place in its range plus the rows of its group in the ranges
    before.  Only these counts, one row per group and range, are ordered by a
    window; without groups that is one small task, of one row per range.  A hot group lies in many ranges; ranges can be split where
    ``order`` tells rows apart, and rows that it doesn't tell apart are numbered
    in any order.  Null groups are a group; null orders follow Spark's ordering.
    An empty table gives an empty one.  The sorted rows are written to the shared
    folder, where they stay until the driver ends, so that counts and numbers
    are of the same ranges even if a task runs again; number keys alone and join
    them where rows are wide.
    """
    spark, own = rows.sparkSession, list(rows.columns)
    keys = [F.col(f"`{g}`") for g in groups] + [F.col(f"`{c}`") if isinstance(c, str) else c for c in order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    path = keep_to_end(spark, shared_path(spark, "numbered"))
    dealt.withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("_range", F.shiftright("_place", ROW_BITS))
    of = [F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(groups)] or [F.lit(0).alias("_g0")]
    names = [f"_g{i}" for i in range(len(of))]
    counts = placed.select(*of, F.col("_range").alias("_of"), "_place").groupBy(*names, "_of").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*names).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*names, "_of", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    same = [F.col("_range") == F.col("_of"), *(F.col(f"`{g}`").eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups))]
    joined = placed.join(starts, reduce(lambda a, b: a & b, same))
    return joined.select(*(F.col(f"`{c}`") for c in own), (F.col("_place") - F.col("_first") + F.col("_before")).alias(name))
