"""Rollups and cubes with sketches that merge.

Rows are aggregated once, to their finest groups, where quantiles (KLL) and
distinct values (HyperLogLog) are kept as binary sketches; all coarser groups
merge these, so the table is scanned once however many levels there are, and
no level sorts or holds its values.  Finest partials can also be stored and
merged with later ones (``merge``).

Nulls are groups of their own; ``level`` (the grouping id) tells them from a
dimension that was rolled up.  Null values and things are not counted in their
sketches.  An empty table gives an empty result without a grand total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes of the sketches: the rank error of quantiles is about 1.33 % at 200, the relative error of distinct counts 1.6 % at 2 ** 12.
KLL_K, HLL_LOG_K = 200, 12


def partials(rows: DataFrame, dims: Sequence[str], value: str, thing: str) -> DataFrame:
    """Per finest group: n, low, high and the sketches of ``value`` and ``thing``."""
    number = F.col(value).cast("double")
    sound = F.when(~F.isnan(number), number)
    return rows.groupBy(*dims).agg(F.count("*").alias("n"), F.min(sound).alias("low"), F.max(sound).alias("high"), F.kll_sketch_agg_double(sound, F.lit(KLL_K)).alias("values"), F.hll_sketch_agg(thing, F.lit(HLL_LOG_K)).alias("things"))


_MERGED = (F.sum, "n"), (F.min, "low"), (F.max, "high"), (lambda c: F.kll_merge_agg_double(c, F.lit(KLL_K)), "values"), (F.hll_union_agg, "things")


def merge(parts: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Partials of several tables or days, of the same dimensions, as one."""
    return parts.groupBy(*dims).agg(*(f(c).alias(c) for f, c in _MERGED))


def rolled(parts: DataFrame, dims: Sequence[str], cube: bool = False) -> DataFrame:
    """All levels of a rollup (or cube) of partials: dims, level and the merged columns."""
    grouped = parts.cube(*dims) if cube else parts.rollup(*dims)
    found = grouped.agg(F.grouping_id().cast("int").alias("level"), *(f(c).alias(c) for f, c in _MERGED))
    return found.where(F.col("n") > 0)


def estimates(merged: DataFrame, quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """The columns of ``merged`` with quantiles and the distinct count in place of the sketches."""
    kept = [c for c in merged.columns if c not in ("values", "things")]
    filled = F.kll_sketch_get_n_double("values")
    at = F.array(*(F.when(filled > 0, F.kll_sketch_get_quantile_double("values", F.lit(float(q)))) for q in quantiles))
    return merged.select(*kept, filled.alias("n_values"), at.alias("quantiles"), F.hll_sketch_estimate("things").alias("distinct"))
