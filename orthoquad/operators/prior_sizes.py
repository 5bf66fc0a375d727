"""Sizes of priors from the boxes of a dataset, by clustering under 1 - IoU.

Boxes are compared as if they shared a centre, so only width and height count.
Equal sizes are counted first; each round then gives every size to the nearest
centre, in one projection, and sums sizes per centre within tasks, so that a
round moves ``k`` rows, whatever the table.  Rounds end when no centre moves by
more than ``tolerance``, or after ``rounds``.

The start are the ``k`` distinct sizes of least hash with the seed.  A tie goes
to the earlier centre; a centre without sizes stays where it is.  Boxes that are
null, not finite or without area take no part; fewer distinct sizes than ``k``
give that many centres, and an empty table none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import keep_to_end, shared_path


@dataclass(frozen=True)
class Size:
    width: float
    height: float
    boxes: int
    overlap: float  # mean IoU of its boxes with it


def centred_iou(width: Column, height: Column, of: tuple[float, float]) -> Column:
    common = F.least(width, F.lit(of[0])) * F.least(height, F.lit(of[1]))
    return common / (width * height + F.lit(of[0] * of[1]) - common)


def nearest(centres: list[tuple[float, float]]) -> Column:
    """struct(iou, tie): the best centre of a row's _w and _h; its number is -tie."""
    each = [F.struct(centred_iou(F.col("_w"), F.col("_h"), c).alias("iou"), F.lit(-i).alias("tie")) for i, c in enumerate(centres)]
    return F.greatest(*each) if len(each) > 1 else each[0]


def counted(rows: DataFrame, box: str = "box") -> DataFrame:
    """Distinct sizes _w and _h with their number _n."""
    width, height = ((F.col(box)[high] - F.col(box)[low]).cast("double") for low, high in (("x0", "x1"), ("y0", "y1")))
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & F.col(c).between(1e-9, 1e150)
    return rows.select(width.alias("_w"), height.alias("_h")).where(fine("_w") & fine("_h")).groupBy("_w", "_h").agg(F.count("*").alias("_n"))


def start(sizes: DataFrame, k: int, seed: int) -> list[tuple[float, float]]:
    found = sizes.select("_w", "_h").orderBy(F.xxhash64("_w", "_h", F.lit(seed)), "_w", "_h").limit(k).collect()
    return [(r["_w"], r["_h"]) for r in found]


def learn(rows: DataFrame, k: int, box: str = "box", seed: int = 1, rounds: int = 100, tolerance: float = 1e-6) -> list[Size]:
    """At most ``k`` sizes, by rising area; what the driver sees is one row per centre and round."""
    spark = rows.sparkSession
    path = keep_to_end(spark, shared_path(spark, "sizes"))
    counted(rows, box).write.parquet(path)
    sizes = spark.read.parquet(path)
    centres = start(sizes, k, seed)
    if not centres:
        return []
    for _ in range(rounds):
        summed = _summed(sizes, centres)
        moved = [(summed[i]["w"] / summed[i]["n"], summed[i]["h"] / summed[i]["n"]) if i in summed else c for i, c in enumerate(centres)]
        step = max(abs(a - b) for old, new in zip(centres, moved, strict=True) for a, b in zip(old, new, strict=True))
        centres = moved
        if step <= tolerance:
            break
    summed = _summed(sizes, centres)
    out = [Size(w, h, summed[i]["n"], summed[i]["iou"] / summed[i]["n"]) if i in summed else Size(w, h, 0, 0.0) for i, (w, h) in enumerate(centres)]
    return sorted(out, key=lambda s: (s.width * s.height, s.width))


def _summed(sizes: DataFrame, centres: list[tuple[float, float]]) -> dict[int, dict]:
    n = F.col("_n")
    best = sizes.select("_w", "_h", "_n", nearest(centres).alias("_b"))
    sums = best.groupBy((-F.col("_b.tie")).alias("centre")).agg(F.sum(F.col("_w") * n).alias("w"), F.sum(F.col("_h") * n).alias("h"), F.sum(F.col("_b.iou") * n).alias("iou"), F.sum(n).alias("n"))
    return {r["centre"]: r for r in sums.collect()}


def sides(sizes: list[Size], anchors: tuple[int, ...]) -> dict[tuple[int, int], int]:
    """Square sides for a grid's (level, anchor), smaller ones on finer levels; as many sizes as anchors are needed."""
    places = [(level, a) for level, n in enumerate(anchors) for a in range(n)]
    if len(places) != len(sizes):
        raise ValueError(f"{len(sizes)} sizes for {len(places)} anchors")
    return {p: max(1, round((s.width * s.height) ** 0.5)) for p, s in zip(places, sorted(sizes, key=lambda s: s.width * s.height), strict=True)}
