"""Matching of ground-truth boxes to priors by overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .priors import LEVELS, Level

BOX = ("_x0", "_y0", "_x1", "_y1")


def _cells(box: str, size: int):
    span = lambda low, high: F.sequence(F.floor(F.col(box)[low] / size).cast("int"), F.floor(F.col(box)[high] / size).cast("int"))
    return span("x0", "x1"), span("y0", "y1")


def overlapping(left: DataFrame, priors: DataFrame, box: str = "box", prior_box: str = "prior_box", cell: int = 64) -> DataFrame:
    """Pairs whose boxes overlap: a range join as an equi-join on grid cells.

    Both sides go to each cell that they touch; a pair is formed in the cell of
    its intersection's upper left corner only, so it comes once.  Boxes have
    x0 <= x1 and y0 <= y1.  Spark broadcasts the priors if their measured size
    allows.
    """
    lx, ly = _cells(box, cell)
    px, py = _cells(prior_box, cell)
    a = left.withColumn("_cx", F.explode(lx)).withColumn("_cy", F.explode(ly))
    b = priors.withColumn("_cx", F.explode(px)).withColumn("_cy", F.explode(py))
    joined = a.join(b, ["_cx", "_cy"])
    touch = (F.col(box)["x0"] < F.col(prior_box)["x1"]) & (F.col(prior_box)["x0"] < F.col(box)["x1"]) & (F.col(box)["y0"] < F.col(prior_box)["y1"]) & (F.col(prior_box)["y0"] < F.col(box)["y1"])
    home = lambda low: F.floor(F.greatest(F.col(box)[low], F.col(prior_box)[low]) / cell).cast("int")
    return joined.where(touch & (F.col("_cx") == home("x0")) & (F.col("_cy") == home("y0"))).drop("_cx", "_cy")


def best_prior(truth: DataFrame, priors: DataFrame, id_col: str, box: str = "box") -> DataFrame:
    """Per ground truth the prior of greatest overlap, ties to the smaller id: prior_id and iou.

    ``max_by`` combines within tasks, so nothing is sorted or windowed.
    """
    own = priors.select("prior_id", F.col("box").alias("prior_box"))
    pairs = overlapping(truth.select(id_col, box), own, box)
    ranked = F.struct(g.iou(box, "prior_box").alias("iou"), (-F.col("prior_id")).alias("tie"))
    best = pairs.groupBy(id_col).agg(F.max(ranked).alias("best"))
    return best.select(id_col, (-F.col("best.tie")).cast("int").alias("prior_id"), F.col("best.iou").alias("iou"))


def _along(low: np.ndarray, high: np.ndarray, side: float, stride: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest overlap of each [low, high] with a side that is centred in one of ``cells`` cells, and the first cell that has it.

    Overlap rises, stays and falls along the axis, so it is greatest in the
    first cell of the flat stretch or, where no centre lies in that, beside it.
    """
    flat = (low + high) / 2 - np.abs(high - low - side) / 2
    first = np.ceil((flat - stride // 2) / stride)
    before, after = (np.clip(c, 0, cells - 1) for c in (first - 1, first))
    overlap = lambda at: np.maximum(np.minimum(high, at * stride + stride // 2 + side / 2) - np.maximum(low, at * stride + stride // 2 - side / 2), 0.0)
    one, two = overlap(before), overlap(after)
    return np.maximum(one, two), np.where(one >= two, before, after).astype(np.int64)


def closest(boxes: np.ndarray, sides: dict[tuple[int, int], int], levels: tuple[Level, ...] = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Per box (rows of x0, y0, x1, y1) the prior of greatest overlap, ties to the smaller id, and that overlap."""
    x0, y0, x1, y1 = boxes.T
    best, prior, offset = np.zeros(len(boxes)), np.full(len(boxes), -1, np.int64), 0
    for number, level in enumerate(levels):
        for anchor in range(level.anchors):
            side = float(sides[number, anchor])
            (wide, column), (high, row) = _along(x0, x1, side, level.stride, level.columns), _along(y0, y1, side, level.stride, level.rows)
            common, own = wide * high, offset + (row * level.columns + column) * level.anchors + anchor
            iou = np.where(common > 0, common / ((x1 - x0) * (y1 - y0) + side * side - common), 0.0)
            better = (iou > best) | ((iou == best) & (own < prior) & (iou > 0))
            best, prior = np.where(better, iou, best), np.where(better, own, prior)
        offset += level.priors
    return prior, best


def best_grid_prior(truth: DataFrame, id_col: str, sides: dict[tuple[int, int], int], levels: tuple[Level, ...] = LEVELS, box: str = "box") -> DataFrame:
    """As ``best_prior`` for the priors of a grid with square boxes, in closed form: one pass over Arrow batches, no join.

    The priors of a level and anchor share their size, so the one of greatest
    overlap has the best column and the best row; ``sides`` has the side of
    (level, anchor).  Rows that overlap no prior, and those whose box is null or
    has a coordinate that is null or not finite, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in BOX], axis=1).astype(np.float64)
            with np.errstate(all="ignore"):
                prior, iou = closest(boxes, sides, levels)
            hit = pa.array(np.isfinite(boxes).all(axis=1) & (iou > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prior, pa.int32()), pa.array(iou)], names=[id_col, "prior_id", "iou"]).filter(hit)

    sized = truth.select(id_col, *(F.col(box)[c].cast("double").alias(name) for c, name in zip(("x0", "y0", "x1", "y1"), BOX, strict=True)))
    return sized.mapInArrow(run, f"`{id_col}` {truth.schema[id_col].dataType.simpleString()}, prior_id int, iou double")


def assign(truth: DataFrame, priors: DataFrame, id_col: str, threshold: float, box: str = "box") -> DataFrame:
    """All priors that overlap a ground truth by ``threshold`` or more, and each one's best prior whatever its overlap."""
    own = priors.select("prior_id", F.col("box").alias("prior_box"))
    pairs = overlapping(truth.select(id_col, box), own, box).select(id_col, "prior_id", g.iou(box, "prior_box").alias("iou"))
    best = best_prior(truth, priors, id_col, box)
    return pairs.where(F.col("iou") >= threshold).select(id_col, "prior_id", "iou").unionByName(best).distinct()
