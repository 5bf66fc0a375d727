"""Greedy non-maximum suppression per image."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SIDES = ("x0", "y0", "x1", "y1")
#: Whole sides up to this size are compared exactly in 64 bits, longer ones as doubles.
EXACT = 1 << 30
#: Candidates of an image that are compared at once.
CHUNK = 256
#: Weight that the threshold's terms may have where sides are exact.
TERMS = 1 << 10


def hits(a: np.ndarray, b: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Which of boxes ``a`` (n x 4) overlap which of ``b`` too much: IoU above n/d, as d * I > n * (A + B - I), exact on integers."""
    side = lambda low, high: np.maximum(np.minimum(a[:, None, high], b[None, :, high]) - np.maximum(a[:, None, low], b[None, :, low]), 0)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    common = side(0, 2) * side(1, 3)
    if a.dtype == np.int64 and (threshold.denominator > TERMS or len(a) and len(b) and max(int(area(a).max()), int(area(b).max())) > (1 << 62) // (4 * TERMS)):
        # terms beyond 64 bits: whole numbers of any size
        common, both = common.astype(object), area(a).astype(object)[:, None] + area(b).astype(object)[None]
        return (threshold.denominator * common > threshold.numerator * (both - common)).astype(bool)
    return threshold.denominator * common > threshold.numerator * (area(a)[:, None] + area(b)[None] - common)


class Kept:
    """The boxes that an image has kept so far."""

    def __init__(self, kind: np.dtype):
        self.boxes, self.n = np.empty((64, 4), kind), 0

    def offer(self, boxes: np.ndarray, threshold: Fraction) -> np.ndarray:
        """Which of ``boxes``, in their order, are kept: a chunk meets all kept boxes in one matrix, then its survivors each other."""
        stays = np.zeros(len(boxes), bool)
        for at in range(0, len(boxes), CHUNK):
            chunk = boxes[at : at + CHUNK]
            free = np.ones(len(chunk), bool)
            for k in range(0, self.n, 4 * CHUNK):  # in bounded memory, however many are kept
                rest = np.flatnonzero(free)
                free[rest[hits(chunk[rest], self.boxes[k : min(k + 4 * CHUNK, self.n)], threshold).any(axis=1)]] = False
            left = np.flatnonzero(free)
            own, alive = hits(chunk[left], chunk[left], threshold), np.ones(len(left), bool)
            for i in range(len(left)):
                if alive[i]:
                    alive[i + 1 :] &= ~own[i, i + 1 :]
            self._hold(chunk[left[alive]])
            stays[at + left[alive]] = True
        return stays

    def _hold(self, new: np.ndarray) -> None:
        while self.n + len(new) > len(self.boxes):
            self.boxes = np.concatenate([self.boxes, np.empty_like(self.boxes)])
        self.boxes[self.n : self.n + len(new)] = new
        self.n += len(new)


def usable(image: str, candidate: str, score: str, box: str) -> Column:
    """Rows that can be ranked and compared: nothing null, no coordinate or score that isn't finite, no side turned round."""
    number = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    sides = [F.col(box)[s] for s in SIDES]
    found = F.col(image).isNotNull() & F.col(candidate).isNotNull() & number(F.col(score))
    for s in sides:
        found = found & number(s)
    return F.coalesce(found & (sides[0] <= sides[2]) & (sides[1] <= sides[3]), F.lit(False))


def nms(candidates: DataFrame, image: str, candidate: str, score: str, threshold: Fraction, box: str = "box", keep: tuple[str, ...] = ()) -> DataFrame:
    """Kept candidates: image, candidate and the columns ``keep``.

    Candidates are taken by falling score, ties by rising id; one is kept unless
    it overlaps a kept one by more than ``threshold``.  Candidates that aren't
    ``usable`` (a null image, id, score, box or coordinate, one that isn't
    finite, or a box turned round) are left out.  Whole coordinates are compared
    exactly, those beyond ``EXACT`` as doubles.  Rows of an image come sorted and
    in batches, and only its kept boxes are held, which overlap little; so an
    image of any number of candidates needs bounded memory.
    """
    out = candidates.select(image, candidate, *keep).schema
    sound = candidates.where(usable(image, candidate, score, box))
    whole = all(f.dataType.typeName() in ("integer", "long", "short", "byte") for f in candidates.select(*(F.col(box)[s] for s in SIDES)).schema)
    far = F.lit(False)
    for s in SIDES if whole else ():
        far = far | ~F.col(box)[s].between(-EXACT, EXACT)
    kind = "long" if whole else "double"
    named = sound.select(image, candidate, *keep, F.xxhash64(image).alias("_image"), F.col(score).alias("_score"), far.alias("_far"), *(F.col(box)[s].cast(kind).alias(f"_{s}") for s in SIDES))
    dealt = named.repartition(image).sortWithinPartitions(image, F.desc("_score"), candidate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, Kept(np.dtype(np.int64 if whole else np.float64))
        for batch in batches:
            if not batch.num_rows:
                continue
            boxes = np.stack([batch.column(f"_{s}").to_numpy() for s in SIDES], axis=1)
            images, far = batch.column("_image").to_numpy(), batch.column("_far").to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(np.diff(images)) + 1).tolist(), len(images)]
            stays = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if images[a] != now:
                    now, kept = images[a], Kept(boxes.dtype)
                if far[a:b].any() and kept.boxes.dtype != np.float64:
                    kept.boxes = kept.boxes.astype(np.float64)
                stays.append(kept.offer(boxes[a:b].astype(kept.boxes.dtype), threshold))
            yield batch.select(out.names).filter(pa.array(np.concatenate(stays)))

    return dealt.mapInArrow(run, StructType(out.fields))
