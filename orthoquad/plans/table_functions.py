"""Table functions for SQL.

    register(spark)
    SELECT * FROM suppress(TABLE(SELECT image, id, score, x0, y0, x1, y1 FROM boxes), 3, 10)

``suppress`` is greedy suppression as ``operators.nms`` does it, at an IoU above
n / d.  Its argument needs no PARTITION BY or ORDER BY, as ``analyze`` asks for
them: rows come by image, then by falling score and rising id.  The result has
the kept rows' image and id, in the argument's types.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..operators.nms import CHUNK, EXACT, SIDES, Kept

COLUMNS = ("image", "id", "score", *SIDES)


class Suppress:
    """Holds an image's kept boxes, and up to ``CHUNK`` rows that are compared at once; an instance serves one image."""

    def __init__(self):
        self.kept: Kept | None = None
        self.waiting: list[tuple] = []
        self.threshold: Fraction | None = None

    @staticmethod
    def analyze(boxes: AnalyzeArgument, n: AnalyzeArgument, d: AnalyzeArgument) -> AnalyzeResult:
        if not boxes.isTable:
            raise ValueError("the first argument is a table")
        fields = {f.name: f for f in boxes.dataType.fields}
        if missing := [c for c in COLUMNS if c not in fields]:
            raise ValueError(f"the table lacks {', '.join(missing)}")
        if n.value is None or d.value is None or d.value <= 0 or not 0 <= n.value <= d.value:
            raise ValueError("the threshold n / d is a constant from 0 to 1")
        schema = StructType([StructField(c, fields[c].dataType) for c in ("image", "id")])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("image")], orderBy=[OrderingColumn("score", ascending=False, overrideNullsFirst=False), OrderingColumn("id")])

    def eval(self, row: Row, n: int, d: int) -> Iterator[tuple]:
        sides = [row[c] for c in SIDES]
        known = [row["image"], row["id"], row["score"], *sides]
        if None in known or not all(abs(float(v)) < float("inf") for v in known[2:]) or sides[0] > sides[2] or sides[1] > sides[3]:
            return
        if self.kept is None:
            self.threshold = Fraction(n, d)
            self.kept = Kept(np.dtype(np.int64 if all(isinstance(v, int) for v in sides) else np.float64))
        if self.kept.boxes.dtype != np.float64 and max(map(abs, sides)) > EXACT:
            yield from self.taken()  # what came before is compared exactly
            self.kept.boxes = self.kept.boxes.astype(np.float64)
        self.waiting.append((row["image"], row["id"], sides))
        if len(self.waiting) == CHUNK:
            yield from self.taken()

    def taken(self) -> Iterator[tuple]:
        """Those of the waiting rows that are kept."""
        if self.waiting:
            stays = self.kept.offer(np.array([s for _, _, s in self.waiting], self.kept.boxes.dtype), self.threshold)
            yield from (w[:2] for w, k in zip(self.waiting, stays, strict=True) if k)
            self.waiting = []

    def terminate(self) -> Iterator[tuple]:
        yield from self.taken()


def register(spark: SparkSession) -> None:
    spark.udtf.register("suppress", udtf(Suppress))
