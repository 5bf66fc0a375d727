"""The prior grid: candidate positions and scales of a fixed input size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import HEIGHT, WIDTH


@dataclass(frozen=True)
class Level:
    stride: int
    anchors: int

    @property
    def rows(self) -> int:
        return -(-HEIGHT // self.stride)

    @property
    def columns(self) -> int:
        return -(-WIDTH // self.stride)

    @property
    def priors(self) -> int:
        return self.rows * self.columns * self.anchors


#: Four feature maps of 40x30, 20x15, 10x8 and 5x4 cells: 4,420 priors.
LEVELS = (Level(8, 3), Level(16, 2), Level(32, 2), Level(64, 3))


def level_cells(spark: SparkSession, number: int, level: Level, offset: int) -> DataFrame:
    """The priors of one level; the id follows from row, column and anchor, so nothing has to be numbered."""
    ids = spark.range(level.priors)
    a, cell = F.pmod("id", F.lit(level.anchors)), F.floor(F.col("id") / level.anchors)
    i, j = F.floor(cell / level.columns), F.pmod(cell, F.lit(level.columns))
    return ids.select(
        (F.lit(offset) + F.col("id")).cast("int").alias("prior_id"),
        F.lit(number).alias("level"),
        i.cast("int").alias("row"),
        j.cast("int").alias("col"),
        a.cast("int").alias("anchor"),
        F.lit(level.stride).alias("stride"),
    )


def prior_grid(spark: SparkSession, levels: tuple[Level, ...] = LEVELS) -> DataFrame:
    """All levels as one axis of ids, in the order level, row, column, anchor."""
    out, offset = None, 0
    for number, level in enumerate(levels):
        part = level_cells(spark, number, level, offset)
        out = part if out is None else out.unionByName(part)
        offset += level.priors
    return out


def with_boxes(grid: DataFrame, sizes: dict[tuple[int, int], int]) -> DataFrame:
    """Add centres and square boxes; ``sizes`` gives the side of (level, anchor)."""
    side = F.lit(None).cast("int")
    for (level, anchor), size in sorted(sizes.items()):
        side = F.when((F.col("level") == level) & (F.col("anchor") == anchor), size).otherwise(side)
    cx, cy = F.col("stride") * F.col("col") + F.floor(F.col("stride") / 2), F.col("stride") * F.col("row") + F.floor(F.col("stride") / 2)
    placed = grid.withColumns({"side": side, "cx": cx.cast("double"), "cy": cy.cast("double")})
    half = F.col("side") / 2
    return placed.withColumn("box", F.struct((F.col("cx") - half).alias("x0"), (F.col("cy") - half).alias("y0"), (F.col("cx") + half).alias("x1"), (F.col("cy") + half).alias("y1")))
