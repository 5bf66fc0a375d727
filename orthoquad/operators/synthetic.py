"""Synthetic images of one code-like square each.

The square carries the three finder marks that fix its orientation and seeded
modules; it stands for a code in tests of the data flow and is not readable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import HEIGHT, WIDTH
from .dataset import assign_split, image_name, with_constants

MODULES = 21


def pattern(rng: np.random.Generator) -> np.ndarray:
    """Dark modules of a square with finder marks at three corners."""
    dark = rng.random((MODULES, MODULES)) < 0.5
    ring = np.maximum(*np.abs(np.mgrid[-3:4, -3:4]))
    mark = (ring == 3) | (ring <= 1)
    for y, x in ((0, 0), (0, MODULES - 7), (MODULES - 7, 0)):
        dark[max(0, y - 1) : y + 8, max(0, x - 1) : x + 8] = False
        dark[y : y + 7, x : x + 7] = mark
    return dark


def draw(seed: int, width: int = WIDTH, height: int = HEIGHT, background: np.ndarray | None = None) -> tuple[np.ndarray, list[list[float]]]:
    """An image in B, G, R and the square's own corners P0..P3, turned by any angle."""
    rng = np.random.default_rng(seed)
    image = np.full((height, width, 3), rng.integers(120, 220), np.uint8) if background is None else background.copy()
    side = rng.uniform(0.3, 0.6) * min(width, height)
    angle, radius = rng.uniform(0, 2 * np.pi), side / np.sqrt(2)
    cx, cy = rng.uniform(radius, width - 1 - radius), rng.uniform(radius, height - 1 - radius)
    right = np.array([np.cos(angle), np.sin(angle)])
    down = np.array([-right[1], right[0]])
    origin = np.array([cx, cy]) - side / 2 * (right + down)
    # only the window around the square is looked at
    left, top = max(0, int(cx - radius) - 1), max(0, int(cy - radius) - 1)
    window = image[top : int(cy + radius) + 2, left : int(cx + radius) + 2]
    y, x = np.mgrid[top : top + window.shape[0], left : left + window.shape[1]]
    u = ((x - origin[0]) * right[0] + (y - origin[1]) * right[1]) / side
    v = ((x - origin[0]) * down[0] + (y - origin[1]) * down[1]) / side
    inside = (u >= 0) & (u < 1) & (v >= 0) & (v < 1)
    dark = pattern(rng)
    window[inside] = np.where(dark[(v[inside] * MODULES).astype(int), (u[inside] * MODULES).astype(int)], 0, 255)[:, None]
    return image, [(origin + side * p).tolist() for p in (0 * right, right, right + down, down)]


def has_marks(image: np.ndarray, corners: list) -> bool:
    """Whether a light ring and a dark centre lie where the finder marks of P0, P1 and P3 belong."""
    p = np.stack([np.asarray(c, float) for c in corners])
    right, down = (p[1] - p[0]) / MODULES, (p[3] - p[0]) / MODULES
    at = lambda u, v: image[tuple(np.rint(p[0] + u * right + v * down).astype(int)[::-1])].max()
    low, high = (1.5, 3.5), (MODULES - 1.5, MODULES - 3.5)
    return all(at(u[0], v[0]) == 255 and at(u[1], v[1]) == 0 for u, v in ((low, low), (high, low), (low, high)))


def generate(spark: SparkSession, n: int, seed: int = 0, train: int = 90, val: int = 5, backgrounds: DataFrame | None = None, of: int = 0) -> DataFrame:
    """``n`` rows of split, annotation fields and decoded pixels; the same for a seed however the work is dealt.

    ``backgrounds`` has decoded images of three channels, numbered by ``index``
    from 0 to ``of`` - 1; row i is drawn over number i modulo ``of``, at its size,
    where that background is read.
    """
    schema = "id BIGINT, height INT, width INT, channels INT, data BINARY, corners ARRAY<ARRAY<DOUBLE>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            behind = [np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) if "data" in batch else None for r in batch.itertuples()]
            drawn = [draw(seed * 1_000_003 + int(i), *((b.shape[1], b.shape[0]) if b is not None else (WIDTH, HEIGHT)), b) for i, b in zip(batch["id"], behind, strict=True)]
            yield pd.DataFrame({"id": batch["id"], "height": [a.shape[0] for a, _ in drawn], "width": [a.shape[1] for a, _ in drawn], "channels": 3, "data": [a.tobytes() for a, _ in drawn], "corners": [c for _, c in drawn]})

    ids = spark.range(n)
    if backgrounds is not None:
        index = F.col("index").cast("long")
        over = backgrounds.where((index >= 0) & (index < min(n, of)))
        ids = over.select(F.explode(F.sequence(index, F.lit(n - 1).cast("long"), F.lit(of).cast("long"))).alias("id"), "height", "width", "data")
    rows = ids.mapInPandas(run, schema)
    named = rows.withColumn("split", assign_split("id", train, val)).withColumn("image", image_name("split", "id"))
    return with_constants(named).drop("id")
