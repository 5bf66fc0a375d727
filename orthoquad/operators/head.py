"""Detector head rows: slicing, scores, corner decoding and the inference flow."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import pixels
from .nms import nms

OUTPUT = "image STRING, prior_id INT, confidence ARRAY<FLOAT>, ordered_corners ARRAY<FLOAT>"


def confidence(raw: Column | str, offset: int = 0) -> Column:
    return F.slice(raw, offset + 1, 2)


def ordered_corners(raw: Column | str, offset: int = 2) -> Column:
    return F.slice(raw, offset + 1, 8)


def margin(conf: Column | str) -> Column:
    """Ranks as ``probability`` does, without an exponential."""
    c = F.col(conf) if isinstance(conf, str) else conf
    return c[1].cast("double") - c[0].cast("double")


def probability(conf: Column | str) -> Column:
    return 1 / (1 + F.exp(-margin(conf)))


def decode(flat: Column | str, decoder: Callable[[Column], Column] | None = None) -> Column:
    """Four points from eight values; ``decoder`` maps encoded points to pixels and is the identity by default."""
    points = g.reshape_corners(flat)
    return decoder(points) if decoder else points


def prior_decoder(cx: Column | str, cy: Column | str, side: Column | str, variance: float = 0.1) -> Callable[[Column], Column]:
    """A decoder of points encoded about their prior's centre, in units of ``variance`` times its side."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    step = col(side) * variance
    return lambda points: F.transform(points, lambda p: F.array(col(cx) + p[0].cast("double") * step, col(cy) + p[1].cast("double") * step))


def outputs(rows: DataFrame) -> DataFrame:
    """What a detector returns: confidence and ordered corners, nothing else."""
    return rows.select("image", "prior_id", "confidence", "ordered_corners")


def forward(images: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """Run a model: ``load`` is called once a task and returns a function from rows of images to ``OUTPUT`` rows.

    Arrays reach the model as views of the batch, not value by value.
    """
    return images.mapInArrow(lambda batches: _outputs(batches, load), OUTPUT)


def forward_frames(images: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], change: Callable[[np.ndarray], np.ndarray] = lambda a: a) -> DataFrame:
    """``forward`` of ``pixels.channels_first`` of changed frames, in one pass: neither frames nor tensors come back from it."""
    frames = images.select("image", "height", "width", "channels", "data")
    return frames.mapInArrow(lambda batches: _outputs(pixels.tensors(batches, change), load), OUTPUT)


def _outputs(batches: Iterator[pa.RecordBatch], load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> Iterator[pa.RecordBatch]:
    numbers = pa.list_(pa.float32())
    schema = pa.schema([("image", pa.string()), ("prior_id", pa.int32()), ("confidence", numbers), ("ordered_corners", numbers)])
    model = load()
    for batch in batches:
        yield pa.RecordBatch.from_pandas(model(batch.to_pandas())[schema.names], schema, preserve_index=False)


def detect(rows: DataFrame, threshold: Fraction, min_margin: float | None = None, decoder: Callable[[Column], Column] | None = None) -> DataFrame:
    """Decode, derive boxes, suppress: image, prior_id, margin and ordered_corners of what is kept.

    The score filter comes before corners are decoded and lists are built.
    """
    scored = rows.withColumn("margin", margin("confidence"))
    if min_margin is not None:
        scored = scored.where(F.col("margin") >= min_margin)
    boxed = scored.withColumn("_points", decode("ordered_corners", decoder)).withColumn("box", g.bbox("_points"))
    return nms(boxed, "image", "prior_id", "margin", threshold, keep=("margin", "ordered_corners"))
