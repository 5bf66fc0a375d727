"""Projective maps: corners, round trips, degenerate quadrilaterals."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoquad.functions import homography as h

UNIT = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]


def solved(quad):
    """The map by a linear system."""
    rows, want = [], []
    for (u, v), (x, y) in zip(UNIT, quad):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        want += [x, y]
    return [*np.linalg.solve(np.array(rows), np.array(want)), 1.0]


def test_map_equals_a_linear_system_and_goes_back(spark):
    rnd = random.Random(2)
    quads = [[[rnd.uniform(0, 10), rnd.uniform(0, 10)], [rnd.uniform(20, 30), rnd.uniform(0, 10)], [rnd.uniform(20, 30), rnd.uniform(20, 30)], [rnd.uniform(0, 10), rnd.uniform(20, 30)]] for _ in range(200)]
    points = [[12.5, 14.0], [3.0, 29.0]]
    rows = spark.createDataFrame([(i, q, points) for i, q in enumerate(quads)], "i int, q array<array<double>>, p array<array<double>>")
    m = rows.withColumn("m", h.homography("q"))
    for r in m.select("i", "m", h.project("m", h.project(h.inverse("m"), "p")).alias("back"), h.project(h.inverse("m"), "q").alias("own"), h.frame_error("q", "q").alias("none")).collect():
        assert r.m == pytest.approx(solved(quads[r.i]), rel=1e-7, abs=1e-9)
        assert np.allclose(r.back, points, atol=1e-9) and np.allclose(r.own, UNIT, atol=1e-9) and r.none == pytest.approx(0, abs=1e-9)


def test_degenerate_null_and_far_points(spark):
    line, nan = [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0], [0.0, 5.0]], float("nan")
    odd = [None, [], UNIT[:3], line, [[1.0, 1.0]] * 4, [*UNIT[:3], [nan, 0.0]]]
    rows = spark.createDataFrame([(q,) for q in odd], "q array<array<double>>")
    assert [tuple(r) for r in rows.select(h.homography("q"), h.project(h.homography("q"), F.lit(None).cast("array<array<double>>")), h.frame_error("q", "q")).collect()] == [(None, None, None)] * len(odd)
    tilted = spark.createDataFrame([([[0.0, 0.0], [4.0, 1.0], [4.0, 3.0], [0.0, 4.0]],)], "q array<array<double>>")
    m = solved([[0.0, 0.0], [4.0, 1.0], [4.0, 3.0], [0.0, 4.0]])
    far = -m[8] / m[6]  # on the line that goes to infinity
    got = tilted.select(h.project(h.homography("q"), F.array(F.array(F.lit(far), F.lit(0.0)), F.array(F.lit(0.5), F.lit(0.5))))).first()[0]
    assert got[1] is not None and (got[0] is None or max(map(abs, got[0])) > 1e9)
