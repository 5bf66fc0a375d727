"""Goldens of the record format, and properties of the geometry functions."""

import math

import pytest
from pyspark.sql import functions as F

from orthoquad.functions import geometry as g
from orthoquad.operators import dataset

SAMPLE = [[209.0, 20.0], [209.0, 200.0], [59.0, 200.0], [59.0, 20.0]]
BEFORE = [[20.0, 30.0], [200.0, 30.0], [200.0, 180.0], [20.0, 180.0]]


@pytest.fixture
def quads(spark):
    rows = [(1, 320, 240, BEFORE), (2, 240, 320, SAMPLE), (3, 100, 100, [[1.5, 2.0], [9.0, 3.0], [8.0, 9.5], [0.0, 7.0]])]
    return spark.createDataFrame(rows, "id int, width int, height int, corners array<array<double>>")


def test_rotation_golden(quads):
    row = g.to_portrait(quads).where("id = 1").first()
    assert (row.corners, row.width, row.height) == (SAMPLE, 240, 320)


def test_portrait_and_square_stay(quads):
    kept = {r.id: r for r in g.to_portrait(quads).collect()}
    assert kept[2].corners == SAMPLE and (kept[3].width, kept[3].height) == (100, 100)


def test_bbox_golden(quads):
    box = quads.where("id = 2").select(g.bbox("corners").alias("b")).first().b
    assert tuple(box) == (59, 20, 209, 200)


def test_identity_is_not_position(quads):
    row = g.to_portrait(quads).where("id = 1").first()
    least = min(row.corners, key=lambda p: (p[1], p[0]))
    assert row.corners[0] == [209, 20] and least == row.corners[3]


def test_flatten_golden_and_inverse(quads):
    flat = quads.where("id = 2").select(g.flatten_corners("corners").alias("f"))
    assert flat.first().f == [209, 20, 209, 200, 59, 200, 59, 20]
    assert flat.select(g.reshape_corners("f").alias("c")).first().c == SAMPLE


def test_reshape_of_short_rows_is_null(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), (None,)], "f array<double>")
    assert [r.c for r in rows.select(g.reshape_corners("f").alias("c")).collect()] == [None, None]


@pytest.mark.parametrize("turns", [1, 2, 3])
def test_turns_compose(quads, turns):
    once = quads
    for _ in range(turns):
        once = dataset.turn(once, 1)
    assert sorted(once.collect()) == sorted(dataset.turn(quads, turns).collect())
    assert sorted(dataset.turn(once, 4 - turns).collect()) == sorted(quads.collect())


def test_area_survives_turns(quads):
    area = lambda df: [r.a for r in df.orderBy("id").select(g.signed_area("corners").alias("a")).collect()]
    assert area(quads) == area(dataset.turn(quads, 1)) and area(quads)[1] == 27000


def test_unrotate_is_inverse(quads):
    back = quads.select(g.unrotate_points(g.rotate_points("corners", "height"), "height").alias("c"), "corners")
    assert all(r.c == r.corners for r in back.collect())


def test_iou_properties(spark):
    boxes = [(0.0, 0.0, 4.0, 4.0), (2.0, 2.0, 6.0, 6.0), (10.0, 10.0, 11.0, 11.0), (3.0, 3.0, 3.0, 3.0)]
    kind = "struct<x0:double,y0:double,x1:double,y1:double>"
    pairs = spark.createDataFrame([(a, b) for a in boxes for b in boxes], f"a {kind}, b {kind}")
    for r in pairs.select("a", "b", g.iou("a", "b").alias("i"), g.iou("b", "a").alias("j")).collect():
        assert 0 <= r.i <= 1 and r.i == r.j
        assert r.a != r.b or r.i == (1 if r.a.x1 > r.a.x0 else 0)
    assert pairs.select(g.iou("a", "b").alias("i")).collect()[1].i == pytest.approx(4 / 28)


def test_bad_corners(spark):
    rows = [(SAMPLE,), (SAMPLE[:3],), ([[math.nan, 1.0], *SAMPLE[1:]],), ([[None, 1.0], *SAMPLE[1:]],), (None,), ([[1.0], *SAMPLE[1:]],)]
    frame = spark.createDataFrame(rows, "corners array<array<double>>")
    assert [r.ok for r in frame.select(g.corners_ok("corners").alias("ok")).collect()] == [True, False, False, False, False, False]


def test_direction_and_error(quads):
    row = quads.where("id = 2").select(g.direction("corners").alias("d"), g.corner_error("corners", F.transform("corners", lambda p: F.array(p[0] + 3, p[1] + 4))).alias("e")).first()
    assert row.d == pytest.approx(math.pi / 2) and row.e == pytest.approx(5)


def test_geometry_needs_no_shuffle(quads):
    plan = g.to_portrait(quads).select(g.bbox("corners"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
