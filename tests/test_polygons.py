"""Overlap of quadrilaterals against exact clipping by fractions, and sizes of priors against a plain loop."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from orthoquad.functions import geometry, polygons
from orthoquad.operators import prior_sizes


def cross(a, b, p):
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def size(points):
    return sum(Fraction(p[0]) * q[1] - Fraction(q[0]) * p[1] for p, q in zip(points, points[1:] + points[:1])) / 2


def clip(a, b):
    """Exact area of the intersection: the area between the upper and lower sides, slab by slab."""
    a, b = ([tuple(map(Fraction, p)) for p in (c if size(c) >= 0 else c[::-1])] for c in (a, b))
    poly = a
    for p, q in zip(b, b[1:] + b[:1]):
        out = []
        for s, e in zip(poly, poly[1:] + poly[:1]):
            x, y = cross(p, q, s), cross(p, q, e)
            if x >= 0:
                out.append(s)
            if (x > 0 > y) or (x < 0 < y):
                t = x / (x - y)
                out.append((s[0] + (e[0] - s[0]) * t, s[1] + (e[1] - s[1]) * t))
        poly = out
    return abs(size(poly)) if len(poly) > 2 else Fraction(0)


def convex(c):
    turns = [cross(c[i], c[(i + 1) % 4], c[(i + 2) % 4]) for i in range(4)]
    return min(turns) >= 0 or max(turns) <= 0


def test_overlap_of_random_quadrilaterals(spark):
    rnd = random.Random(4)
    quad = lambda: [[rnd.randint(0, 12) * 1.0, rnd.randint(0, 12) * 1.0] for _ in range(4)]
    pool = [q for q in (quad() for _ in range(1500)) if convex(q)][:60]
    pairs = [(i, j, pool[i], pool[j]) for i in range(len(pool)) for j in range(0, len(pool), 3)]
    rows = spark.createDataFrame(pairs, "i int, j int, a array<array<double>>, b array<array<double>>")
    got = rows.select("i", "j", polygons.intersection_area("a", "b").alias("x"), polygons.intersection_area("b", "a").alias("y"), polygons.polygon_iou("a", "b").alias("iou"), geometry.intersection(geometry.bbox("a"), geometry.bbox("b")).alias("most")).collect()
    for r in got:
        a, b = pool[r.i], pool[r.j]
        want = float(clip(a, b)) if size(a) and size(b) else 0.0
        assert r.x == pytest.approx(want, abs=1e-9) and r.y == pytest.approx(want, abs=1e-9) and r.x <= r.most + 1e-9
        union = float(abs(size(a)) + abs(size(b))) - want
        assert r.iou == pytest.approx(want / union if union else 0.0, abs=1e-9) and (r.i != r.j or size(a) == 0 or r.iou == pytest.approx(1.0))
    assert sum(r.x > 0 for r in got) > 200


def test_turns_keep_overlap_and_odd_quadrilaterals_are_null(spark):
    square, nan = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]], float("nan")
    odd = [None, [], square[:3], [*square[:3], [nan, 1.0]], [*square[:3], None], [[0.0, 0.0], [4.0, 4.0], [4.0, 0.0], [0.0, 4.0]], [[0.0, 0.0], [4.0, 0.0], [1.0, 1.0], [0.0, 4.0]]]
    rows = spark.createDataFrame([(square, o) for o in odd] + [(square, [[2.0, 2.0]] * 4), (square, square[2:] + square[:2]), (square, square[::-1]), (square, [[x + 2, y + 1] for x, y in square])], "a array<array<double>>, b array<array<double>>")
    got = [r[0] for r in rows.select(polygons.polygon_iou("a", "b")).collect()]
    assert got[: len(odd)] == [None] * len(odd) and got[len(odd) :] == pytest.approx([0.0, 1.0, 1.0, 6 / 26])
    turned = rows.select(polygons.polygon_iou(geometry.rotate_points("a", F.lit(9)), geometry.rotate_points("b", F.lit(9))).alias("t"), polygons.polygon_iou("a", "b").alias("o")).where("o IS NOT NULL")
    assert all(r.t == pytest.approx(r.o) for r in turned.collect())


def near(size, of):
    common = min(size[0], of[0]) * min(size[1], of[1])
    return common / (size[0] * size[1] + of[0] * of[1] - common)


def test_sizes_of_priors_equal_a_plain_loop(spark):
    rnd = random.Random(6)
    kinds = [(10, 12), (40, 40), (90, 30)]
    sizes = [(float(w + rnd.randint(-3, 3)), float(h + rnd.randint(-3, 3))) for w, h in (rnd.choice(kinds) for _ in range(900))]
    rows = spark.createDataFrame([(x, (5.0, 7.0, 5.0 + w, 7.0 + h)) for x, (w, h) in enumerate(sizes)] + [(0, None), (1, (0.0, 0.0, 0.0, 5.0)), (2, (0.0, 0.0, float("nan"), 5.0))], "id int, box struct<x0: double, y0: double, x1: double, y1: double>").repartition(4)
    centres = prior_sizes.start(prior_sizes.counted(rows), 3, 1)
    while True:
        own = [max(range(3), key=lambda i: (near(s, centres[i]), -i)) for s in sizes]
        new = [tuple(sum(s[d] for s, o in zip(sizes, own) if o == i) / own.count(i) if i in own else centres[i][d] for d in (0, 1)) for i in range(3)]
        if max(abs(a - b) for x, y in zip(centres, new) for a, b in zip(x, y)) <= 1e-6:
            break
        centres = new
    got = prior_sizes.learn(rows, 3)
    assert [(s.width, s.height) for s in got] == [pytest.approx(c) for c in sorted(new, key=lambda c: c[0] * c[1])] and sum(s.boxes for s in got) == 900
    assert prior_sizes.learn(rows.limit(0), 3) == [] and len(prior_sizes.learn(rows.where("id = 5"), 3)) == 1
    assert prior_sizes.sides(got, (1, 2)) == {p: round((s.width * s.height) ** 0.5) for p, s in zip([(0, 0), (1, 0), (1, 1)], got)}
