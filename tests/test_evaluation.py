"""Detection evaluation against a plain greedy assignment and its curve."""

import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from orthoquad.operators import evaluation

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"


def iou(a, b):
    i = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
    return i / u if u else 0.0


def plain(predicted, truth, threshold):
    hits, n = Counter(), Counter(p[2] for p in predicted)
    free = {}
    for image, t, box in truth:
        free.setdefault(image, {})[t] = box
    for image, _, score, box in sorted(predicted, key=lambda p: (-p[2], p[1])):
        near = [(-iou(box, b), t) for t, b in free.get(image, {}).items() if iou(box, b) >= threshold]
        if near:
            del free[image][min(near)[1]]
            hits[score] += 1
    points, a, h = [], 0, 0
    for s in sorted(n, reverse=True):
        a, h = a + n[s], h + hits[s]
        points.append((s, a, h, h / a, h / len(truth)))
    average = sum(p * hits[s] / len(truth) for s, _, _, p, _ in points)
    return points, average


def frames(spark, predicted, truth):
    return spark.createDataFrame(predicted, f"image string, prediction_id long, score double, box {BOX}").repartition(5), spark.createDataFrame(truth, f"image string, truth_id long, box {BOX}").repartition(3)


def made(seed, n):
    rnd = random.Random(seed)
    box = lambda: (x := rnd.randint(0, 60) * 1.0, y := rnd.randint(0, 60) * 1.0, x + rnd.randint(5, 25), y + rnd.randint(5, 25))
    image = lambda: rnd.choice(["hot"] * 4 + list("abcdef"))
    return [(image(), i, rnd.randint(0, 30) / 10, box()) for i in range(n)], [(image(), i, box()) for i in range(n // 3)]


def test_curve_and_average_against_plain(spark):
    predicted, truth = made(1, 600)
    points, average = evaluation.evaluate(*frames(spark, predicted, truth), Fraction(3, 10))
    want, want_average = plain(predicted, truth, 0.3)
    got = sorted(((r.score, r.n, r.hits, r.precision, r.recall) for r in points.collect()), reverse=True)
    assert len(got) == len(want) and want[-1][2] > 50
    for a, b in zip(got, want):
        assert a == pytest.approx(b)
    assert average.first()[0] == pytest.approx(want_average)
    plan = points._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_a_truth_is_given_once_and_ties_go_to_smaller_ids(spark):
    one = (0.0, 0.0, 10.0, 10.0)
    p, t = frames(spark, [("a", 2, 1.0, one), ("a", 1, 1.0, one), ("b", 3, 2.0, one)], [("a", 9, one), ("a", 8, (0.0, 0.0, 10.0, 4.0))])
    got = {r.prediction_id: r.truth_id for r in evaluation.assign(p, t, Fraction(1, 2)).collect()}
    assert got == {1: 9, 2: None, 3: None}


def test_unusable_rows_and_empty_tables(spark):
    one, nan = (0.0, 0.0, 10.0, 10.0), float("nan")
    odd = [(None, 1, 1.0, one), ("a", None, 1.0, one), ("a", 2, nan, one), ("a", 3, 1.0, None), ("a", 4, 1.0, (0.0, None, 1.0, 1.0)), ("a", 5, 1.0, (3.0, 0.0, 1.0, 1.0)), ("a", 6, 0.5, one)]
    p, t = frames(spark, odd, [(None, 1, one), ("a", None, one), ("a", 2, None), ("a", 3, one)])
    points, average = evaluation.evaluate(p, t, Fraction(1, 2))
    assert [(r.score, r.n, r.hits, r.recall) for r in points.collect()] == [(0.5, 1, 1, 1.0)] and average.first()[0] == 1.0
    points, average = evaluation.evaluate(p.limit(0), t, Fraction(1, 2))
    assert points.count() == 0 and average.first()[0] == 0.0
    points, average = evaluation.evaluate(p, t.where(F.lit(False)), Fraction(1, 2))
    assert [(r.n, r.hits, r.recall) for r in points.collect()] == [(1, 0, None)] and average.first()[0] is None
