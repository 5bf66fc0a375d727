"""Hard negatives against all pairs, and bounds against scores."""

import math
import random

import numpy as np
import pytest

from orthoquad.llm import hard_negatives as hn

TOP = 2**63 - 1


def plain(rows, modulus, k=5, percent=80, scale=256):
    """anchor_id, positive_id, rank, negative_id and both scores; ids may repeat."""
    use = [(i, g, tuple(max(-(2**62), min(2**62, math.floor(scale * x))) for x in v)) for i, g, v in rows if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: max(-TOP, min(TOP, sum(x * y for x, y in zip(a, b))))
    out = []
    for i, g, v in {r for r in use if r[0] % modulus == 0}:
        order = lambda same: sorted(((-score(v, w), j) for j, h, w in use if j != i and (h == g) == same))
        negatives = order(False)
        for p, pid in order(True)[:k]:
            inside = [(s, j) for s, j in negatives if percent * -p <= 100 * -s <= 100 * -p][:k]
            out += [(i, pid, r, j, -p, -s) for r, (s, j) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, modulus):
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").selectExpr("*", "1 AS _id", "'a' AS rank", "2 AS score").repartition(3)
    return sorted(tuple(r) for r in hn.mine(df, anchor_modulus=modulus).collect())


def vectors(n, width, spread, seed=0):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    return [(i, rnd.choice(["hot"] * 5 + ["a", "b", "c"]), [c + rnd.gauss(0, spread) for c in rnd.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize(("width", "spread", "blocks"), [(7, 0.4, (40, 4)), (16, 1.0, (16_384, 1024)), (1, 0.1, (64, 2))])
def test_against_all_pairs(spark, monkeypatch, width, spread, blocks):
    monkeypatch.setattr(hn, "BLOCK", blocks[0])
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", blocks[1])
    rows = vectors(300, width, spread)
    want = plain(rows, 20)
    assert mined(spark, rows, 20) == want and len(want) > 50


def test_pieces_meet_where_tasks_are_not_merged(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = vectors(300, 7, 0.4)
        assert mined(spark, rows, 20) == plain(rows, 20)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows(spark):
    rows = vectors(60, 4, 0.3, 1)
    rows += [(None, "a", [1.0] * 4), (80, None, [1.0] * 4), (100, "a", None), (120, "a", [1.0, None, 0.0, 0.0]), (140, "b", [math.nan] * 4), (160, "b", [math.inf, 0.0, 0.0, 0.0])]
    rows += [(180, "a", [0.5]), (180, "a", [0.5]), (180, "b", [0.5, 0.5]), (181, "a", []), (182, "b", [0.5, 0.0, 0.0, 0.0]), (183, "a", [0.0] * 4), (200, "zero", [0.0] * 4), (201, "zero", [0.0] * 4)]
    assert mined(spark, rows, 20) == plain(rows, 20)
    assert mined(spark, [], 20) == [] and mined(spark, [(20, "a", [1.0])], 20) == []


def test_scores_beyond_64_bits(spark):
    rows = [(0, "a", [1e15, 3.0]), (1, "a", [1e14, 1.0]), (2, "b", [0.9e14, 7.0]), (3, "b", [1e300, 0.0]), (4, "a", [1e300, 0.0]), (5, "b", [-1e300, 1e300]), (6, "b", [1e14, 0.996]), (7, "a", [1e6, 0.1]), (8, "b", [1e6, 0.0])]
    assert mined(spark, rows, 100) == plain(rows, 100)


def test_bounds_hold_and_prune(spark):
    rng = np.random.default_rng(3)
    points = np.floor(256 * (rng.normal(size=(4, 9))[rng.integers(0, 4, 2000)] + rng.normal(size=(2000, 9)) * 0.3)).astype(np.int64)
    edges = hn.marks(points[:500], points.min(axis=0), points.max(axis=0))
    codes = hn.encode(points, edges)
    low, high = hn.score_bounds(points[:20], codes, edges, 0.0)
    exact = points @ points[:20].T
    assert (low <= exact).all() and (exact <= high).all()
    assert np.mean([(high[:, j] >= hn.kth(low[:, j], 5)).mean() for j in range(20)]) < 0.2
