"""As-of join against a scan per row."""

import random

from pyspark.sql import functions as F

from orthoquad.operators.asof import asof_join


def plain(left, right, within=None):
    out = []
    for i, k, t in left:
        near = [(u, n) for n, g, u in right if None not in (k, t, g, u) and g == k and u <= t]
        u, n = max(near, default=(None, None))
        out.append((i, k, t, n if u is not None and (within is None or u >= t - within) else None))
    return sorted(out, key=repr)


def joined(spark, left, right, within=None):
    a = spark.createDataFrame(left, "i int, `k.x` string, t int").repartition(5)
    b = spark.createDataFrame(right, "n int, `k.x` string, t int").repartition(3)
    found = asof_join(a, b, ["k.x"], "t", ["n"], ["n"], None if within is None else F.lit(within))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_hot_key_ties_nulls_and_ages(spark):
    rnd = random.Random(8)
    key = lambda: rnd.choice(["hot"] * 8 + ["a", "b", None])
    left = [(i, key(), rnd.choice([None, *range(300)])) for i in range(800)]
    right = [(n, key(), rnd.choice([None, *range(0, 300, 7)])) for n in range(200)]
    assert joined(spark, left, right) == plain(left, right)
    assert joined(spark, left, right, 10) == plain(left, right, 10)


def test_matches_are_carried_over_ranges(spark):
    left = [(i, "hot", i) for i in range(2000)]
    assert joined(spark, left, [(1, "hot", 3), (2, "cold", 5)]) == sorted(((i, "hot", i, 1 if i >= 3 else None) for i in range(2000)), key=repr)


def test_empty_sides_and_repeated_rows(spark):
    assert joined(spark, [], [(1, "a", 1)]) == []
    assert joined(spark, [(1, "a", 1)] * 3, []) == [(1, "a", 1, None)] * 3
    assert joined(spark, [(1, "a", 1)] * 3, [(5, "a", 1)] * 2) == [(1, "a", 1, 5)] * 3
