"""Rollups by sketches against exact answers."""

import random

from orthoquad.operators import rollup


def test_levels_estimates_and_one_scan(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(rnd.choice(["hot"] * 6 + ["a", None]), rnd.choice([1, 2, None]), rnd.choice([rnd.gauss(0, 10), None, float("nan")] if rnd.random() < 0.05 else [rnd.gauss(0, 10)]), rnd.randint(0, 3000)) for _ in range(20_000)]
    spark.createDataFrame(rows, "k string, d int, v double, t long").repartition(6).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    found = rollup.estimates(rollup.rolled(rollup.partials(table, ["k", "d"], "v", "t"), ["k", "d"]), (0.1, 0.5, 0.9))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {(r.level, r.k, r.d): r for r in found.collect()}
    groups = {}
    for k, d, v, t in rows:
        for key in ((0, k, d), (1, k, None), (3, None, None)):
            groups.setdefault(key, []).append((v, t))
    assert set(got) == set(groups)
    for key, own in groups.items():
        values, r = sorted(v for v, _ in own if v is not None and v == v), got[key]
        assert (r.n, r.n_values, r.low, r.high) == (len(own), len(values), values[0], values[-1])
        for q, x in zip((0.1, 0.5, 0.9), r.quantiles):
            assert abs(sum(v <= x for v in values) / len(values) - q) < 0.04
        distinct = len({t for _, t in own})
        assert abs(r.distinct - distinct) <= 0.08 * distinct


def test_merged_days_equal_all_at_once_and_empty(spark):
    days = [spark.range(n).selectExpr("id % 3 AS k", "CAST(id AS DOUBLE) AS v", f"id + {n} AS t") for n in (500, 900)]
    parts = [rollup.partials(d, ["k"], "v", "t") for d in days]
    merged = rollup.estimates(rollup.merge(parts[0].unionByName(parts[1]), ["k"]))
    whole = rollup.estimates(rollup.partials(days[0].unionByName(days[1]), ["k"], "v", "t"))
    exact = lambda df: sorted((r.k, r.n, r.low, r.high, r.n_values) for r in df.collect())
    assert exact(merged) == exact(whole)
    # a union's estimate is another one than that of a sketch that saw all rows
    assert all(abs(r.distinct - r.n) <= 0.05 * r.n for df in (merged, whole) for r in df.collect())
    assert len(rollup.rolled(parts[0], ["k"], cube=True).collect()) == 4
    assert rollup.rolled(parts[0].limit(0), ["k"]).collect() == []
    nulls = rollup.estimates(rollup.partials(spark.sql("SELECT 1 AS k, CAST(NULL AS DOUBLE) AS v, CAST(NULL AS LONG) AS t"), ["k"], "v", "t")).first()
    assert (nulls.n, nulls.n_values, nulls.quantiles, nulls.distinct) == (1, 0, [None], 0)
