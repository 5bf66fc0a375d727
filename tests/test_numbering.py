"""Dense numbering against plain enumeration."""

import random

from pyspark.sql import functions as F

from orthoquad.operators.numbering import number


def test_groups_ties_nulls_and_a_hot_group(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.choice([None, *range(50)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, `g.x` string, k int")
    got = {r["id"]: r["no"] for r in number(df, ["k", "id"], ["g.x"], "no").collect()}
    want = {}
    for g in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        want |= {r[0]: i for i, r in enumerate(own)}
    assert got == want


def test_without_groups_and_descending(spark):
    df = spark.range(1000).repartition(7)
    assert all(r["id"] == 999 - r["index"] for r in number(df, [F.desc("id")]).collect())
    assert number(df.limit(0), ["id"]).collect() == []


def test_equal_rows_get_all_numbers(spark):
    df = spark.createDataFrame([(None, 1)] * 40 + [("x", 1)] * 3, "g string, k int")
    got = sorted((r["g"] or "", r["index"]) for r in number(df, ["k"], ["g"]).collect())
    assert got == [("", i) for i in range(40)] + [("x", i) for i in range(3)]


def test_no_task_sees_all_rows(spark):
    rows = spark.range(100).withColumn("g", F.col("id") % 3)
    plan = number(rows, ["id"], ["g"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
