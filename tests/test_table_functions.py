"""The table function of suppression, from SQL."""

import pytest

from orthoquad.plans import table_functions


def test_suppress_from_sql(spark):
    table_functions.register(spark)
    rows = [("a", 1, 3.0, 0, 0, 10, 10), ("a", 2, 2.0, 1, 1, 10, 10), ("a", 3, 1.0, 20, 20, 30, 30), ("b", 4, 1.0, 0, 0, 10, 10), ("b", 5, None, 0, 0, 9, 9), (None, 6, 1.0, 0, 0, 1, 1), ("b", 7, 0.5, 5, 0, 4, 9), ("c", 8, 1.0, 0, 0, 3_000_000_000, 3_000_000_000), ("c", 9, 0.5, 0, 0, 3_000_000_000, 2_999_999_999)]
    spark.createDataFrame(rows, "image string, id int, score double, x0 long, y0 long, x1 long, y1 long").repartition(3).createOrReplaceTempView("boxes")
    found = spark.sql("SELECT * FROM suppress(TABLE(boxes), 1, 2)")
    assert found.dtypes == [("image", "string"), ("id", "int")]
    assert sorted(tuple(r) for r in found.collect()) == [("a", 1), ("a", 3), ("b", 4), ("c", 8)]
    assert spark.sql("SELECT * FROM suppress(TABLE(SELECT * FROM boxes WHERE false), 1, 2)").collect() == []


@pytest.mark.parametrize(("call", "error"), [("suppress(TABLE(SELECT 1 AS image), 1, 2)", "lacks id"), ("suppress(TABLE(boxes), 3, 2)", "from 0 to 1")])
def test_wrong_arguments_are_told_when_the_query_is_analyzed(spark, call, error):
    table_functions.register(spark)
    spark.range(0).selectExpr("'a' AS image", "id", "1D AS score", "1 AS x0", "1 AS y0", "1 AS x1", "1 AS y1").createOrReplaceTempView("boxes")
    with pytest.raises(Exception, match=error):
        spark.sql(f"SELECT * FROM {call}")
