"""Every query with SQL against DuckDB on the smallest tables, and the entry point."""

import sys
import warnings

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from orthoquad.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)


def test_zeros_have_the_sign_that_sql_gives(spark, duck):
    got = [repr((r["event_id"], r["tilt"], r["middle"])) for r in catalog.code_frames(spark, SF).collect()]
    want = [repr(r[:3]) for r in duck.sql(f"SELECT event_id, tilt, middle FROM ({catalog.ORACLE_SQL['code_frames']})").fetchall()]
    assert sorted(got) == sorted(want) and "-0.0" in "".join(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 1000


def test_base_queries_do_without_the_corpus_operators(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("orthoquad.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert set(entry.queries()) == set(catalog.QUERIES) and entry.oracle_sql() == catalog.ORACLE_SQL
