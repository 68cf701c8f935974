"""Every query with SQL is held against it on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        path = f"{FOLDER}/{f}" + ("/*.parquet" if os.path.isdir(f"{FOLDER}/{f}") else "")
        c.execute(f"create view {f.split('.')[0]} as select * from '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v if v is None or isinstance(v, (str, int, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, db, name):
    df = catalog.queries()[name](spark, FOLDER)
    cur = db.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    cols = sorted(df.columns)
    assert cols == sorted(names)
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["calculations", "clean_report", "table_chunks", "image_chunks", "table_roundtrip", "mmr_filtered"])
def test_runs(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0


def test_a_removed_table_is_made_again(spark):
    from quillspark.session import discard

    first = catalog.collection(spark, FOLDER)
    assert catalog.collection(spark, FOLDER) is first
    discard(first)
    assert catalog.collection(spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["bm25_topk", "lexical_topk", "bm25_filtered", "hybrid_topk", "hybrid_filtered", "rerank_topk"])
def test_scored_pairs_are_not_exchanged(spark, name):
    plan = catalog.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "partial_sum" not in plan


def test_context_leaves_pairs_and_texts_where_they_are(spark):
    plan = catalog.queries()["context_blocks"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "partial_sum" not in plan
