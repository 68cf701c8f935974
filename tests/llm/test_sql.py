"""The queries that SQL can express, held against it on the smallest tables."""

import os

import duckdb
import pytest

from quillspark.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(FOLDER):
        path = f"{FOLDER}/{f}" + ("/*.parquet" if os.path.isdir(f"{FOLDER}/{f}") else "")
        db.execute(f"create view {f.split('.')[0]} as select * from '{path}'")
    df = queries.queries()[name](spark, FOLDER)
    cur = db.execute(queries.oracle_sql()[name])
    assert df.columns == [x[0] for x in cur.description]
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())


def test_every_problem_has_its_query():
    names = queries.queries()
    assert {f"p{i}_found" for i in range(1, 11) if i != 9} | {"p9_mix"} <= set(names)
