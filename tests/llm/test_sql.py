"""Queries that SQL can express, row for row."""

import glob
import os

import duckdb
import pytest

from millrace.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_like_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, rel = Q.QUERIES[name](spark, sf_dir), con.sql(Q.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert sorted(repr([r[c] for c in cols]) for r in got.collect()) == sorted(repr([r[c] for c in cols]) for r in want)


def test_every_operator_has_its_query():
    assert sorted(int(q[2:].split("_")[0]) for q in Q.QUERIES) == list(range(1, 14))
