"""Every evaluation query against its SQL, and the entry module without the optional subpackage."""

import glob
import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from millrace.plans import run_queries as Q

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(cols, data):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 6) if isinstance(v, float) else v

    return sorted(repr([plain(r[c]) for c in cols]) for r in data)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query(spark, sf_dir, db, name):
    got = Q.QUERIES[name](spark, sf_dir)
    rel = db.sql(Q.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    assert rows(cols, [r.asDict() for r in got.collect()]) == rows(cols, [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()])


def test_states_of_samples_that_lack_steps(spark, tmp_path):
    vectors = [(i, [math.sin(i * 64 + k) for k in range(64)]) for i in (*range(10), *range(11, 16), *range(20, 30))]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = Q.QUERIES["state_tables"](spark, str(tmp_path))
    rel = con.sql(Q.SQL["state_tables"])
    assert rows(rel.columns, [r.asDict() for r in got.collect()]) == rows(rel.columns, [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_without_sql(spark, sf_dir, name):
    assert Q.QUERIES[name](spark, sf_dir).count() > 0


def test_without_the_optional_part(tmp_path):
    for f in ("millrace", "__spark_entry__.py"):
        src = os.path.join(ROOT, f)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / f)
    shutil.rmtree(tmp_path / "millrace" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'label_all' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
