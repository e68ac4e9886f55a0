"""Whitening: exact integers, and the same numbers as a plain computation with Python's integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries as Q
from millrace.llm import whiten as W

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows):
    """(x, deviations, eigenvalues, components, trace), with Python's integers up to the division."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in np.asarray(v, np.float32)] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    deviations = [sum((n * r[k] - sums[k]) ** 2 for k in range(d)) for r in x]
    centred = [[n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    cov = np.array([[c / (n * n) for c in r] for r in centred])
    values, vectors = np.linalg.eigh(cov)
    return x, sums, deviations, values[::-1], vectors[:, ::-1], float(np.trace(cov))


def check(got, rows, k):
    x, sums, deviations, values, vectors, trace = brute(rows)
    n = len(rows)
    assert len(got) == n * k
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(k):
        w = np.array([[x[i][j] - sums[j] / n for j in range(len(sums))] for i in range(n)]) @ vectors[:, c] / math.sqrt(values[c])
        own = np.array([by[i, c + 1].whitened for i, _ in rows])
        assert np.allclose(own, w, atol=1e-8) or np.allclose(own, -w, atol=1e-8)
        assert all(by[i, c + 1].deviation == dev and by[i, c + 1].n == n for (i, _), dev in zip(rows, deviations, strict=True))
        assert all(math.isclose(by[i, c + 1].explained, values[c] / trace, rel_tol=1e-9) for i, _ in rows)
    assert {r.identity_error for r in got} and max(r.identity_error for r in got) < 1e-8


def result(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return Q.QUERIES["op13_whitening"](spark, str(tmp_path)).collect()


def test_against_plain_integers(spark, tmp_path):
    rng = np.random.default_rng(3)
    basis = rng.normal(size=(12, 12)) * np.geomspace(2, 0.05, 12)[:, None]
    rows = [(i, [float(c) for c in (rng.normal(size=12) @ basis).astype(np.float32)]) for i in range(300)]
    check(result(spark, tmp_path, rows), rows, 8)
    odd = [(900, None), (901, [None, *rows[0][1][1:]]), (902, [float("nan")] * 12), (903, [float("inf"), *rows[0][1][1:]]), (904, [1.0, 2.0]), (905, [])]
    check(result(spark, tmp_path, rows + odd), rows, 8)


def test_fewer_components_than_eight(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in (a, b, 0.5)]) for i, (a, b) in enumerate(rng.normal(size=(50, 2)).astype(np.float32))]
    check(result(spark, tmp_path, rows), rows, 2)
    assert result(spark, tmp_path, [(1, [0.5, 1.0])]) == [] and result(spark, tmp_path, [(1, [0.5, 1.0])] * 4) == []
    assert result(spark, tmp_path, [(1, None)]) == []


def test_given_vectors(spark, sf_dir):
    got = Q.QUERIES["op13_whitening"](spark, sf_dir).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(got, rows, 8)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [3.0, -1.0]), (4, [0.1, 0.2])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("_y", "id", "n", "d", "deviation", "whitened")})
    white, model, error = W.whiten(df)
    assert model.n == 4 and white.count() == 4 and white.where("id IS NULL").count() == 1 and error < 1e-9


def test_residues_give_exact_integers():
    rng = np.random.default_rng(5)
    for size in (3, 10_000, 2**40, 2**62):
        y = rng.integers(-size, size, (500, 5))
        y[0] = size
        primes = W.primes_beyond(2 * len(y) * size * size)
        got = W.from_residues(W.residue_products(y, primes))
        ones = np.hstack([y.astype(object), np.ones((500, 1), object)])
        assert (got == ones.T @ ones).all() and len(set(primes)) == len(primes) >= 2
    assert all((p - 1) ** 2 * W.BLOCK_ROWS <= 2**53 for p in W.primes_beyond(2**200))


@pytest.mark.parametrize("scale", [1.0, 1e9, 3e38])
def test_large_entries(spark, scale):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in (rng.normal(size=3) * scale).clip(-3e38, 3e38).astype(np.float32)]) for i in range(40)]
    white, model, error = W.whiten(spark.createDataFrame(rows, SCHEMA))
    limit = 2**63 - 1
    y = [[max(-limit - 1, min(limit, math.floor(1024 * float(np.float32(c))))) for c in v] for _, v in rows]
    sums = [sum(r[k] for r in y) for k in range(3)]
    want = {i: sum((40 * r[k] - sums[k]) ** 2 for k in range(3)) for (i, _), r in zip(rows, y, strict=True)}
    assert model.sums == sums and error < 1e-6
    for r in white.collect():
        assert r.deviation == want[r.id] if want[r.id] < 10**38 else r.deviation is None
