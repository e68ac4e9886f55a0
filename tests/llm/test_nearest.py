import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import nearest as N


def brute(rows, queries, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q in queries:
        s = x @ x[np.nonzero(ids == q)[0][0]]
        out[q] = sorted(((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != q))[:k]
    return out


@pytest.mark.parametrize("block", [8192, 150])
def test_recall(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK_ROWS", block)
    monkeypatch.setattr(N, "CHUNK_ROWS", 20)
    r = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(600, 16)) * r.uniform(0.5, 2, (600, 1)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = N.nearest(df, F.col("id") % 20 == 0, k=10).collect()
    truth = brute(rows, range(0, 600, 20), 10)
    by = {}
    for g in got:
        by.setdefault(g.query_id, []).append(g)
    hit = [len({g.id for g in by[q]} & {i for _, i in truth[q]}) / 10 for q in truth]
    assert np.mean(hit) >= 0.9
    for q, own in by.items():
        own.sort(key=lambda g: g["rank"])
        assert [g["rank"] for g in own] == list(range(1, 11))
        assert [(-g.score, g.id) for g in own] == sorted((-g.score, g.id) for g in own)
        assert all(abs(g.score - np.dot(rows[q][1], rows[g.id][1])) < 1e-12 for g in own)


def test_recall_of_a_small_share(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 700)
    monkeypatch.setattr(N, "SAMPLE_ROWS", 900)
    r = np.random.default_rng(6)
    centres = r.normal(size=(40, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(centres[r.integers(0, 40, 2000)] + 0.2 * r.normal(size=(2000, 24)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    truth = brute(rows, range(0, 2000, 20), 10)
    got = {}
    for g in N.nearest(df, F.col("id") % 20 == 0, k=10, least=0).collect():
        got.setdefault(g.query_id, set()).add(g.id)
    assert np.mean([len(got[q] & {i for _, i in t}) / 10 for q, t in truth.items()]) >= 0.9


def test_leaves_are_reached_in_the_order_of_the_queue():
    r = np.random.default_rng(7)
    rows, queries = r.normal(size=(500, 8)), r.normal(size=(20, 8))
    forest = N.Forest(rows, trees=4, leaf=16)
    placed = forest.place(rows)
    for wanted in (1, 60, 200, 500):
        reached = forest.reached(queries, placed, wanted)
        for q, own in zip(queries, reached, strict=True):
            # One heap for all trees, nearest boundary first.
            heap, seen, leaves = [(0.0, root) for root in forest.roots], set(), set()
            while heap and len(seen) < wanted:
                far, node = heapq.heappop(heap)
                while node >= 0:
                    m = float(q @ forest.normals[node] - forest.cuts[node])
                    near, other = forest.sides[node][::-1] if m > 0 else forest.sides[node]
                    heapq.heappush(heap, (max(far, abs(m)), other))
                    node = near
                leaves.add(~node)
                seen |= set(np.nonzero((placed == ~node).any(axis=0))[0].tolist())
            # Leaves as far as the last one are reached with it.
            far = forest.bounds(q[None])[0]
            want = far <= max(far[list(leaves)])
            assert (own == want).all() or wanted == len(rows)


def test_an_id_with_two_vectors_is_settled_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, N.nearest(df, F.col("id") % 20 == 0).collect())) == [(0, 1, 1, 1.0), (0, 2, 2, 0.5)]


def test_defined_cases(spark, clash):
    one = [1.0, 0.0]
    rows = [(0, one), (0, one), *((i, one) for i in range(1, 40)), (40, [0.0, 1.0]), (41, None), (42, [0.0, 0.0]), (43, [float("nan"), 1.0]), (44, [float("inf"), 1.0]), (45, [None, 1.0]), (46, []), (47, [1.0, 2.0, 3.0]), (None, one), (60, [0.5, 0.5])]
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {}
    for r in N.nearest(df, F.col("id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.score)
    assert set(got) == {0, 20, 40, 60}
    assert [got[0][k][0] for k in range(1, 21)] == list(range(1, 21))
    assert [got[20][k][0] for k in range(1, 21)] == list(range(20))
    assert got[40][1] == (60, 0.5)
    assert N.nearest(df.limit(0), F.col("id") % 20 == 0).collect() == []
    two = spark.createDataFrame([(0, one), (1, one)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in N.nearest(two, F.col("id") % 20 == 0).collect()] == [(0, 1, 1, 1.0)]


def test_query_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    truth = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    got = {}
    for r in N.op6_nearest(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {i for _, i in t}) / 20 for q, t in truth.items()]) >= 0.9


def searched(x, k=20, every=20):
    """(recall, products made as a share of all) of the trees over a matrix, in blocks."""
    r = np.random.default_rng(0)
    longest = np.sqrt((x**2).sum(1).max())
    sample = N.longer(x[r.permutation(len(x))[: N.SAMPLE_ROWS]], longest)
    forest = N.Forest(sample)
    placed = forest.place(sample)
    share = N.fitted_share(forest, sample, placed, -(-k * len(sample) // len(x)), N.RECALL)
    wanted = min(len(sample), int(np.ceil(max(share * len(sample), N.LEAST * len(sample) / len(x)))))
    at = np.arange(0, len(x), every)[:400]
    queries = x[at]
    reached = forest.reached(np.c_[queries, np.zeros(len(at))], placed, wanted)
    order = np.argsort(forest.place(np.c_[queries, np.zeros(len(at))])[0], kind="stable")
    best, made = [[] for _ in at], 0
    for b in range(0, len(x), N.BLOCK_ROWS):
        rows = x[b : b + N.BLOCK_ROWS]
        leaves = forest.place(N.longer(rows, longest))
        for k0 in range(0, len(order), N.TOGETHER):
            some = order[k0 : k0 + N.TOGETHER]
            got, n = N.scores(rows, leaves, queries[some], reached[some])
            made += n
            for q, s in zip(some, got, strict=True):
                best[q] += [(-v, b + j) for j, v in enumerate(s) if v > -np.inf and b + j != at[q]]
    hits = []
    for q, own in zip(at, best, strict=True):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len({j for _, j in heapq.nsmallest(k, own)} & set(np.argsort(-s, kind="stable")[:k].tolist())) / k)
    return np.mean(hits), made / (len(at) * len(x))


@pytest.mark.parametrize("n", [500, 2000, 10_000, 50_000])
@pytest.mark.parametrize("kind", ["plain", "clustered"])
def test_recall_and_products_by_size(n, kind):
    r = np.random.default_rng(n)
    if kind == "plain":
        x = r.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1)[:, None]
    else:
        centres = r.normal(size=(max(4, n // 50), 64))
        x = centres[r.integers(0, len(centres), n)] + 0.2 * r.normal(size=(n, 64))
    recall, made = searched(x)
    print(n, kind, round(recall, 3), round(made, 3))
    assert recall >= 0.9
    assert kind == "plain" or n <= 2000 or made < 0.5
