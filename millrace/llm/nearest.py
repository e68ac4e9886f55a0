"""Approximate nearest neighbours: a forest of random-projection trees.

One forest serves the whole table. Its planes are fitted on at most ``SAMPLE_ROWS``
vectors, picked by a hash of their content: a tree splits at the median along the
difference of two random vectors. Every vector is indexed by its leaf in every tree. A
query descends all trees through one shared priority queue, nearest boundary first,
until the leaves it has reached hold ``share`` of the sample, and at least ``least``
vectors where the sample is the table; as the order of that queue is the order of a
leaf's farthest boundary, the leaves are found for many queries at once. The share is
fitted to the table: PROBES vectors of the sample are searched in it by brute force, and
the share is what the queue has to hold to reach ``recall`` of their neighbours. Vectors with
structure need little of the table, directions at random most of it.

Vectors are dealt into blocks by a hash of their id, queries into chunks; each (block,
chunk) is a task. It takes queries of a leaf together and scores the vectors that they reached,
a vector and a query once: by a product for each query, or, where queries reach much of the
block, by one for all. The best of each block meet in a window per query. Inner products become angles in the trees by one added
component that makes all vectors equally long.

Equal vectors are kept once with their ``k + 1`` smallest ids, which is all that can ever
be reported of them, so a very common vector is one row.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component
take no part, nor do rows with a null id or of another length than most; an id with
several vectors has the first of them in the order of arrays; repeated rows count once;
ties go to the smaller id; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.shared import hash_sample, materialize, table

#: Trees, rows of a leaf at most, and rows of which the planes are fitted.
TREES, LEAF, SAMPLE_ROWS = 16, 64, 8192
#: Share of neighbours that the queue shall reach, by vectors of the sample that are searched to fit
#: that; least number of rows with which a query is compared.
RECALL, PROBES, LEAST = 0.95, 256, 512
BLOCK_ROWS, CHUNK_ROWS = 8192, 8192
#: Queries that a task places, and scores, at once.
AT_ONCE, TOGETHER = 512, 64
#: Share of a block's vectors below which queries are scored one by one.
SPARSE = 0.25


class Forest:
    def __init__(self, rows: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 11):
        self.normals: list[np.ndarray] = []
        self.cuts: list[float] = []
        #: Children of each node; a leaf is ~(its number).
        self.sides: list[tuple[int, int]] = []
        self.leaves = 0
        r = np.random.default_rng(seed)
        self.roots = [self._grow(rows, np.arange(len(rows)), leaf, r) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, own: np.ndarray, leaf: int, r: np.random.Generator) -> int:
        for _ in range(4 if len(own) > leaf else 0):
            a, b = r.choice(len(own), 2, replace=False)
            normal = rows[own[a]] - rows[own[b]]
            length = np.linalg.norm(normal)
            if length == 0:
                continue
            normal = normal / length
            at = rows[own] @ normal
            cut = float(np.median(at))
            left = at <= cut
            if left.all():
                continue
            node = len(self.sides)
            self.normals.append(normal)
            self.cuts.append(cut)
            self.sides.append((0, 0))
            self.sides[node] = (self._grow(rows, own[left], leaf, r), self._grow(rows, own[~left], leaf, r))
            return node
        self.leaves += 1
        return ~(self.leaves - 1)

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.zeros((len(self.roots), len(rows)), np.int32)
        todo = [(t, root, np.arange(len(rows))) for t, root in enumerate(self.roots)]
        while todo:
            t, node, own = todo.pop()
            if node < 0:
                out[t, own] = ~node
            elif len(own):
                left = rows[own] @ self.normals[node] <= self.cuts[node]
                todo += [(t, self.sides[node][0], own[left]), (t, self.sides[node][1], own[~left])]
        return out

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and leaf: how far the queue is from its front when the leaf's turn comes,
        which is the farthest boundary that the query has on the wrong side."""
        out = np.zeros((len(queries), self.leaves), np.float32)
        margin = queries @ np.array(self.normals).T - np.array(self.cuts) if self.normals else None
        todo = [(root, np.zeros(len(queries), np.float32)) for root in self.roots]
        while todo:
            node, far = todo.pop()
            if node < 0:
                out[:, ~node] = far
                continue
            m = margin[:, node].astype(np.float32)
            todo += [(self.sides[node][0], np.maximum(far, m)), (self.sides[node][1], np.maximum(far, -m))]
        return out

    def reached(self, queries: np.ndarray, placed: np.ndarray, wanted: int) -> np.ndarray:
        """For each query and leaf, whether the leaf is among the first that hold ``wanted``
        of the rows whose leaves are ``placed``."""
        bounds = self.bounds(queries)
        if wanted >= placed.shape[1]:
            return np.ones(bounds.shape, bool)
        last = np.empty(len(queries), np.float32)
        for i, own in enumerate(bounds):
            first = own[placed].min(axis=0)  # a row is found by the first tree that comes to it
            last[i] = np.partition(first, wanted - 1)[wanted - 1]
        return bounds <= last[:, None]


def longer(rows: np.ndarray, longest: float) -> np.ndarray:
    """Rows with a component that makes them ``longest`` long."""
    return np.c_[rows, np.sqrt(np.maximum(longest**2 - (rows**2).sum(1), 0))]


def scores(rows: np.ndarray, placed: np.ndarray, queries: np.ndarray, reached: np.ndarray) -> tuple[np.ndarray, int]:
    """Products of queries and the rows in leaves that they reached, -inf elsewhere; and how many
    products were made."""
    found, by_leaf = np.zeros((len(rows), len(queries)), bool), np.ascontiguousarray(reached.T)
    for own in placed:
        found |= by_leaf[own]
    out = np.full((len(queries), len(rows)), -np.inf)
    if found.mean() < SPARSE:  # each query has few rows, and others than its neighbours
        for i, own in enumerate(found.T):
            out[i, own] = rows[own] @ queries[i]
        return out, int(found.sum())
    some = np.flatnonzero(found.any(axis=1))
    out[:, some] = np.where(found[some].T, queries @ rows[some].T, -np.inf)
    return out, len(some) * len(queries)


def fitted_share(forest: Forest, sample: np.ndarray, placed: np.ndarray, k: int, recall: float) -> float:
    """The share of the sample that the queue has to hold to reach ``recall`` of the ``k`` nearest others
    of some of its vectors. ``k`` neighbours in the table are fewer in a sample of it."""
    probes = sample[:PROBES].copy()
    probes[:, -1] = 0
    near = probes[:, :-1] @ sample[:, :-1].T
    near[np.arange(len(probes)), np.arange(len(probes))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1.0
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    needed = np.empty(best.shape)
    for i, bounds in enumerate(forest.bounds(probes)):
        first = bounds[placed].min(axis=0)
        needed[i] = np.searchsorted(np.sort(first), first[best[i]], side="right") / len(sample)
    return float(np.quantile(needed, recall))


def search_block(forest: Forest, ids: list[list[int]], rows: np.ndarray, longest: float, query_ids: np.ndarray, queries: np.ndarray, reached: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query id, id, score) of the best ``k`` found in a block for each query."""
    placed, out = forest.place(longer(rows, longest)), []
    # Queries of one leaf reach much the same leaves.
    order = np.argsort(forest.place(np.c_[queries, np.zeros(len(queries))])[0], kind="stable")
    for at in range(0, len(order), TOGETHER):
        some = order[at : at + TOGETHER]
        part = queries[some]
        all_scores, _ = scores(rows, placed, part, reached[some])
        # One more than k, as the query itself may be among them; ties at the border stay.
        border = np.partition(all_scores, -k - 1, axis=1)[:, -k - 1] if len(rows) > k + 1 else np.full(len(part), -np.inf)
        slack = 1e-12 * longest * np.linalg.norm(part, axis=1)
        for q, v, own, least in zip(query_ids[some].tolist(), part, all_scores, border - slack, strict=True):
            found = np.nonzero((own >= least) & (own > -np.inf))[0]
            exact = np.einsum("ij,j->i", rows[found], v).tolist()
            near = [(-s, i) for f, s in zip(found.tolist(), exact, strict=True) for i in ids[f] if i != q]
            out += [(q, i, -s) for s, i in heapq.nsmallest(k, near)]
    return out


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v): rows that take part, as arrays of doubles."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 20, share: float | None = None, least: int = LEAST, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, id, score): for each row that ``is_query`` (an expression over the column
    "id") its ``k`` nearest others by inner product, as far as found. Without a ``share`` it is
    fitted for ``recall``."""
    spark = vectors.sparkSession
    good = usable(vectors, id_col, vector)
    schema = "query_id long, rank int, id long, score double"
    size = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return spark.createDataFrame([], schema)
    d = size.d
    good = materialize(good.where(F.size("v") == d).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    # The k + 1 smallest ids of each distinct vector; the rank limit works before the shuffle too.
    few = good.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    rows = materialize(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "distinct")
    n, longest = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    sample = longer(np.array([r.v for r in hash_sample(rows.select("v"), "v", n, SAMPLE_ROWS).collect()]), longest)
    forest = Forest(sample)
    placed = forest.place(sample)
    share = fitted_share(forest, sample, placed, -(-k * len(sample) // n), recall) if share is None else share
    wanted = min(len(sample), int(np.ceil(max(share * len(sample), least * len(sample) / n))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, AT_ONCE):
                part = b.slice(i, AT_ONCE)
                v = _matrix(part.column(1), d)
                leaves = np.packbits(forest.reached(np.c_[v, np.zeros(len(v))], placed, wanted), axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.tobytes() for x in leaves], pa.binary())], names=["id", "v", "leaves"])

    queries = materialize(good.where(is_query).select("id", "v").mapInArrow(ask, "id long, v array<double>, leaves binary"), "queries")
    blocks, chunks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-queries.count() // CHUNK_ROWS))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.select("ids", "v", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(blocks)).cast("int").alias("block"), each(chunks).alias("chunk"))
    right = queries.select("id", "v", "leaves", each(blocks).alias("block"), F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        got = []
        if a.num_rows and b.num_rows:
            leaves = np.unpackbits(np.frombuffer(b"".join(b.column("leaves").to_pylist()), np.uint8).reshape(b.num_rows, -1), axis=1, count=forest.leaves).astype(bool)
            got = search_block(forest, a.column("ids").to_pylist(), _matrix(a.column("v"), d), longest, b.column("id").to_numpy(), _matrix(b.column("v"), d), leaves, k)
        return pa.table({"query_id": pa.array([g[0] for g in got], pa.int64()), "id": pa.array([g[1] for g in got], pa.int64()), "score": pa.array([g[2] for g in got], pa.float64())})

    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(run, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector among all others."""
    found = nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
