"""SimHash near-duplicates with vantage-point trees.

Fingerprints are 64-bit SimHashes of word shingles. Distinct fingerprints are
dealt to shards by the upper levels of a vantage-point tree (fitted on a bounded
sample, applied to every fingerprint); a fingerprint near the boundary of a shard
is also sent there as a query, so that no close pair is lost. Inside a shard a
vantage-point tree finds the exact pairs, and only a spanning forest of them
leaves the task; a dense shard is compared in blocks. Components come from distributed min-label propagation.

Defined results: a null text has no words; no words give fingerprint zero, which
links like any other; repeated rows share a fingerprint; a component without any
non-null id has a null id; an empty table gives an empty result; other columns of
the input are left alone (``simhash_components`` returns only its own columns).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import Scratch, free_name, hash_sample, materialize, table, text_digest

#: Fingerprints of which the upper levels of the tree are fitted.
SAMPLE = 8192
#: Fingerprints that a shard owns, about; the tree has at most LEVELS levels, as many as its sample fits.
SHARD, LEVELS = 2048, 12
#: Rows of a shard, or of a block of its points or queries, that one task takes.
DENSE = 1 << 17
#: Points below which a node is compared directly.
LEAF = 192
#: Texts with a hash in common above which not every two of them meet at once.
MEET = 64
#: How often hashes of many texts are looked for and put last; of these, how many go to every task;
#: texts of one crowd, about, in a block.
ROUNDS, CROWDED, CELL = 3, 1 << 20, 2048
#: Texts of a crowd that are out of the common run, up to which they go to all its blocks.
STAR = 1 << 13
#: Partners that a text of a crowd is compared with before all others.
BEST = 4
#: Rows that go to Python at once: a row may hold two whole sets.
ROWS = "1024"
#: Texts of candidate pairs, up to which their keys go to every task; above it the sets are shuffled.
ASKED = 1 << 18
#: Texts that a task remembers.
REMEMBERED = 1 << 17
_UNITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of one text: words are runs of non-blank bytes after lower-casing A-Z."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    counts, n, block = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for gram in grams:
        block.append(digest(gram, seed))
        if len(block) == 65536:
            counts, n, block = counts + _bit_counts(block), n + len(block), []
    if block:
        counts, n = counts + _bit_counts(block), n + len(block)
    return int(_UNITS[counts * 2 > n].sum(dtype=np.uint64))


def _bit_counts(hashes: list[int] | np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def add_fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every row, as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint((t or "").encode(), width) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class ShardTree:
    """Upper levels of a vantage-point tree: (vantage point, radius) per inner node in
    heap order. A point goes left where its distance is at most the radius."""

    def __init__(self, points: np.ndarray, levels: int):
        self.levels = levels
        self.pivot = np.zeros(2**levels, np.uint64)
        self.radius = np.full(2**levels, 64, np.int16)
        todo = [(1, np.sort(points))] if levels else []
        while todo:
            node, own = todo.pop()
            if len(own) == 0:
                continue
            pivot, radius = _best_vantage(own)
            self.pivot[node], self.radius[node] = pivot, radius
            if node * 2 < 2**levels:
                d = distance(own, pivot)
                todo += [(node * 2, own[d <= radius]), (node * 2 + 1, own[d > radius])]

    def route(self, points: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point index, shard, owned): one owned row per point, and a query row for each
        further shard that may hold a point at most ``within`` away. A pair astride a
        boundary is found from its left point, so right points are not sent left."""
        index, node = np.arange(len(points)), np.ones(len(points), np.int64)
        own = np.ones(len(points), bool)
        for _ in range(self.levels):
            d = distance(points[index], self.pivot[node])
            right = d > self.radius[node]
            # An owned left point, or any query, near the boundary looks right as well;
            # only a query that came from elsewhere may also look left.
            both = np.where(own, ~right & (d + within > self.radius[node]), np.where(right, d - within <= self.radius[node], d + within > self.radius[node]))
            home = node * 2 + right
            other = node[both] * 2 + ~right[both]
            index, node, own = np.r_[index, index[both]], np.r_[home, other], np.r_[own, np.zeros(both.sum(), bool)]
        return index, node, own


def _best_vantage(own: np.ndarray) -> tuple[np.uint64, int]:
    """Of a few candidates, the one whose median ring holds the fewest points."""
    best = (2.0, own[0], 64)
    for c in own[np.linspace(0, len(own) - 1, 8).astype(int)]:
        d = distance(own, c)
        r = int(np.median(d))
        near = float(np.mean(np.abs(d - r) <= 1)) + abs(float(np.mean(d <= r)) - 0.5)
        best = min(best, (near, c, r), key=lambda x: x[0])
    return best[1], best[2]


def near_pairs(points: np.ndarray, queries: np.ndarray, within: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query index, point index) pairs at most ``within`` apart, from a vantage-point tree
    over ``points`` that all queries descend together."""
    todo = [(np.arange(len(points)), np.arange(len(queries)))]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        d = None
        if len(p) > LEAF:
            pivot, r = _best_vantage(points[p])
            d = distance(points[p], pivot)
        if d is None or (d <= r).all() or (d > r).all():
            for k in range(0, len(q), 4096):
                i, j = np.nonzero(np.bitwise_count(queries[q[k : k + 4096], None] ^ points[p][None, :]) <= within)
                yield q[k : k + 4096][i], p[j]
            continue
        dq = distance(queries[q], pivot)
        todo.append((p[d <= r], q[dq - within <= r]))
        todo.append((p[d > r], q[dq + within > r]))


class Forest:
    """Union-find over arrays of pairs, which keeps the edges that joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def _roots(self) -> np.ndarray:
        while True:
            top = self.up[self.up]
            if (top == self.up).all():
                return top
            self.up = top

    def _find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join pairs; only those of different trees are gone through one by one."""
        while True:
            root = self._roots()
            apart = np.nonzero(root[a] != root[b])[0]
            if not len(apart):
                return
            # One pair of each two trees is enough.
            low, high = np.minimum(root[a[apart]], root[b[apart]]), np.maximum(root[a[apart]], root[b[apart]])
            first = np.unique(low * len(root) + high, return_index=True)[1]
            a, b = a[apart[first]], b[apart[first]]
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                x, y = self._find(i), self._find(j)
                if x != y:
                    self.up[max(x, y)] = min(x, y)
                    self.edges.append((i, j))


def _shard_edges(fps: np.ndarray, points: np.ndarray, queries: np.ndarray, within: int) -> np.ndarray:
    """Spanning forest of the close pairs of a shard's points and queries (indexes into ``fps``)."""
    forest = Forest(len(fps))
    for q, p in near_pairs(fps[points], fps[queries], within):
        forest.join(queries[q], points[p])
    return np.array(forest.edges, np.int64).reshape(-1, 2)


def link_edges(distinct_fps: DataFrame, within: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that are at most ``within`` bits apart;
    a spanning forest per shard, which connects whatever all pairs would connect.

    ``distinct_fps``: column fp, read several times (pass a stored table).
    """
    spark = distinct_fps.sparkSession
    n = distinct_fps.count()
    levels = max(0, int(np.ceil(np.log2(max(1, n) / SHARD))))
    # A sample by a hash order that no property of the text follows; bounded by SAMPLE rows.
    picked = np.array([r.fp for r in hash_sample(distinct_fps.select("fp"), "fp", n, SAMPLE).collect()], np.int64).view(np.uint64)
    tree = ShardTree(picked, min(levels, LEVELS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            i, shard, own = tree.route(fps, within)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fps[i].view(np.int64)), pa.array(own)], names=["shard", "fp", "own"])

    def pairs(group: pa.Table) -> pa.Table:
        fps, at = np.unique(group.column("fp").to_numpy().astype(np.int64).view(np.uint64), return_inverse=True)
        points, queries = (np.unique(at[group.column(c).to_numpy(zero_copy_only=False).astype(bool)]) for c in ("point", "query"))
        e = _shard_edges(fps, points, queries, within)
        return pa.table({"a": fps[e[:, 0]].view(np.int64), "b": fps[e[:, 1]].view(np.int64)})

    dealt = materialize(distinct_fps.select("fp").mapInArrow(deal, "shard long, fp long, own boolean"), "dealt")
    # A dense shard is compared block by block: each block of its points with each of its queries.
    dense = dealt.groupBy("shard").agg(F.ceil(F.count("*") / DENSE).alias("m")).where("m > 1")
    parted = dealt.join(dense, "shard", "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("b", F.pmod(F.xxhash64("fp"), F.col("m")))
    every = F.sequence(F.lit(0).cast("long"), F.col("m") - 1)
    row = lambda i, j, point, query: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), point.alias("point"), query.alias("query"))
    yes, no, none = F.lit(True), F.lit(False), F.array().cast("array<struct<i:bigint,j:bigint,point:boolean,query:boolean>>")
    as_points = F.when(F.col("own"), F.transform(every, lambda j: row(F.col("b"), j, yes, no))).otherwise(none)
    tasks = F.when(F.col("m") == 1, F.array(row(F.lit(0), F.lit(0), F.col("own"), yes))).otherwise(F.concat(as_points, F.transform(every, lambda i: row(i, F.col("b"), no, yes))))
    spread = parted.select("shard", "fp", F.explode(tasks).alias("t")).select("shard", "fp", "t.*")
    return spread.groupBy("shard", "i", "j").applyInArrow(pairs, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): smallest node reachable, for nodes (a, b) of ``edges``.

    Alternates large-star and small-star steps; each is two aggregations by key and
    a join, so a node with very many links is never gathered into one task. Stops
    when a step changes nothing.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    state = None
    for _ in range(rounds):
        # Large star: every larger neighbour of u is linked to the smallest of u's neighbourhood.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours of u and u itself are linked to their smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_components(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 3, within: int = 2) -> DataFrame:
    """(id, fp, component) for every row: ``component`` is the smallest id reachable
    over links of at most ``within`` differing bits."""
    prints = materialize(add_fingerprints(docs, text, id_col, width), "fps")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct")
    roots = materialize(components(link_edges(distinct, within)), "roots")
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component"))
    classes = named.join(smallest, "root").select("fp", "component")
    return prints.join(classes, "fp").select("id", "fp", "component")


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a text without words has the empty one."""
    words = text.lower().split()
    grams = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64))


def _heads(sets: list[np.ndarray], similarity: float, last: np.ndarray, wider: float = 1.0) -> tuple[np.ndarray, ...]:
    """(set, hash, size, place, hash before it) of the first hashes of every set: two sets of which
    each holds ``similarity`` of the other have their first common hash among them.

    Any order of the hashes does, if it is one for all sets: here by value, but those in
    ``last`` (ascending) after all others. ``wider`` takes so many times as many.
    """
    size = np.array([len(x) for x in sets], np.int64)
    head = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
    head = np.minimum(size, np.ceil(head * wider).astype(np.int64))
    if not len(sets):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64))
    if len(last):
        every = np.concatenate(sets)
        late = last[np.minimum(np.searchsorted(last, every), len(last) - 1)] == every
        order = np.argsort(np.repeat(np.arange(len(sets)) * 2, size) + late, kind="stable")
        sets = np.split(every[order], np.cumsum(size)[:-1])
    at = np.repeat(np.arange(len(sets)), head)
    place = np.arange(len(at)) - np.repeat(np.cumsum(head) - head, head)
    h = np.concatenate([x[:k] for x, k in zip(sets, head, strict=True)])
    return at, h, size[at], place, np.where(place > 0, np.r_[h[:1], h[:-1]], np.uint64(0))


def _group_pairs(h: np.ndarray, n: np.ndarray, place: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (ordered by h and n) with the same hash, whose sizes, and whose hashes from
    this one on, allow the similarity."""
    i = np.arange(len(h))
    for lag in range(1, len(h)):
        i = i[i + lag < len(h)]
        # Sizes rise within a group: what is too large at this lag is so at the next.
        i = i[(h[i] == h[i + lag]) & (n[i] >= similarity * n[i + lag] - 1e-9)]
        if not len(i):
            return
        j = i + lag
        most = np.minimum(n[i] - place[i], n[j] - place[j])
        open_ = most * (1 + similarity) >= similarity * (n[i] + n[j]) - 1e-6
        yield i[open_], j[open_]


def _whole_groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...] = ("h",)) -> Iterator[pa.Table]:
    """Batches ordered by some columns, cut where these change."""
    left: list[pa.RecordBatch] = []
    for b in batches:
        keys = [b.column(c).to_numpy() for c in by]
        if not b.num_rows:
            continue
        changes = np.zeros(b.num_rows - 1, bool)
        for k in keys:
            changes |= k[1:] != k[:-1]
        at = np.flatnonzero(changes)
        cut = int(at[-1]) + 1 if len(at) else 0
        if cut or (left and any(left[-1].column(c)[0].as_py() != k[0].item() for c, k in zip(by, keys, strict=True))):
            yield pa.Table.from_batches([*left, b.slice(0, cut)])
            left = []
        left.append(b.slice(cut))
    if left:
        yield pa.Table.from_batches(left)


def _distinct(h: np.ndarray, ids: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Rows ordered by h and then id within equal sizes, each (h, id) once."""
    new = np.r_[True, (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])] if len(h) else np.zeros(0, bool)
    return [x[new] for x in (h, ids, *more)]


def _columns(group: pa.Table, *names: str) -> list[np.ndarray]:
    return [group.column(c).to_numpy() for c in names]


def _counts(hashes: np.ndarray) -> bytes:
    """How many of a set's hashes end in each byte; nothing where some number takes more than a byte."""
    n = np.bincount((hashes & np.uint64(255)).astype(np.int64), minlength=256)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else b""


def _most_common(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Of two sets each, the most hashes that they can have in common as a share of all, by their
    ``_counts``: no more than the lesser number for each byte. 1 where counts are not known."""
    out = np.ones(len(a))
    known = np.nonzero([bool(x and y) for x, y in zip(a, b, strict=True)])[0]
    if len(known):
        x, y = (np.frombuffer(b"".join(c[i] for i in known), np.uint8).reshape(-1, 256) for c in (a, b))
        common = np.minimum(x, y).sum(1, dtype=np.int64)
        total = x.sum(1, dtype=np.int64) + y.sum(1, dtype=np.int64) - common
        out[known] = common / np.maximum(total, 1)
    return out


def _may_be_alike(a: list[bytes], b: list[bytes], similarity: float) -> np.ndarray:
    """Whether the ``_counts`` of sets allow the similarity."""
    return _most_common(a, b) >= similarity - 1e-9


def _likely(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The candidate pairs (a, b) of short keys that the counts of both sets allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("ca", "cb"))
            yield batch.select(["a", "b"]).filter(pa.array(_may_be_alike(a, b, similarity)))

    counts = sets.select("id", "counts").dropDuplicates(["id"])
    met = pairs.join(counts.select(F.col("id").alias("a"), F.col("counts").alias("ca")), "a").join(counts.select(F.col("id").alias("b"), F.col("counts").alias("cb")), "b")
    return met.select("a", "b", "ca", "cb").mapInArrow(run, "a long, b long")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b) keys of the pairs of short keys that are alike on their whole sets.

    Of the sets only those of the pairs are moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x, "<u8") for x in batch.column(c).to_pylist()] for c in ("sa", "sb"))
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
            total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64) - both
            yield batch.select(["ka", "kb"]).filter(pa.array(both >= similarity * total - 1e-9)).rename_columns(["a", "b"])

    asked = scratch.table(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "asked")
    sent = F.broadcast(asked) if asked.count() <= ASKED else asked
    own = scratch.table(sets.select("id", "key", "set").join(sent, "id", "left_semi"), "own")
    left = pairs.join(own.select(F.col("id").alias("a"), F.col("key").alias("ka"), F.col("set").alias("sa")), "a")
    full = left.join(own.select(F.col("id").alias("b"), F.col("key").alias("kb"), F.col("set").alias("sb")), "b")
    return scratch.table(full.select("ka", "kb", "sa", "sb").mapInArrow(run, "a binary, b binary").distinct(), "edges")


def _roots_by_id(roots: DataFrame) -> DataFrame:
    return roots.select(F.xxhash64("node").alias("id"), "root").groupBy("id").agg(F.max("root").alias("root"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose two texts are not in one component yet."""
    known = _roots_by_id(roots)
    for c in ("a", "b"):
        label = known.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
        pairs = pairs.join(label, c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", F.col(c).cast("string").cast("binary")))
    return pairs.where("ra <> rb").select("a", "b")


def _sets(docs: DataFrame, text: str, width: int) -> DataFrame:
    """(key, set, counts, fp) of texts: the digest of a text, its shingle hashes in order, how many of
    them end in each byte, and their SimHash. A text is there once a task or so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            rows = []
            for key, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                # A copy of a text need not be done again; other tasks may have one, which does no harm.
                if key in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key)
                h = shingle_hashes(value, width).astype("<u8")
                rows.append((key, h.tobytes(), _counts(h), int(_UNITS[_bit_counts(h) * 2 > len(h)].sum(dtype=np.uint64))))
            fps = np.array([r[3] for r in rows], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.binary()) for k in range(3)), pa.array(fps)], names=["key", "set", "counts", "fp"])

    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(text_digest(value).alias("key"), value.cast("binary").alias("text"))
    return texts.mapInArrow(run, "key binary, set binary, counts binary, fp long")


def _by_fingerprint(sets: DataFrame, scratch: Scratch, within: int = 2) -> DataFrame:
    """Pairs (a, b) of texts whose fingerprints link: those of one fingerprint with the smallest key
    there, and these along a spanning forest of the links."""
    prints = scratch.table(sets.select("id", "fp").distinct(), "prints")
    leads = scratch.table(prints.groupBy("fp").agg(F.min("id").alias("lead")), "leads")
    same = prints.join(leads, "fp").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    of = lambda c: leads.select(F.col("fp").alias(c), F.col("lead").alias(f"l{c}"))
    ends = link_edges(leads.select("fp"), within).join(of("a"), "a").join(of("b"), "b")
    linked = ends.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
    return scratch.table(same.union(linked).where("a <> b").distinct(), "linked")


def _first_hashes(sets: DataFrame, similarity: float, late: DataFrame | None, few: np.ndarray, wider: float = 1.0, marked: np.ndarray | None = None) -> DataFrame:
    """(h, id, n, place, before, crowded) of the first hashes of each set, those in ``few``, or in the
    table ``late`` where they are too many to send to the tasks, after all others; ``crowded`` are
    those in ``marked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                last = few
                if "late" in b.schema.names:
                    held = [x for own in b.column("late").to_pylist() for x in own or ()]
                    last = np.unique(np.array(held, np.int64).view(np.uint64))
                at, h, n, place, before = _heads([np.frombuffer(x, "<u8") for x in b.column("set").to_pylist()], similarity, last, wider)
                crowded = np.zeros(len(h), bool)
                if marked is not None and len(marked):
                    crowded = marked[np.minimum(np.searchsorted(marked, h), len(marked) - 1)] == h
                ids = b.column("id").to_numpy()
                columns = [h.view(np.int64), ids[at], n.astype(np.int32), place.astype(np.int32), before.view(np.int64), crowded]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "id", "n", "place", "before", "crowded"])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                parts = [np.frombuffer(x, "<i8") for x in b.column("set").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(np.repeat(b.column("id").to_numpy(), [len(x) for x in parts]))], names=["h", "id"])

    own = sets.select("id", "set")
    if late is not None:
        holds = own.mapInArrow(every, "h long, id long").join(late, "h").groupBy("id").agg(F.collect_set("h").alias("late"))
        own = own.join(holds, "id", "left")
    return own.mapInArrow(run, "h long, id long, n int, place int, before long, crowded boolean")


def _crowds(sets: DataFrame, similarity: float, scratch: Scratch) -> tuple[DataFrame, DataFrame | None, np.ndarray]:
    """(hashes that more than MEET texts have among their first, and which hashes go after all others:
    a table or, where they are few, an array).

    A hash that many texts share, of a passage that is quoted everywhere say, tells nothing
    about any two of them. It goes to the end of the order, so texts meet by rarer ones; others may
    come to the front by that and be crowded, so it is done a few times.
    """
    last, late, few = None, None, np.zeros(0, np.uint64)
    for turn in range(ROUNDS):
        first = _first_hashes(sets, similarity, late, few, 1.5 if turn < ROUNDS - 1 else 1.0)
        found = scratch.table(first.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > MEET).select("h"), "crowded")
        if turn == ROUNDS - 1:
            return found, late, few
        fresh = found if last is None else found.join(last, "h", "left_anti")
        if fresh.isEmpty() and turn:
            return found, late, few
        last = found if last is None else scratch.table(last.union(fresh), "crowded")
        many = last.count() > CROWDED
        late, few = (last, np.zeros(0, np.uint64)) if many else (None, np.sort(last.toPandas()["h"].to_numpy(np.int64).view(np.uint64)))
    raise AssertionError


def _meet(first: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts that share one of their first hashes. No hash may be crowded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_groups(batches):
            h, ids, n, place = _distinct(*_columns(group, "h", "id", "n", "place"))
            for i, j in _group_pairs(h, n, place, similarity):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], names=["a", "b"])

    return first.select("h", "id", "n", "place").repartition("h").sortWithinPartitions("h", "n", "id").mapInArrow(run, "a long, b long")


def _meet_one(crowd: DataFrame) -> DataFrame:
    """Pairs of each text of a crowd with one of about its size there: most groups are one
    component by that."""
    sized = crowd.withColumn("size", F.floor(F.log(F.col("n").cast("double")) * 8))
    lead = sized.groupBy("h", "size").agg(F.min("id").alias("lead"))
    met = sized.join(lead, ["h", "size"]).where("id <> lead")
    return met.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))


def _cell_pairs(n: np.ndarray, place: np.ndarray, labels: tuple[np.ndarray, ...], plain: np.ndarray, own: np.ndarray, block: np.ndarray, star: bool, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell whose sizes and places allow the similarity and that differ in each of
    ``labels``. Two ``plain`` rows never do.

    In a ``star`` cell all rows that are not plain stand beside a block of plain ones; two that
    are not plain are compared where the first is at home (``own``). Else the rows of two blocks stand
    there, and rows of one block are compared where it meets itself.
    """
    for r in np.flatnonzero(~plain):
        most = np.minimum(n[r] - place[r], n - place)
        open_ = most * (1 + similarity) >= similarity * (n[r] + n) - 1e-6
        open_ &= np.minimum(n, n[r]) >= similarity * np.maximum(n, n[r]) - 1e-9
        for label in labels:
            open_ &= label != label[r]
        if star:
            open_ &= plain | own[r]
        else:
            open_ &= own | (block != block[r])
        q = np.flatnonzero(open_)
        if len(q):
            yield np.full(len(q), r), q


def _meet_crowd(crowd: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float, best: int | None = None) -> DataFrame:
    """Pairs of texts of a crowd that are of different components and that sizes, places and counts of
    hashes allow; with ``best`` so many of each text at most, those whose counts have most in common.

    Two texts that have the same hash before the common one met there, so they are passed over. Most
    texts of a crowd are of its largest component and have its most frequent hash before: these
    plain ones are never compared with each other. A crowd is cut into blocks; its plain texts go
    to their block only, the others to every block, or, where these are many, two blocks meet
    in a task. So a task holds a bounded number of texts, however large the crowd, and nothing is
    sent on before all bounds are applied.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_groups(batches, ("h", "cell")):
            h, cell, ids, n, place, before, block, plain, own, star = _columns(group, "h", "cell", "id", "n", "place", "before", "block", "plain", "own", "star")
            root = np.unique(group.column("root").combine_chunks().to_numpy(zero_copy_only=False), return_inverse=True)[1]
            counts = group.column("counts").to_pylist()
            # At the first place there is no hash before: every text differs there.
            before = np.where(place > 0, before, ids)
            edges = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (cell[1:] != cell[:-1]), True])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                w = slice(int(lo), int(hi))
                for i, j in _cell_pairs(n[w], place[w], (root[w], before[w], ids[w]), plain[w], own[w], block[w], bool(star[lo]), similarity):
                    share = np.concatenate([_most_common([counts[i[0] + lo]] * len(q), [counts[x] for x in q]) for k in range(0, len(j), 4096) for q in (j[k : k + 4096] + lo,)])
                    ok = np.flatnonzero(share >= similarity - 1e-9)
                    if best is not None and len(ok) > best:
                        ok = ok[np.argsort(-share[ok], kind="stable")[:best]]
                    p, q = ids[i[ok] + lo], ids[j[ok] + lo]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    def most(column: str) -> DataFrame:
        counted = rooted.groupBy("h", column).agg(F.count("*").alias("m"))
        return counted.groupBy("h").agg(F.max_by(column, F.struct("m", column)).alias(f"most_{column}"), F.sum("m").alias("size"), F.count("*").alias("kinds"))

    rooted = crowd.join(_roots_by_id(roots), "id", "left").withColumn("root", F.coalesce("root", F.col("id").cast("string").cast("binary")))
    # Crowds that are one component by now have nothing to compare.
    open_ = most("root").where("kinds > 1").drop("kinds")
    usual = open_.join(most("before").select("h", "most_before"), "h")
    own = rooted.join(usual, "h").withColumn("plain", (F.col("root") == F.col("most_root")) & (F.col("before") == F.col("most_before")) & (F.col("place") > 0))
    # Plain texts meet only those that differ from them in both.
    odd = (F.col("root") != F.col("most_root")) & ((F.col("before") != F.col("most_before")) | (F.col("place") == 0))
    dealt = own.groupBy("h").agg(F.count_if(odd).alias("odd"), F.count_if(~F.col("plain")).alias("rest"))
    own = own.join(dealt.withColumnRenamed("h", "_h"), F.col("h") == F.col("_h")).where(~F.col("plain") | (F.col("odd") > 0))
    own = own.join(sets.select("id", "counts").dropDuplicates(["id"]), "id")
    k = F.ceil(F.col("size") / CELL)
    own = own.withColumns({"k": k, "block": F.pmod(F.xxhash64("id"), k), "star": F.col("rest") <= STAR})
    blocks = F.sequence(F.lit(0).cast("long"), F.col("k") - 1)
    here = F.array(F.struct(F.col("block").alias("cell"), F.lit(True).alias("own")))
    everywhere = F.transform(blocks, lambda j: F.struct(j.alias("cell"), (F.col("block") == j).alias("own")))
    by_two = F.transform(blocks, lambda j: F.struct((F.least("block", j) * F.col("k") + F.greatest("block", j)).alias("cell"), (F.col("block") == j).alias("own")))
    pair = F.explode(F.when(F.col("star") & F.col("plain"), here).when(F.col("star"), everywhere).otherwise(by_two))
    cells = own.withColumn("pair", pair).select("h", "pair.cell", "pair.own", "id", "n", "place", "before", "block", "plain", "star", "root", "counts")
    return cells.repartition("h", "cell").sortWithinPartitions("h", "cell", "n", "id").mapInArrow(run, "a long, b long")


def near_copy_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """((key, id) of every row, (key, root) of every distinct text).

    Texts link when their sets of ``width``-word shingles are at least ``similarity`` alike. Those whose
    SimHashes link by the vantage-point trees are compared first. The fingerprint is no bound at this
    similarity, so what is left in different components is found exactly. Every such pair shares a hash among the first of both sets, in an order that puts hashes of many
    texts last; so texts meet by those hashes and no pair is lost; whole sets decide. Where more
    than MEET texts still share a hash, they first meet one of them only, and then those of other
    components.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = materialize(docs.select(text_digest(value).alias("key"), F.col(id_col).alias("id")), "rows")
    scratch = Scratch(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": ROWS})
    sets = scratch.table(_sets(docs, text, width), "sets")
    # Candidates go by a 64-bit digest of the key.
    sets = sets.select(F.xxhash64("key").alias("id"), "key", "set", "counts", "fp")
    close = _alike(_by_fingerprint(sets, scratch), sets, similarity, scratch)
    known = scratch.table(components(close), "roots")
    crowded, late, few = _crowds(sets, similarity, scratch)
    if late is None and crowded.count() <= CROWDED:
        first = _first_hashes(sets, similarity, late, few, marked=np.sort(crowded.toPandas()["h"].to_numpy(np.int64).view(np.uint64)))
        crowd, others = first.where("crowded"), first.where("NOT crowded")
    else:
        first = _first_hashes(sets, similarity, late, few)
        crowd, others = (first.join(crowded, "h", how) for how in ("left_semi", "left_anti"))
    # Copies of a text in several tasks are one text.
    crowd = scratch.table(crowd.drop("crowded").distinct(), "crowd")
    met = _meet(others, similarity).union(_meet_one(crowd)).where("a <> b").distinct()
    near = scratch.table(_likely(scratch.table(_apart(met, known), "met"), sets, similarity), "likely")
    # Each text then meets the smallest it may be like, which joins most groups; then only
    # pairs of different components are left to be compared.
    edges = close.union(_alike(scratch.table(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first"), sets, similarity, scratch))
    rest = scratch.table(_apart(near, scratch.table(components(edges), "roots")), "rest")
    edges = scratch.table(edges.union(_alike(rest, sets, similarity, scratch)), "edges")
    roots = scratch.table(components(edges), "roots")
    if not crowd.isEmpty():
        # First each text's likeliest partners, which joins most of what is alike; then all that is left.
        for best in (BEST, None):
            again = scratch.table(_meet_crowd(crowd, sets, roots, similarity, best).distinct(), "again")
            more = _alike(again, sets, similarity, scratch)
            if not more.isEmpty():
                edges = scratch.table(edges.union(more), "edges")
                roots = scratch.table(components(edges), "roots")
    keys = sets.select("key").distinct()
    named = keys.join(roots, keys.key == roots.node, "left").select("key", F.coalesce("root", "key").alias("root"))
    named = materialize(named, "classes")
    scratch.clear()
    return rows, named


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class of linked texts the row with
    the smallest id stays (a null id only where there is no other), one of repeated rows."""
    rows, named = near_copy_classes(docs, id_col, text, width, similarity)
    first = rows.groupBy("key").agg(F.min("id").alias("id"))
    # struct order: non-null ids first, then the smaller id, then the smaller key.
    best = named.join(first, "key").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("m"))
    key, keep = free_name(docs, "_key"), best.select(F.col("m.key").alias("_k"), F.col("m.id").alias("_i"))
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.withColumn(key, text_digest(value))
    kept = keyed.join(keep, (keyed[key] == keep["_k"]) & keyed[id_col].eqNullSafe(keep["_i"]), "left_semi")
    return kept.dropDuplicates([key, id_col]).select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint over 3-word shingles and its component at 2 bits."""
    out = simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
