"""Exact substring dedup: a depth-limited radix sort of suffixes.

A suffix matters only through its first ``depth`` bytes (its window). Windows are ordered
by most-significant-digit passes, and a group that is still equal after the last digit is
exactly a repeated window:

1. The first digit is the window's minimizer: the smallest hash among its ``GRAM``-byte
   strings. Equal windows have equal minimizers. Consecutive windows with one minimizer
   form a segment, so about two records per ``depth`` bytes are dealt, not one per byte.
   Minimizers that occur once end here; that is most of them.
2. Segments with equal bytes collapse to one; met twice, all their windows are repeated.
3. Only minimizers with different segments are sorted further: 8 bytes a pass, groups
   split at each digit, groups of one dropped. A minimizer with very many segments is
   dealt over several tasks; there the windows that stay single are matched across the
   tasks by a 128-bit digest, with partial aggregation before the shuffle.

Nothing is capped, and no task holds all rows of a key.

Defined results: a null text is empty and keeps nothing; matches never cross rows; a
repeated row is a copy like any other; an empty table gives no rows; other columns are
kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bytewise import mix, prefix_hash, span_hash
from millrace.llm.shared import column_bytes, free_name, materialize, slices, table, text_digest

DEPTH = 200
#: Bytes of the strings among which a window's minimizer is chosen; a power of two from 8 on.
GRAM = 32
#: Bytes handled at once, bytes of segments sorted at once, and rows of texts taken at once.
STEP, SORT_BYTES, ROWS = 1 << 19, 1 << 20, 512
#: Distinct segments of a minimizer that one task takes.
SALT_ROWS = 2048
SPANS = "array<struct<start:bigint,end:bigint>>"


def _words_at(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as an unsigned integer whose order is the bytes' order."""
    return np.ndarray((len(raw) - 7,), ">u8", raw, 0, (1,)).astype(np.uint64)


def _gram_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    h, size = mix(_words_at(raw)), 8
    while size < width:
        h = mix(h[:-size] * np.uint64(0x9E3779B97F4A7C15) + h[size:])
        size *= 2
    return h


def _window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values: block-wise running minima from both ends."""
    n = len(h) - width + 1
    full = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(h)] = h
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(raw: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """(row, start in the row, windows, minimizer, content hash, whether the minimizer occurs
    more than once in it) of the segments of each row."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    if len(raw) < depth:
        return none
    grams, width = _gram_hashes(raw, GRAM), depth - GRAM + 1
    low = _window_minima(grams, width)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(low)]
    good = np.arange(len(low)) + depth <= offsets[row + 1]
    fresh = np.ones(len(low), bool)
    fresh[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    start = np.nonzero(fresh & good)[0]
    if not len(start):
        return none
    edges = np.r_[np.nonzero(fresh)[0], len(low)]
    stop = edges[np.searchsorted(edges, start, side="right")]
    stop = np.minimum(stop, offsets[row[start] + 1] - depth + 1)
    # Over the hashes of all strings of GRAM bytes in the segment: no polynomial in its bytes.
    content = span_hash(prefix_hash(grams), start, stop + depth - GRAM)
    # Where some window's minimizer stands: the largest minimum of the windows over a place is its own hash.
    wide = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    place = np.nonzero(~_window_minima(~wide, width)[: len(grams)] == grams)[0]
    first, last = np.searchsorted(place, start), np.searchsorted(place, stop + width - 1)
    of = np.repeat(np.arange(len(start)), last - first)
    at = place[np.arange(len(of)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + np.repeat(first, last - first)]
    often = np.bincount(of[grams[at] == low[start][of]], minlength=len(start)) > 1
    return row[start], start - offsets[row[start]], stop - start, low[start], content, often


def _pieces(raw: np.ndarray, offsets: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``segments`` of a batch, by steps; a very long row is taken in overlapping parts."""
    for i, j in slices(offsets, STEP):
        a, b = int(offsets[i]), int(offsets[j])
        if j - i == 1 and b - a > 2 * STEP:
            for p in range(a, max(a + 1, b - depth + 1), STEP):
                part = raw[p : min(b, p + STEP + depth - 1)]
                row, start, *rest = segments(part, np.array([0, len(part)]), depth)
                yield (row + i, start + (p - a), *rest)
        else:
            row, *rest = segments(raw[a:b], offsets[i : j + 1] - a, depth)
            yield (row + i, *rest)


def radix_groups(raw: np.ndarray, start: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(window index, group) of the windows that equal another of their group: passes over 8
    bytes each, most significant first, that split groups and drop those of one."""
    index, words = np.arange(len(start)), _words_at(np.r_[raw, np.zeros(8, np.uint8)])
    for at in [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:
        digit = words[start[index] + at]
        order = np.lexsort((digit, group))
        index, group, digit = index[order], group[order], digit[order]
        new = np.ones(len(index) + 1, bool)
        new[1:-1] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        several = ~(new[:-1] & new[1:])
        index, group = index[several], np.cumsum(new[:-1])[several]
        if not len(index):
            break
    return index, group


def _digest(raw: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    rows = raw[start[:, None] + np.arange(depth)] if len(start) else np.zeros((0, depth), np.uint8)
    rows = np.pad(rows, ((0, 0), (0, -depth % 8))).view("<u8").astype(np.uint64)
    a, b = np.full(len(rows), 0x243F6A8885A308D3, np.uint64), np.full(len(rows), 0x13198A2E03707344, np.uint64)
    for k in range(rows.shape[1]):
        a, b = mix(a ^ rows[:, k]), mix(b * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return a, b


def _runs(start: np.ndarray, depth: int) -> list[dict[str, int]]:
    """Maximal covered byte runs of windows that begin at ``start`` (sorted)."""
    if not len(start):
        return []
    cut = np.nonzero(np.diff(start) > depth)[0]
    return [{"start": int(s), "end": int(e) + depth} for s, e in zip(start[np.r_[0, cut + 1]], start[np.r_[cut, len(start) - 1]], strict=True)]


def repeated_spans(docs: DataFrame, text: str = "text", depth: int = DEPTH) -> DataFrame:
    """(key, spans): for each distinct text that holds some, the bytes covered by windows of
    ``depth`` bytes that start anywhere else too; spans are relative to the text and may overlap."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(text_digest(value).alias("key"), value.alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = column_bytes(b.column(1))
            for row, start, n, low, content, often in _pieces(raw, offs, depth):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(start), pa.array(n), pa.array(low.view(np.int64)), pa.array(content.view(np.int64)), pa.array(often)], names=["key", "start", "n", "low", "content", "often"])

    found = materialize(keyed.mapInArrow(cut, "key binary, start long, n long, low long, content long, often boolean"), "segments")
    minimizers = found.groupBy("low").agg(F.count("*").alias("times"), ((F.min("content") != F.max("content")) | F.max("often")).alias("mixed")).where("times > 1 or mixed").select("low", "mixed")
    likely = materialize(found.join(minimizers, "low"), "likely")
    # One row for each distinct segment; where it occurs first stands for its bytes.
    distinct = materialize(likely.groupBy("low", "content").agg(F.count("*").alias("times"), F.min(F.struct("key", "start", "n")).alias("at"), F.first("mixed").alias("mixed")), "distinct")
    mixed = distinct.where("mixed")
    dealt = mixed.groupBy("low").agg(F.ceil(F.count("*") / SALT_ROWS).alias("salts"))
    asked = mixed.join(dealt, "low").groupBy("at.key").agg(F.collect_list(F.struct("low", "content", "salts", "at.start", "at.n")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches):
            rows = {"low": [], "content": [], "salts": [], "n": [], "body": []}
            for t, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = t.encode()
                for w in wanted:
                    for k in ("low", "content", "salts", "n"):
                        rows[k].append(w[k])
                    rows["body"].append(raw[w["start"] : w["start"] + w["n"] + depth - 1])
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[k], pa.int64()) for k in ("low", "content", "salts", "n")), pa.array(rows["body"], pa.binary())], names=list(rows))

    bodies = keyed.join(asked, "key").select("text", "wanted").mapInArrow(fetch, "low long, content long, salts long, n long, body binary")
    salt = F.pmod(F.col("content"), F.col("salts"))
    parts = spark_partitions(docs)
    lined = bodies.withColumn("salt", salt).repartition(parts, "low", "salt").sortWithinPartitions("low", "salt", "content")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _whole_groups(batches):
            yield from _sort_chunk(chunk, depth)

    windows = materialize(lined.mapInArrow(sort, f"low long, content long, spans {SPANS}, single long, a long, b long"), "windows")
    singles = windows.where("single is not null")
    again = singles.groupBy("low", "a", "b").agg(F.count("*").alias("c")).where("c > 1").select("low", "a", "b")
    across = singles.join(again, ["low", "a", "b"], "left_semi").select("low", "content", F.array(F.struct(F.col("single").alias("start"), (F.col("single") + depth).alias("end"))).alias("spans"))
    inner = windows.where("single is null").select("low", "content", "spans").union(across)
    whole = distinct.where("times > 1").select("low", "content", F.array(F.struct(F.lit(0).cast("long").alias("start"), (F.col("at.n") + (depth - 1)).alias("end"))).alias("spans"))
    cover = whole.union(inner).select("low", "content", F.explode("spans").alias("s")).groupBy("low", "content").agg(F.collect_set("s").alias("spans"))
    placed = likely.join(cover, ["low", "content"]).select("key", F.explode(F.transform("spans", lambda s: F.struct((s["start"] + F.col("start")).alias("start"), (s["end"] + F.col("start")).alias("end")))).alias("s"))
    return placed.groupBy("key").agg(F.collect_set("s").alias("spans"))


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ROWS rows."""
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield b.slice(k, ROWS)


def spark_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows again, about ``SORT_BYTES`` at a time, never parting a (low, salt) group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        low, salt = b.column("low").to_numpy(), b.column("salt").to_numpy()
        edge = np.nonzero((low[1:] != low[:-1]) | (salt[1:] != salt[:-1]))[0] + 1
        lengths = np.cumsum(np.diff(column_bytes(b.column("body"))[1]))
        if held:
            last = held[-1]
            if (last.column("low")[-1].as_py(), last.column("salt")[-1].as_py()) != (int(low[0]), int(salt[0])):
                edge = np.r_[0, edge]
        begin, base = 0, 0
        for e in edge.tolist():
            seen = (int(lengths[e - 1]) if e else 0) - base
            if size + seen >= SORT_BYTES:
                if e > begin:
                    held.append(b.slice(begin, e - begin))
                yield pa.Table.from_batches(held)
                held, size, begin, base = [], 0, e, int(lengths[e - 1]) if e else 0
        if begin < b.num_rows:
            held.append(b.slice(begin))
            size += int(lengths[-1]) - base
    if held:
        yield pa.Table.from_batches(held)


def _sort_chunk(rows: pa.Table, depth: int) -> Iterator[pa.RecordBatch]:
    low, content, salts = (rows.column(c).to_numpy().astype(np.int64) for c in ("low", "content", "salts"))
    raw, offs = column_bytes(rows.column("body"))
    # The same text may have been fetched for several rows that hold it.
    twin = np.r_[False, (low[1:] == low[:-1]) & (content[1:] == content[:-1])] if len(low) else np.zeros(0, bool)
    n = np.where(twin, 0, rows.column("n").to_numpy())
    seg = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = offs[seg] + at
    minimizer = np.cumsum(np.r_[False, low[1:] != low[:-1]]) if len(low) else low
    index, group = radix_groups(raw, start, minimizer[seg], depth)
    repeated = np.zeros(len(start), bool)
    repeated[index] = True
    names = ["low", "content", "spans", "single", "a", "b"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out = []
    hits = np.nonzero(repeated)[0]
    for k in np.unique(seg[hits]).tolist() if len(hits) else []:
        a, b = np.searchsorted(seg[hits], [k, k + 1])
        out.append((int(low[k]), int(content[k]), _runs(at[hits[a:b]], depth)))
    nothing = pa.nulls(len(out), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], kind), nothing, nothing, nothing], names=names)
    # Of a minimizer that other tasks hold too, each different window is matched on, once.
    once = ~repeated
    once[index[np.unique(group, return_index=True)[1]]] = True
    shared = np.nonzero(once & (salts[seg] > 1))[0]
    for k in range(0, len(shared), 16384):
        w = shared[k : k + 16384]
        a, b = _digest(raw, start[w], depth)
        yield pa.RecordBatch.from_arrays([pa.array(low[seg[w]]), pa.array(content[seg[w]]), pa.nulls(len(w), kind), pa.array(at[w]), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=names)


def remove_repeats(docs: DataFrame, text: str = "text", depth: int = DEPTH) -> DataFrame:
    """``docs`` without the text and with n_bytes, spans (maximal removed byte runs) and kept
    (the other bytes, as binary: a cut may fall inside a character) in a struct column "repeats"."""
    key, held, other, into = (free_name(docs, n) for n in ("_key", "_spans", "_k", "repeats"))
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    spans = repeated_spans(docs, text, depth).withColumnsRenamed({"key": other, "spans": held})
    keyed = docs.withColumns({text: value, key: text_digest(value)})
    joined = keyed.join(spans, keyed[key] == spans[other], "left").drop(other)
    others = [c for c in docs.columns if c != text]
    schema = docs.select(*others, F.lit(None).cast(f"struct<n_bytes:bigint,spans:{SPANS},kept:binary>").alias(into)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
        for b in parts_of(batches):
            out = []
            for t, found in zip(b.column(text).to_pylist(), b.column(held).to_pylist(), strict=True):
                raw, cuts, kept, at = t.encode(), [], [], 0
                for s, e in sorted((x["start"], x["end"]) for x in found or ()):
                    if cuts and s <= cuts[-1]["end"]:
                        cuts[-1]["end"] = max(cuts[-1]["end"], e)
                    else:
                        cuts.append({"start": s, "end": e})
                for c in cuts:
                    kept.append(raw[at : c["start"]])
                    at = c["end"]
                out.append({"n_bytes": len(raw), "spans": cuts, "kept": b"".join([*kept, raw[at:]])})
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(out, kind)], names=[*others, into])

    return joined.select(*others, text, held).mapInArrow(run, schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left when strings of 200 bytes that occur elsewhere go."""
    r = F.col("repeats")
    removed = F.aggregate(r["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", r["n_bytes"].alias("n_bytes"), removed.alias("n_removed"), F.size(r["spans"]).cast("long").alias("n_spans"), F.sha2(r["kept"], 256).alias("kept_sha256"))


SQL = r"""
WITH bytes AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), windows AS (
  SELECT doc_id, s, md5(b[s + 1 : s + 200]) AS win
  FROM (SELECT doc_id, b, unnest(range(0, n - 199)) AS s FROM bytes)
), repeated AS (
  SELECT doc_id, s FROM windows WHERE win IN (SELECT win FROM windows GROUP BY win HAVING count(*) > 1)
), runs AS (
  SELECT doc_id, min(s) AS a, max(s) + 200 AS b
  FROM (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY s) AS run
        FROM (SELECT *, coalesce(s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) > 200, true) AS fresh FROM repeated))
  GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t, a FROM runs
  UNION ALL SELECT doc_id, max(b), NULL, max(b) FROM runs GROUP BY doc_id
), kept AS (
  SELECT g.doc_id, string_agg(hex(b.b[g.f + 1 : coalesce(g.t, b.n)]), '' ORDER BY g.a) AS h
  FROM gaps g JOIN bytes b ON g.doc_id = b.doc_id GROUP BY g.doc_id
), counts AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id
)
SELECT b.doc_id, CAST(b.n AS BIGINT) AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(c.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.h, hex(b.b)))) AS kept_sha256
FROM bytes b LEFT JOIN counts c ON b.doc_id = c.doc_id LEFT JOIN kept k ON b.doc_id = k.doc_id
"""
