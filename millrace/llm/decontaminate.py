"""Benchmark decontamination: a prefix-filtered containment join.

Every benchmark item is cut into item-sized windows: ``window`` consecutive words, or
the whole item where it has fewer. A window is contained in a document only if its
rarest word is, so that word alone (the necessary prefix of a containment of 1) is
looked up; rarity is the word's count over all documents. An occurrence gives the place
where the window would begin; places before the document's first word or that leave too
few words after them are dropped (positional and length bound), the rest is compared by
hash and then word for word.

The benchmark is the query set: it is taken in blocks of about ``block_bytes`` of text.
A block's index is sent to the tasks of one pass over the documents, whose result is
written before the next block is read, so the driver, a plan and a task hold one index
at a time (some 45 bytes a byte of a block) whatever the benchmark's size, and the
documents are never shuffled. A benchmark of one block is joined without a written table.

Defined results: a null text has no words and no hits; items without words match
nothing; an item that occurs several times counts once, items with a null id count as
no id but still hit; repeated document rows each give a row; an empty benchmark or
table gives no hits or no rows; of equally rare words the smaller is looked up; other
columns of both tables are left alone (a new column whose name is taken gets
underscores before it).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bytewise import BYTE_CODE, mix, prefix_hash, span_hash, words
from millrace.llm.shared import column_bytes, free_name, materialize, slices, table

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: Bytes of text that a task handles at once.
STEP = 1 << 20


def item_words(text: str | None) -> list[bytes]:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    low, s, e, _ = words(raw, np.array([0, len(raw)]))
    return [low[i:j].tobytes() for i, j in zip(s.tolist(), e.tolist(), strict=True)]


def _word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(BYTE_CODE[low]), starts, ends)


def _hash_words(ws: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(ws), np.uint8)
    ends = np.cumsum([len(w) for w in ws], dtype=np.int64)
    return _word_hashes(raw, np.r_[0, ends[:-1]].astype(np.int64), ends)


class WindowIndex:
    """Windows of a block of items, found by their rarest word."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int, counts: dict[bytes, int]):
        self.owners: dict[bytes, set[int]] = defaultdict(set)
        self.ids = [i for i, _ in items]
        keys: dict[tuple[int, int, int], None] = {}
        hashes = []
        for k, (_, ws) in enumerate(items):
            if not ws:
                continue
            h, size = _hash_words(ws), min(window, len(ws))
            prefix = prefix_hash(h)
            for s in range(len(ws) - size + 1):
                own = ws[s : s + size]
                known = self.owners[b" ".join(own)]
                if not known:
                    # The global order: rarer words first, ties by the word itself.
                    j = min(range(size), key=lambda j: (counts.get(own[j], 0), own[j], j))
                    keys[(int(h[s + j]), j, size)] = None
                    hashes.append(span_hash(prefix, np.array([s]), np.array([s + size]))[0])
                known.add(k)
        self.windows = np.unique(np.array(hashes, np.uint64))
        lookups = np.array(sorted(keys), dtype=[("w", "u8"), ("j", "i8"), ("n", "i8")])
        self.words, self.first = np.unique(lookups["w"], return_index=True)
        self.last = np.r_[self.first[1:], len(lookups)]
        self.shift, self.size = lookups["j"], lookups["n"]

    def occurrences(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, text_first: np.ndarray) -> list[tuple[int, int, set[int]]]:
        """(first word, size, items) of each occurrence of a window within one text."""
        if not len(self.words) or not len(starts):
            return []
        h = _word_hashes(low, starts, ends)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        p = np.nonzero(self.words[at] == h)[0]
        n = self.last[at[p]] - self.first[at[p]]
        if not n.sum():
            return []
        row = np.repeat(self.first[at[p]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p = np.repeat(p, n)
        begin, size = p - self.shift[row], self.size[row]
        text = np.searchsorted(text_first, p, side="right") - 1
        fits = (begin >= text_first[text]) & (begin + size <= text_first[text + 1])
        begin, size = begin[fits], size[fits]
        wh = span_hash(prefix_hash(h), begin, begin + size)
        like = np.isin(wh, self.windows)
        out = []
        for b, n_ in sorted(set(zip(begin[like].tolist(), size[like].tolist(), strict=True))):
            own = b" ".join(low[i:j].tobytes() for i, j in zip(starts[b : b + n_].tolist(), ends[b : b + n_].tolist(), strict=True))
            if found := self.owners.get(own):
                out.append((b, n_, found))
        return out


def vocabulary_counts(docs: DataFrame, text: str, vocabulary: list[bytes]) -> dict[bytes, int]:
    """How often each word of a benchmark block occurs in all documents."""
    hashes = _hash_words(vocabulary) if vocabulary else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    known = hashes[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            raw, offs = column_bytes(batch.column(0))
            for i, j in slices(offs, STEP):
                o = offs[i : j + 1]
                low, s, e, _ = words(raw[o[0] : o[-1]], o - o[0])
                h = _word_hashes(low, s, e)
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                if len(known):
                    total += np.bincount(at[known[at] == h], minlength=len(known))
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(order[some]), pa.array(total[some])], names=["word", "n"])

    rows = docs.select(F.col(text).cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {vocabulary[r.word]: r.n for r in rows}


def mark_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, into: str = "contamination") -> DataFrame:
    """``docs`` with a struct column: n_words, spans (first word, end word; maximal, in order)
    and items (ids, as strings, of the items that have an occurring window; sorted)."""
    value = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    size = value.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes))
    state = free_name(docs, "_hits")
    schema = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"
    out = docs.withColumn(state, F.lit(None).cast(schema))
    for k in range(blocks):
        part = value.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        block = [(r.id, item_words(r.text)) for r in part.toLocalIterator()]
        vocabulary = sorted({w for _, ws in block for w in ws})
        index = WindowIndex(block, window, vocabulary_counts(docs, text, vocabulary))
        if k:
            out = materialize(out, "marked")
        out = out.mapInArrow(_marker(index, text, state), out.schema)
    return out.withColumnRenamed(state, free_name(docs, into))


def _marker(index: WindowIndex, text: str, state: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            raw, offs = column_bytes(column if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(pa.string()))
            before = batch.column(batch.schema.get_field_index(state)).to_pylist()
            rows = []
            for i, j in slices(offs, STEP):
                o = offs[i : j + 1]
                low, s, e, first = words(raw[o[0] : o[-1]], o - o[0])
                n = np.diff(first)
                spans, ids = defaultdict(list), defaultdict(set)
                for b, size, found in index.occurrences(low, s, e, first):
                    t = int(np.searchsorted(first, b, side="right")) - 1
                    spans[t].append((b - int(first[t]), b - int(first[t]) + size))
                    ids[t] |= found
                for t in range(j - i):
                    old = before[i + t] or {"spans": [], "items": []}
                    items = {index.ids[x] for x in ids[t]} | set(old["items"])
                    rows.append({"n_words": int(n[t]), "spans": union(spans[t] + [(x["start"], x["end"]) for x in old["spans"]]), "items": sorted(x for x in items if x is not None)})
            at = batch.schema.get_field_index(state)
            yield batch.set_column(at, batch.schema.field(at), pa.array(rows, batch.schema.field(at).type))

    return run


def union(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], e)
        else:
            out.append({"start": s, "end": e})
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options: object) -> DataFrame:
    """The documents in which no window of any item occurs; columns as given."""
    name = free_name(docs, "_contamination")
    return mark_contamination(docs, items, text, into=name, **options).where(F.size(F.col(name)["spans"]) == 0).drop(name)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its hit words and the benchmark items that hit it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    c = F.col("contamination")
    out = mark_contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(c["spans"], F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", c["n_words"].alias("n_words"), hit.alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", c["items"]), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


SQL = r"""
WITH lower_docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), lower_items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM lower_items WHERE len(w) > 0)
), doc_windows AS (
  SELECT doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM lower_docs, (SELECT DISTINCT k FROM item_windows) WHERE len(w) >= k)
), found AS (
  SELECT d.doc_id, d.s, d.k, i.item_id FROM doc_windows d JOIN item_windows i ON d.k = i.k AND d.win = i.win
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT doc_id, s, k FROM found)) GROUP BY doc_id
), owners AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(o.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(o.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM lower_docs d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN owners o ON d.doc_id = o.doc_id
"""
