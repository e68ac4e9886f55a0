"""Line dedup: a log-template tree over the lines of all documents.

A line is parsed at fixed depth: level one is its number of tokens, the next levels are
its ``DEPTH`` leading tokens; tokens that hold a digit, an @ or ://, or are <*>, are
variable and count as <*>. Lines of one leaf whose tokens agree in ``SHARE`` of the
places (places variable in both do not count) have one template, in which the places
that differ are variable as well. A template that recurs in enough distinct documents is
dropped, except in the document with the smallest id that holds it.

Only leaves of several different lines are looked at further, and within them no line is
compared with every other. The places after the lead fall into one more block than lines
that agree may differ in, so two such lines share a block. In each block's bucket the line of the most documents (by powers of two; ties go to the
greater MD5) is the model. A line takes the template of the best model with which it
agrees, its own where there is none. Work is linear in the tokens, and buckets are
aggregated before they are joined, so neither a common line nor a common block gathers
in one task.

How many documents a template needs: ``least_docs`` with ``least_tokens`` tokens or
more, ``LONG_DOCS`` with more than ``LONG_TOKENS``. Shorter lines are dropped only if
they have no variable token: from ``SHORT_DOCS`` on, from ``least_docs`` on if they have
``SHORT_CHARS`` characters (scripts without blanks).

Defined results: a null text stays null and has no lines; a line without tokens stays;
copies of a document and repeated rows count as documents by their distinct ids, and all
rows with a null id as one document; a line stays in every row with the smallest id (rows with a
null id where no other holds it); a document all of whose lines go keeps an empty text;
an empty table gives no rows; other columns are kept, whatever their names (a new column
whose name is taken gets underscores before it).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh32_intdigest, xxh64_intdigest

from millrace.llm.shared import Scratch, free_name, materialize, table

LEAST_DOCS, LEAST_TOKENS, DEPTH, SHARE = 3, 5, 3, 0.8
LONG_TOKENS, LONG_DOCS, SHORT_DOCS, SHORT_CHARS = 50, 2, 10, 40
VARIABLE = re.compile(rb"[0-9@]|://|^<\*>$")
#: Tokens and lines that a task remembers, and the longest such token.
REMEMBERED, TOKEN_BYTES = 1 << 17, 64
#: Most recurring lines that are sent to every task; above it they are joined by a shuffle.
BROADCAST_TEMPLATES = 150_000


class _Codes(dict):
    """A 32-bit code for each token; 0 where it is variable."""

    def __missing__(self, token: bytes) -> int:
        code = 0 if VARIABLE.search(token) else xxh32_intdigest(token) or 1
        if len(token) <= TOKEN_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = code
        return code


def leaf(codes: bytes) -> int:
    """Key of a line's leaf: its number of tokens and the leading ones."""
    return xxh64_intdigest((len(codes) // 4).to_bytes(4, "little") + codes[: 4 * DEPTH])


def blocks(codes: bytes, share: float = SHARE) -> list[int]:
    """Keys of a line's blocks: its leaf, the number of the block and the tokens in it."""
    n = len(codes) // 4
    k, rest = int((1 - share) * n + 1e-9) + 1, n - DEPTH
    head = leaf(codes).to_bytes(8, "little")
    return [xxh64_intdigest(head + codes[4 * (DEPTH + rest * i // k) : 4 * (DEPTH + rest * (i + 1) // k)], i) for i in range(k)]


def rank(docs: int, digest: bytes) -> int:
    """More documents first, by powers of two, then the greater digest, as one integer."""
    return docs.bit_length() << 57 | int.from_bytes(digest[:8], "big") >> 7


def agree(a: np.ndarray, b: np.ndarray, share: float = SHARE) -> bool:
    same = a == b
    count = len(a) - int(np.count_nonzero(same & (a == 0)))
    return int(np.count_nonzero(same & (a != 0))) >= share * count - 1e-9


def _signed(values: array) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _parse(least_docs: int, least_tokens: int):  # noqa: ANN202
    """Map function from (id, row key, text) to the lines that may be dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _Codes(), set()
        code = known.__getitem__
        for b in batches:
            row, pos, digest, need, leaves, tokens = [], array("i"), [], array("i"), array("Q"), []
            for r, text in enumerate(b.column(2).to_pylist()):
                for p, line in enumerate(text.split(b"\n") if text is not None else ()):
                    words = line.split()
                    n = len(words)
                    if not n:
                        continue
                    codes = array("I", map(code, words))
                    varies = 0 in codes
                    masked = b" ".join([w if c else b"<*>" for w, c in zip(words, codes, strict=True)] if varies else words)
                    if n >= least_tokens:
                        docs = LONG_DOCS if n > LONG_TOKENS else least_docs
                    elif varies:
                        continue
                    else:
                        docs = least_docs if len(masked.decode()) >= SHORT_CHARS else SHORT_DOCS
                    h = md5(masked, usedforsecurity=False).digest()
                    row.append(r)
                    pos.append(p)
                    digest.append(h)
                    need.append(docs)
                    c = codes.tobytes()
                    leaves.append(leaf(c))
                    if n < least_tokens or h in seen:  # a line's tokens are needed once
                        c = b""
                    elif len(seen) >= REMEMBERED:
                        seen.clear()
                    else:
                        seen.add(h)
                    tokens.append(c)
            at = pa.array(row, pa.int64())
            columns = [b.column(0).take(at), b.column(1).take(at), pa.array(np.array(pos, np.int32)), pa.array(digest, pa.binary()), pa.array(np.array(need, np.int32)), _signed(leaves), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "x", "pos", "h", "need", "leaf", "tokens"])

    return run


def _placing(share: float):  # noqa: ANN202
    """Map function from (h, docs, tokens) to a row for each block of each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = b.column(0).to_pylist()
            keys = [blocks(t, share) for t in b.column(2).to_pylist()]
            ranks = _signed(array("Q", map(rank, b.column(1).to_pylist(), digests)))
            at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            yield pa.RecordBatch.from_arrays([_signed(array("Q", (x for k in keys for x in k))), ranks.take(at), b.column(0).take(at)], names=["key", "rank", "h"])

    return run


def _agreeing(share: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, m = ([np.frombuffer(x, "<u4") for x in b.column(c).to_pylist()] for c in ("tokens", "model_tokens"))
            yield b.select(["h", "m", "rank"]).filter(pa.array([agree(x, y, share) for x, y in zip(a, m, strict=True)], pa.bool_()))

    return run


def templates(lines: DataFrame, stats: DataFrame, scratch: Scratch, share: float = SHARE) -> DataFrame:
    """(h, m): lines that take the template of another line ``m``."""
    full = stats.where("leaf IS NOT NULL")
    several = full.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1").select("leaf")
    asked = full.join(several, "leaf", "left_semi").select("h", "docs")
    tokens = lines.where(F.length("tokens") > 0).select("h", "tokens").join(asked, "h").select("h", "docs", "tokens")
    tokens = scratch.table(tokens.dropDuplicates(["h"]), "tokens", "zstd")
    placed = scratch.table(tokens.mapInArrow(_placing(share), "key long, rank long, h binary"), "placed")
    shared = placed.groupBy("key").agg(F.min("rank").alias("least"), F.max("rank").alias("top")).where("least < top").select("key", "top")
    met = scratch.table(placed.join(shared, "key"), "buckets")
    models = met.where("rank = top").groupBy("key").agg(F.min("h").alias("m"))
    pairs = met.where("rank < top").select("key", "h", F.col("top").alias("rank")).join(models, "key").select("h", "m", "rank").distinct()
    both = pairs.join(tokens.select("h", "tokens"), "h").join(tokens.select(F.col("h").alias("m"), F.col("tokens").alias("model_tokens")), "m")
    alike = both.select("h", "m", "rank", "tokens", "model_tokens").mapInArrow(_agreeing(share), "h binary, m binary, rank long")
    return alike.groupBy("h").agg(F.max(F.struct("rank", "m")).alias("best")).select("h", "best.m")


def drop_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least_docs: int = LEAST_DOCS, least_tokens: int = LEAST_TOKENS, share: float = SHARE, into: str = "line_dedup") -> DataFrame:
    """``docs`` with the text less its dropped lines, and a struct column (n_lines, n_dropped)."""
    if least_tokens < DEPTH + 1:
        raise ValueError(f"least_tokens must exceed the depth of {DEPTH}")
    value = F.col(text).cast("string")
    row_key = F.xxhash64(value)
    texts = docs.select(F.col(id_col).alias("id"), row_key.alias("x"), value.cast("binary").alias("t"))
    found = StructType.fromDDL("pos int, h binary, need int, leaf long, tokens binary")
    schema = StructType([*texts.schema.fields[:2], *found.fields])
    scratch = Scratch(docs.sparkSession)
    lines = scratch.table(texts.mapInArrow(_parse(least_docs, least_tokens), schema), "lines", "zstd")
    # A document counts once for a line, however often and in however many rows it has it.
    in_tree = F.when(F.length("tokens") > 0, F.col("leaf"))
    held = lines.groupBy("h", "id").agg(F.min("need").alias("need"), F.min(in_tree).alias("leaf"))
    stats = scratch.table(held.groupBy("h").agg(F.count("*").alias("docs"), F.min("id").alias("first"), F.min("need").alias("need"), F.min("leaf").alias("leaf")), "stats")
    merged = scratch.table(templates(lines, stats, scratch, share), "merged")

    touched = merged.select("h").union(merged.select("m")).distinct()
    groups = touched.join(merged, "h", "left").select("h", F.coalesce("m", "h").alias("m"))
    in_group = lines.select("h", "id", "need").join(groups, "h").groupBy("m", "id").agg(F.min("need").alias("need"))
    of_groups = in_group.groupBy("m").agg(F.count("*").alias("docs"), F.min("id").alias("first"), F.min("need").alias("need")).where("docs >= need")
    grouped = groups.join(of_groups.select("m", "first"), "m").select("h", "first")
    alone = stats.where("docs >= need").join(touched, "h", "left_anti").select("h", "first")
    often = scratch.table(alone.union(grouped), "often")
    if often.count() <= BROADCAST_TEMPLATES:
        often = F.broadcast(often)
    gone = lines.select("id", "x", "pos", "h").join(often, "h").where(~F.col("id").eqNullSafe(F.col("first"))).groupBy("id", "x").agg(F.collect_set("pos").alias("gone"))

    x, gone_id, gone_x, places = (free_name(docs, n) for n in ("_x", "_gone_id", "_gone_x", "_gone"))
    gone = materialize(gone.withColumnsRenamed({"id": gone_id, "x": gone_x, "gone": places}), "gone")
    scratch.clear()
    keyed = docs.withColumn(x, row_key)
    joined = keyed.join(gone, (keyed[x] == gone[gone_x]) & keyed[id_col].eqNullSafe(gone[gone_id]), "left")
    split = F.split(value, "\n")
    # Set difference of the places, which hashes; a text of many lines stays linear.
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(places))
    # Lines are bound to a variable, or they would be split again for each line.
    kept = F.transform(F.array(split), lambda own: F.array_join(F.transform(left, lambda i: F.get(own, i)), "\n"))[0]
    n_lines = F.when(value.isNull(), 0).when(F.col(places).isNotNull(), F.size(split)).otherwise(F.length(value) - F.length(F.replace(value, F.lit("\n"), F.lit(""))) + 1)
    count = F.struct(n_lines.cast("long").alias("n_lines"), F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_dropped"))
    new_text = F.when(F.col(places).isNull(), value).otherwise(kept)
    return joined.select(*(new_text.alias(text) if c == text else keyed[c] for c in docs.columns), count.alias(free_name(docs, into)))


def dedup_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: str = "n_chars") -> DataFrame:
    """``drop_lines`` with the columns as given; ``length``, where there is one, follows the text."""
    out = drop_lines(docs, text, id_col).select(*docs.columns)
    if length in docs.columns:
        out = out.withColumn(length, F.when(F.col(text).isNotNull(), F.length(text)).otherwise(F.col(length)).cast(docs.schema[length].dataType))
    return out


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text."""
    out = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("line_dedup.n_lines").alias("n_lines"), F.col("line_dedup.n_dropped").alias("n_dropped"), "text")


SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, array_to_string(w, ' ') AS t, w, len(w) AS n
  FROM (
    SELECT doc_id, pos, line, list_transform(
             list_filter(regexp_split_to_array(line, '[ \t\r\x0b\x0c]+'), lambda x: x <> ''),
             lambda x: CASE WHEN regexp_matches(x, '[0-9@]|://') THEN '<*>' ELSE x END) AS w
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
          FROM documents WHERE text IS NOT NULL))
), counted AS (
  SELECT *, CASE WHEN n > 50 THEN 2 WHEN n >= 5 THEN 3 WHEN n = 0 OR list_contains(w, '<*>') THEN NULL
                 WHEN length(t) >= 40 THEN 3 ELSE 10 END AS need
  FROM lines
), stats AS (
  SELECT t, any_value(w) AS w, any_value(n) AS n, any_value(need) AS need, md5(t) AS h,
         length(bin(count(DISTINCT doc_id))) AS size
  FROM counted WHERE need IS NOT NULL GROUP BY t
), placed AS (
  SELECT t, h, size, w, n, i, list_slice(w, 1, 3) AS lead,
         list_slice(w, 4 + (n - 3) * i // k, 3 + (n - 3) * (i + 1) // k) AS part
  FROM (SELECT *, n // 5 + 1 AS k, unnest(range(0, n // 5 + 1)) AS i FROM stats WHERE n >= 5)
), models AS (
  SELECT n, lead, i, part, arg_max(t, (size, h)) AS m, arg_max(w, (size, h)) AS mw, max((size, h)) AS rank
  FROM placed GROUP BY n, lead, i, part HAVING count(*) > 1
), pairs AS (
  SELECT DISTINCT p.t, p.w, m.m, m.mw, m.rank
  FROM placed p JOIN models m ON p.n = m.n AND p.lead = m.lead AND p.i = m.i AND p.part = m.part
  WHERE p.t <> m.m
), alike AS (
  SELECT t, m, rank, list_zip(w, mw) AS z FROM pairs
), merged AS (
  SELECT t, arg_max(m, rank) AS m FROM alike
  WHERE 5 * len(list_filter(z, lambda x: x[1] = x[2] AND x[1] <> '<*>'))
        >= 4 * len(list_filter(z, lambda x: x[1] <> x[2] OR x[1] <> '<*>'))
  GROUP BY t
), grouped AS (
  SELECT c.*, coalesce(g.m, c.t) AS template FROM counted c LEFT JOIN merged g ON c.t = g.t
), often AS (
  SELECT template, min(doc_id) AS first_id FROM grouped WHERE need IS NOT NULL
  GROUP BY template HAVING count(DISTINCT doc_id) >= min(need)
), marked AS (
  SELECT g.doc_id, g.pos, g.line, g.need IS NOT NULL AND o.template IS NOT NULL AND g.doc_id <> o.first_id AS gone
  FROM grouped g LEFT JOIN often o ON g.template = o.template
), rebuilt AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(r.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n_dropped, 0) AS BIGINT) AS n_dropped,
       CASE WHEN d.text IS NULL THEN NULL ELSE r.text END AS text
FROM documents d LEFT JOIN rebuilt r ON d.doc_id = r.doc_id
"""
