"""Secret scan: multipart credential linking, in DataFrame functions only.

Strong parts are reported as they are: assigned secrets, access identifiers and long
hexadecimal strings. Weak parts (a named user, a short or unnamed secret, an endpoint)
say little alone; they are reported only where an interval join finds a complementary
part within ``reach`` characters of the same text: a user needs a secret, a secret needs
an identifier or an endpoint, an endpoint needs a secret. The join is a semi-join on
(text, cell of ``reach`` characters), so it emits no pairs and a dense text is compared
cell by cell.

Defined results: a null text is empty; equal texts get equal spans, repeated rows a row
each; an empty table gives no rows; other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.native import SPAN, found, in_order, kept, listed, no_spans
from millrace.llm.shared import free_name, materialize, table, text_digest

REACH = 200
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Maximal runs, so their least lengths can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
USER = r"""(?i:\b(?:user(?:_?name)?|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})"""
#: Unnamed: a long run of letters and digits that has both cases and digits.
KEY = r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{20,}+"
ENDPOINT = r"""\bhttps?://[A-Za-z0-9.-]+(?::[0-9]+)?|(?i:\b(?:host|endpoint|server|db_?url))["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{4,}"""
KINDS = ["assign", "access", "hex", "user", "short", "key", "endpoint"]
BASE = KINDS[:3]
ROLE = {"assign": "secret", "hex": "secret", "short": "secret", "key": "secret", "access": "name", "user": "name", "endpoint": "place"}
WEAK = {"user": ["secret"], "short": ["name", "place"], "key": ["name", "place"], "endpoint": ["secret"]}


def strong_and_weak(text: Column) -> tuple[Column, Column]:
    """(base spans, weak spans), each an array."""
    assigned = found(text, ASSIGN, 2)
    always = lambda m: F.lit(True)
    base = F.concat(kept(assigned, lambda m: F.length(m["part"]) >= 12, "assign"), kept(found(text, ACCESS), always, "access"), kept(found(text, HEX), always, "hex"))
    weak = F.concat(kept(assigned, lambda m: F.length(m["part"]).between(6, 11), "short"), kept(found(text, USER), always, "user"), kept(found(text, KEY), always, "key"), kept(found(text, ENDPOINT), always, "endpoint"))
    return base, weak


def scan_secrets(docs: DataFrame, text: str = "text", reach: int = REACH, into: str = "secrets") -> DataFrame:
    """``docs`` without the text, and with ``into``: array of (kind, start, end) in code
    points by start and kind, base and linked ones."""
    key, strong, weak, other, more_spans = (free_name(docs, n) for n in ("_key", "_strong", "_weak", "_k", "_linked"))
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base, more = strong_and_weak(value)
    # One pass over the texts; what it finds is small.
    seen = docs.withColumns({key: text_digest(value), strong: base, weak: more})
    # A weak part that overlaps a strong one is the same thing.
    alone = F.filter(F.col(weak), lambda w: ~F.exists(F.col(strong), lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    scanned = materialize(seen.withColumn(weak, alone).drop(text), "secrets")

    role = F.create_map(*(F.lit(x) for kv in ROLE.items() for x in kv))
    needs = F.create_map(*(x for k, v in WEAK.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    parts = scanned.where(F.size(weak) > 0).select(F.col(key).alias("k"), F.explode(F.concat(strong, weak)).alias("p")).select("k", "p.*").distinct()
    cells = F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("end") / reach)))
    others = parts.select(F.col("k").alias("ok"), role[F.col("kind")].alias("orole"), F.col("start").alias("os"), F.col("end").alias("oe"), cells.alias("ocell"))
    near = F.explode(F.sequence(F.floor(F.col("start") / reach) - 1, F.floor(F.col("end") / reach) + 1))
    asking = parts.where(F.col("kind").isin(list(WEAK))).select("k", "kind", "start", "end", F.explode(needs[F.col("kind")]).alias("need")).select("*", near.alias("cell"))
    meets = (F.col("k") == F.col("ok")) & (F.col("cell") == F.col("ocell")) & (F.col("need") == F.col("orole")) & (F.col("os") - F.col("end") <= reach) & (F.col("start") - F.col("oe") <= reach)
    linked = asking.join(others, meets, "left_semi").groupBy(F.col("k").alias(other)).agg(F.collect_set(F.struct("kind", "start", "end")).cast(SPAN).alias(more_spans))
    out = scanned.join(linked, scanned[key] == linked[other], "left")
    spans = in_order(F.concat(strong, F.coalesce(more_spans, no_spans())), KINDS, kind_first=False)
    return out.select(*(c for c in docs.columns if c != text), spans.alias(free_name(docs, into)))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its secrets: counts and digest of the base ones, and all spans."""
    out = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin(BASE))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
