"""Personal data: information-theoretic sanitisation, in DataFrame functions only.

Protected entities are e-mail and IP addresses, payment cards and telephone numbers. A
term near an entity may tell who is meant even when the entity is gone. How strongly is
estimated from co-occurrence over all documents: with N documents, n(e) and n(t) that
hold the entity and the term, and n(e,t) that hold both, anywhere, the term discloses

    log2(N n(e,t) / (n(e) n(t))) / log2(N / n(e))

of the entity's information (1: whoever sees the term knows the entity). Terms of at least
``support`` common documents whose disclosure reaches ``generalise`` are replaced by a
class ("term"), those that reach ``remove`` are taken out ("removed"), wherever they
stand in the texts that hold that entity.

Only entities and terms of ``support`` documents are paired, and only where
n(t) <= n(e)^g N^(1-g) with g = ``generalise``: as n(e,t) <= n(e), no other term reaches g.
Entities of the same texts are one class, and so are terms of the same texts and number; classes
are paired, so a text of many addresses and words is not their product.

``support`` is a part of the definition: a term that met an entity once discloses all by
the formula, as would any other word of that text. An entity that all documents hold has nothing
to disclose.

Defined results: a null text is empty; every row counts as a document, repeated ones
too; equal texts get equal spans; an empty table gives no rows; other columns are kept,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.native import SPAN, found, in_order, kept, listed, no_spans
from millrace.llm.shared import free_name, materialize, table, text_digest

#: Starts are pinned to where a run begins (or the last match ended) and runs are possessive,
#: so that long runs cost linear time; the matches are the same.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Maximal runs, so the least number of digits can stand in the pattern.
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]{2,}+"
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "term", "removed"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m["text"], "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def entities(text: Column) -> Column:
    """Base spans with their texts, by kind and start."""

    def of(kind: str, pattern: str, test) -> Column:  # noqa: ANN001
        return F.transform(F.filter(found(text, pattern), test), lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text")))

    def small(m: Column) -> Column:
        return F.forall(F.split(m["text"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))

    return F.concat(
        of("email", EMAIL, lambda m: F.lit(True)),
        of("ip", IP, small),
        of("card", CARD, lambda m: F.when(F.length(_digits(m)).between(13, 19), luhn(_digits(m))).otherwise(False)),
        of("phone", PHONE, lambda m: F.length(_digits(m)).between(9, 15)),
    )


def classed(rows: DataFrame, name: str) -> DataFrame:
    """Rows (k, name, ...), each (k, name) once, with a class of two columns: equal for values that have
    the same set of k, by 128 bits."""
    one, two = F.bit_xor(F.xxhash64("k")).alias(f"{name}_1"), F.bit_xor(F.xxhash64(F.lit(name), "k")).alias(f"{name}_2")
    return rows.join(rows.groupBy(name).agg(one, two), name)


def scan_pii(docs: DataFrame, text: str = "text", support: int = 3, generalise: float = 0.8, remove: float = 0.95, into: str = "pii") -> DataFrame:
    """``docs`` without the text, and with ``into``: array of (kind, start, end) in code
    points by kind and start, base ones and disclosing terms."""
    key, ents, held_text, other, told_terms = (free_name(docs, n) for n in ("_key", "_entities", "_held_text", "_k", "_terms"))
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # The text stays only where there is an entity.
    seen = docs.withColumns({key: text_digest(value), ents: entities(value)}).withColumn(held_text, F.when(F.size(ents) > 0, value))
    scanned = materialize(seen.drop(text), "pii")
    total = scanned.count()

    names = F.array_distinct(F.transform(ents, lambda e: F.concat_ws(":", e["kind"], F.lower(e["text"]))))
    # Copies of a text count as often as it occurs.
    texts = scanned.where(F.size(ents) > 0).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("times"), F.first(names).alias("names"))
    held = texts.select("k", "times", F.explode("names").alias("entity"))
    holds = held.groupBy("entity").agg(F.sum("times").alias("n_e")).where((F.col("n_e") >= support) & (F.col("n_e") < total))
    held = classed(materialize(held.join(holds, "entity"), "held"), "entity").select("k", "times", "entity_1", "entity_2", "n_e").distinct()
    held = materialize(held, "held-classes")
    bound = lambda n: F.pow(n.cast("double"), F.lit(generalise)) * float(total) ** (1 - generalise) * (1 + 1e-9)
    most = held.agg(F.max("n_e")).first()[0] or 0

    words_of = lambda t: F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    terms_of = lambda t: F.array_distinct(F.transform(words_of(t), lambda w: F.lower(w)))
    spread = docs.select(F.explode(terms_of(value)).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")).where((F.col("n_t") >= support) & (F.col("n_t") <= bound(F.lit(most))))
    # One row a text that holds a counted entity.
    whole = scanned.where(F.size(ents) > 0).select(F.col(key).alias("k"), F.col(held_text).alias("t")).join(held.select("k").distinct(), "k", "left_semi").dropDuplicates(["k"])
    used = materialize(whole.select("k", F.explode(terms_of(F.col("t"))).alias("term")).join(spread, "term"), "used")
    used = materialize(classed(used, "term"), "used-classes")
    pair = ["entity_1", "entity_2", "n_e", "term_1", "term_2", "n_t"]
    near = held.join(used.select("k", "term_1", "term_2", "n_t").distinct(), "k").where(F.col("n_t") <= bound(F.col("n_e")))
    pairs = near.groupBy(*pair).agg(F.sum("times").alias("n_et")).where(F.col("n_et") >= support)
    told = F.log2(F.lit(float(total)) * F.col("n_et") / (F.col("n_e") * F.col("n_t"))) / F.log2(F.lit(float(total)) / F.col("n_e"))
    strong = materialize(pairs.withColumn("told", told).where(F.col("told") >= generalise).select(*pair, "told"), "strong")
    # Which terms of a text a class of its entities tells of.
    of_text = held.join(strong, pair[:3]).select("k", *pair[3:], "told").join(used, ["k", *pair[3:]])
    hits = materialize(of_text.groupBy("k", "term").agg(F.max("told").alias("told")), "hits")

    # A word starts after all gaps and words before it.
    told_texts = whole.join(hits.select("k").distinct(), "k", "left_semi")
    gaps = F.transform(F.split("t", WORD, -1), lambda x: F.length(x).cast("long"))
    placed = told_texts.select("k", F.posexplode(F.arrays_zip(words_of(F.col("t")).alias("w"), gaps.alias("gap")))).select("k", "pos", "col.w", "col.gap").where("w IS NOT NULL")
    end = F.sum(F.col("gap") + F.length("w")).over(Window.partitionBy("k").orderBy("pos"))
    placed = placed.withColumn("end", end).select("k", F.lower("w").alias("term"), (F.col("end") - F.length("w")).alias("start"), "end")
    kind = F.when(F.col("told") >= remove, "removed").otherwise("term")
    by_text = placed.join(hits, ["k", "term"]).groupBy(F.col("k").alias(other)).agg(F.collect_list(F.struct(kind.alias("kind"), "start", "end")).cast(SPAN).alias(told_terms))

    out = scanned.join(by_text, scanned[key] == by_text[other], "left")
    base = F.transform(ents, lambda e: F.struct(e["kind"].alias("kind"), e["start"].alias("start"), e["end"].alias("end"))).cast(SPAN)
    apart = F.filter(F.coalesce(told_terms, no_spans()), lambda t: ~F.exists(ents, lambda e: (e["start"] < t["end"]) & (t["start"] < e["end"])))
    return out.select(*(c for c in docs.columns if c != text), in_order(F.concat(base, apart), KINDS, kind_first=True).alias(free_name(docs, into)))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data: counts and digest of the base spans, and all spans."""
    out = scan_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(BASE))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
