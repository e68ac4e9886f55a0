"""Regex matches with positions, redaction and span lists as DataFrame expressions only.

All of it runs inside the JVM: no Python worker is started.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, text, part>>: leftmost non-overlapping matches of a pattern
    that matches no empty string, in code points; ``part`` is the given group.

    The pieces between matches and the matches themselves alternate, so the running sum
    of their lengths gives the positions.
    """
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    part = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    pieces = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    parts = F.arrays_zip(whole.alias("m"), part.alias("g"), pieces.alias("n"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,text:string,part:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["2"]
        e = s + F.length(x["0"])
        # The last piece has no match after it.
        return F.when(x["0"].isNull(), acc).otherwise(F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(s.alias("start"), e.alias("end"), x["0"].alias("text"), x["1"].alias("part"))).alias("out")))

    zipped = F.transform(parts, lambda x: F.struct(x.getField("m").alias("0"), x.getField("g").alias("1"), x.getField("n").alias("2")))
    return F.when(text.rlike(pattern), F.aggregate(zipped, start, step)["out"]).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,text:string,part:string>>"))


def kept(matches: Column, test, kind: str) -> Column:  # noqa: ANN001
    """Spans of one kind from the matches that pass ``test``."""
    return F.transform(F.filter(matches, test), lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))).cast(SPAN)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_order(spans: Column, kinds: list[str], kind_first: bool) -> Column:
    """Spans sorted by start and then the place of their kind in ``kinds``, or the other way about."""
    place = F.create_map(*(x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))))
    rank = lambda s: place[s["kind"]]
    key = (lambda s: F.struct(rank(s).alias("a"), s["start"].alias("b"), s["end"].alias("c"), s["kind"].alias("kind"))) if kind_first else (lambda s: F.struct(s["start"].alias("a"), rank(s).alias("b"), s["end"].alias("c"), s["kind"].alias("kind")))
    at = "b" if kind_first else "a"
    return F.transform(F.array_sort(F.transform(spans, key)), lambda x: F.struct(x["kind"].alias("kind"), x[at].alias("start"), x["c"].alias("end"))).cast(SPAN)


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in square brackets; a span that overlaps an
    earlier one is taken with it."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("k"))))

    def step(acc: Column, x: Column) -> Column:
        gap = text.substr((acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int"))
        fresh = F.struct(x["e"].alias("at"), F.concat(acc["out"], gap, F.lit("["), x["k"], F.lit("]")).alias("out"))
        return F.when(x["s"] >= acc["at"], fresh).otherwise(F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate(ordered, start, step)
    return F.concat(done["out"], text.substr((done["at"] + 1).cast("int"), F.length(text)))
