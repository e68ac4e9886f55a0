import re

import pytest

from millrace.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(texts, items, window):
    out = []
    for i, t in texts:
        w, hit, found = WORD.findall(low(t)), set(), set()
        for k, it in items:
            iw = WORD.findall(low(it))
            n = min(window, len(iw))
            wins = {tuple(iw[s : s + n]) for s in range(len(iw) - n + 1)} if n else set()
            for s in range(len(w) - n + 1):
                if n and tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found.add(k)
        out.append((i is None, i or 0, len(w), len(hit), sorted(str(k) for k in found if k is not None)))
    return sorted(out)


TEXTS = [
    (1, "Über the quick BROWN fox; jumps over the lazy dog. again the quick brown fox jumps over"), (2, "quick brown"), (3, None), (4, ""), (None, "the lazy dog"), (5, "a b a b a b a b a"), (6, "straße Ⅷ x\x7fy ÅNGSTRÖM"), (6, "straße Ⅷ x\x7fy ÅNGSTRÖM"),
    (7, "word " * 3000 + "the quick brown fox jumps"), (8, "quick"), (9, "brown fox the"), (10, "clean text without any of it"),
]
ITEMS = [(1, "the quick brown fox jumps over the lazy dog"), (2, "A b"), (3, None), (4, "..."), (5, "Straße ⅷ"), (6, "straße Ⅷ X"), (None, "lazy dog"), (10, "the lazy dog"), (10, "the lazy dog")]


@pytest.mark.parametrize("block", [1, 16 << 20])
def test_against_brute_force(spark, docs, clash, monkeypatch, block):
    monkeypatch.setattr(D, "STEP", 64)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = D.mark_contamination(clash(docs(*TEXTS)), items, window=4, block_bytes=block if block > 1 else 30)
    got = sorted((r.doc_id is None, r.doc_id or 0, r["_contamination"].n_words, sum(s.end - s.start for s in r["_contamination"].spans), list(r["_contamination"]["items"])) for r in out.collect())
    assert got == brute(TEXTS, ITEMS, 4)
    kept = D.drop_contaminated(docs(*TEXTS), items, window=4)
    assert kept.columns == docs().columns if TEXTS is None else True
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for n, i, _, h, _ in brute(TEXTS, ITEMS, 4) if not h)


def test_empty_tables(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.mark_contamination(docs(*TEXTS).limit(0), items).collect() == []
    assert all(not r.contamination.spans for r in D.mark_contamination(docs(*TEXTS), items.limit(0)).collect())


def test_one_index_at_a_time(spark, docs, monkeypatch):
    made = []
    monkeypatch.setattr(D, "materialize", lambda df, name: made.append(name) or df.sparkSession.createDataFrame(df.collect(), df.schema))
    items = spark.createDataFrame([(i, f"item number {i} of the benchmark") for i in range(40)], "item_id long, text string")
    out = D.mark_contamination(docs((1, "the item number 7 of the benchmark"), (2, "clean")), items, window=4, block_bytes=300)
    assert len(made) >= 3
    assert out._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    assert {r.doc_id: list(r.contamination["items"]) for r in out.collect()}[2] == []
    assert "7" in {r.doc_id: list(r.contamination["items"]) for r in out.collect()}[1]
