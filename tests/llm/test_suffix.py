import hashlib
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import suffix as S


def brute(rows, depth):
    """Removed spans and kept bytes of each row, by counting every window."""
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + depth] for r in raws for i in range(len(r) - depth + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - depth + 1):
            if seen[r[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        spans = bytes(gone).split(b"\0")
        out.append((len(r), sum(gone), sum(1 for s in spans if s), bytes(b for b, g in zip(r, gone, strict=True) if not g)))
    return out


def run(df, depth):
    out = S.remove_repeats(df, depth=depth)
    got = out.select("doc_id", f"{out.columns[-1]}.*").collect()
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got)


def expected(rows, depth):
    return sorted((i is None, i or 0, *b) for (i, _), b in zip(rows, brute(rows, depth), strict=True))


@pytest.mark.parametrize("salt", [2048, 1])
def test_against_brute_force(spark, docs, monkeypatch, salt):
    monkeypatch.setattr(S, "SALT_ROWS", salt)
    r = random.Random(salt)
    words = ["lorem", "ipsum", "ä", "dolor", "sit", "7", "\U0001f600"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = text(60)
    rows = [(i, text(r.randint(0, 60)) + (shared[r.randint(0, 40) : r.randint(150, 250)] if i % 3 == 0 else "") + text(5)) for i in range(40)]
    rows += [(100, rows[3][1]), (100, rows[3][1]), (101, None), (None, ""), (None, None), (102, "Der " * 120), (103, "ab" * 31), (104, shared), (105, "x" * 64), (106, "x" * 65)]
    for depth in (64, 67):
        assert run(docs(*rows), depth) == expected(rows, depth)


def test_long_rows_and_clashing_names(spark, docs, clash, monkeypatch):
    monkeypatch.setattr(S, "STEP", 500)
    monkeypatch.setattr(S, "ROWS", 1)
    r = random.Random(5)
    long = "".join(r.choice("abcdef ") for _ in range(4000))
    rows = [(1, long), (2, "z" + long[1700:2300] + "z"), (3, long[:90] * 2)]
    df = clash(docs(*rows))
    assert run(df, 64) == expected(rows, 64)
    out = S.remove_repeats(df, depth=64)
    assert out.columns == [*(c for c in df.columns if c != "text"), "_repeats"]
    assert out.first()["_key"] == "own _key"
    assert run(docs(*rows).limit(0), 64) == []


def test_radix_groups_are_the_equal_windows():
    import numpy as np

    raw = np.frombuffer(b"abcabcabcabcabcabcabcabcxyz", np.uint8)
    index, group = S.radix_groups(raw, np.arange(12), np.zeros(12, np.int64), 12)
    by = {}
    for i, g in zip(index.tolist(), group.tolist(), strict=True):
        by.setdefault(g, set()).add(i)
    assert sorted(map(sorted, by.values())) == [[0, 3, 6, 9], [1, 4, 7, 10], [2, 5, 8, 11]]


def test_query_on_the_small_table(spark, sf_dir):
    rows = duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.op1_suffix_dedup(spark, sf_dir).collect()}
    assert got == {i: (n, g, s, hashlib.sha256(k).hexdigest()) for (i, _), (n, g, s, k) in zip(rows, brute(rows, 200), strict=True)}
    assert F is not None


def test_words_that_polynomial_hashes_confuse(docs):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, "x" + word[:700])]
    assert run(docs(*rows), 200) == expected(rows, 200)
