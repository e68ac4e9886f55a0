"""Alignment of two tokenizers against a plain two-pointer walk."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from millrace.llm import align as A
from millrace.llm.tokens import byte_level_entries

BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    "Plain words, and numbers 12,345.67.", "", None, " ", "  two  blanks ", "\n\n\tx\r\n", "Größe über Straße", "日本語のテキスト 🙂🙃 é", "a▁b", "<0x41> <s> </s> <unk>", "<|endoftext|> in it",
    "x" * 3000, "naïve café" * 50, "\u0000\u0001", "﻿BOM", "ａｂｃ fullwidth", "é combining", "same text", "same text", "1" * 50,
]


def brute(rows):
    """{row number: result} by walking two pointers over the tokens of each document."""
    first, second = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
    first.encode_special_tokens = True
    entries, pieces = byte_level_entries(BYTES), A.piece_entries(second)
    docs, counts = [], Counter()
    for _, text in rows:
        a, b, groups, links = [], [], [], []
        if text:
            raw = f" {text}".encode()
            a, b = first.encode(f" {text}", add_special_tokens=False).ids, second.encode(text)
            if b"".join(entries[x] for x in a) != raw or b"".join(pieces[x] for x in b) != raw:
                a, b = [], []
        i = j = at_a = at_b = 0
        left, right = [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                left.append(a[i])
                at_a, i = at_a + len(entries[a[i]]), i + 1
            else:
                right.append(b[j])
                at_b, j = at_b + len(pieces[b[j]]), j + 1
            if at_a == at_b and left and right:
                groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                links.append((left[-1], right[-1]))
                left, right = [], []
        counts.update(links)
        docs.append((len(a), len(b), groups, links))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for (doc, _), (n_a, n_b, groups, links) in zip(rows, docs, strict=True):
        best = sum(counts[x] == top[x[1]] for x in links)
        out.append((doc, n_a, n_b, len(groups), len(links), best, sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr), counts


def aligned(docs):
    found, counts = A.align(docs, BYTES, PIECES)
    cols = ["id", *A.COUNTS, "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[c] for c in cols) for r in found.collect()), key=repr), {(r.link >> 32, r.link & 0xFFFFFFFF): r["count"] for r in counts.collect()}


def test_odd_texts(spark, docs, monkeypatch):
    rows = [(i, t) for i, t in enumerate(ODD)]
    want, counts = brute(rows)
    assert sum(r[1] > 0 for r in want) > 12 and [r for r in want if r[0] == 1][0][1:] == (0, 0, 0, 0, 0, 0, "")
    assert aligned(docs(*rows).repartition(3)) == (want, dict(counts))
    assert aligned(docs(*rows, *rows[:3])) == (brute(rows + rows[:3])[0], dict(brute(rows + rows[:3])[1]))


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want, counts = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert aligned(docs) == (want, dict(counts))


def test_a_text_that_no_side_spells_does_not_spoil_its_neighbours():
    tokenizers = A.Tokenizers(BYTES, PIECES)
    alone = [list(A.aligned_texts(tokenizers, [t or ""]))[0] for t in ODD]
    for one, many in zip(alone, A.aligned_texts(tokenizers, [t or "" for t in ODD]), strict=True):
        assert one[:4] == many[:4] and list(one[4]) == list(many[4]) and list(one[5]) == list(many[5])


def test_links_are_bounded_by_the_vocabularies(spark, sf_dir):
    entries, pieces = byte_level_entries(BYTES), A.piece_entries(SentencePieceProcessor(model_file=PIECES))
    assert A.possible_links(entries, pieces) < 400_000
    small_a, small_b = [b"ab", b"b", b"", b"cab"], [b"b", b"b", b"xab", b"ab"]
    assert A.possible_links(small_a, small_b) == sum(bool(x and y) and (x.endswith(y) or y.endswith(x)) for x in small_a for y in small_b)
    for link in A.align(spark.read.parquet(f"{sf_dir}/documents.parquet"), BYTES, PIECES)[1].collect():
        x, y = entries[link.link >> 32], pieces[link.link & 0xFFFFFFFF]
        assert x.endswith(y) or y.endswith(x)


@pytest.mark.parametrize("n", [0, 1])
def test_empty_table_and_clashing_columns(spark, docs, n):
    df = docs(*[(7, "a text")] * n) if n else spark.createDataFrame([], "doc_id long, text string")
    wide = df.withColumns({c: F.lit("own") for c in ("row", "id", "links", "times", "link", "count", "n_a", "most_a", "at", "n")})
    assert aligned(wide)[0] == (brute([(7, "a text")])[0] if n else [])


def test_the_counts_do_not_shuffle_documents(spark, sf_dir):
    found, _ = A.align(spark.read.parquet(f"{sf_dir}/documents.parquet"), BYTES, PIECES)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
