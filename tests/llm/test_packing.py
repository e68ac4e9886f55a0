import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.byte_bpe_path())


def check(rows, texts, tokenizer, window):
    """Pieces tile every document and every sequence, and hold the right ids."""
    todo = {}
    for i, t in texts:
        todo.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    total = 0
    for i in todo:
        own = [r for r in rows if r.id == i]
        total += len(own)
        want = sorted((s, tuple(ids[s : s + window]), len(ids)) for ids in todo[i] for s in range(0, len(ids), window))
        assert sorted((r.start, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.doc_tokens) for r in own) == want
    assert total == len(rows)
    by = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return by


def test_pieces(spark, docs, clash, tokenizer):
    r = random.Random(1)
    texts = [(i, " ".join(r.choice(["alpha", "beta's", "7", "é", "\n", "xyz12"]) for _ in range(r.randint(0, 60)))) for i in range(60)]
    texts += [(100, None), (None, ""), (101, "  two  blanks \n end "), (102, "a<|endoftext|>b"), (103, "w " * 700), (4, texts[4][1]), (None, None)]
    by = check(P.pack(clash(docs(*texts)), P.byte_bpe_path(), window=32).collect(), texts, tokenizer, 32)
    used = sum(n for s in by.values() for _, n in s)
    assert used / (32 * len(by)) > 0.9
    assert P.pack(docs(*texts).limit(0), P.byte_bpe_path()).collect() == []


def test_blocks(docs, tokenizer, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BYTES", 200)
    texts = [(i, f"word{i} " * (i % 9)) for i in range(50)]
    check(P.pack(docs(*texts).coalesce(1), P.byte_bpe_path(), window=16).collect(), texts, tokenizer, 16)


def test_both_libraries_agree_on_code_points(tokenizer):
    enc = P.encoder(P.byte_bpe_path())
    assert enc.fast is not None
    points = [c for c in (*range(0x3100), *range(0x3100, 0x110000, 37)) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}1{chr(c)}, {chr(c)} {chr(c)}b {chr(c)}{chr(c)}\n{chr(c)}'s" for c in points]
    want = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [np.array(w.ids, "<u4").tobytes() for w in want] == enc.encode(texts)


def test_other_tokenizers_are_left_to_their_library(tmp_path, monkeypatch):
    import public_tokenizers

    assert P.Encoder(public_tokenizers.path("word_bpe_49k.json")).fast is None
    enc, texts = P.Encoder(P.byte_bpe_path()), ["some words", " " * 5000 + "x", "\n" * 3000, "a" * 5000, "", "<|endoftext|>"]
    fast = enc.encode(texts)
    monkeypatch.setattr(P, "LONG", -1)
    assert enc.encode(texts) == fast


def test_encoder_on_odd_texts(tokenizer):
    r = random.Random(2)
    parts = [*"ab '\n\t.,1é　\x1c<|\x00 ", "  ", " a", "'s", "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(4000)]
    got = P.encoder(P.byte_bpe_path()).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_best_fit_takes_the_tightest_window():
    r = random.Random(3)
    for _ in range(50):
        sizes = [r.randint(1, 40) for _ in range(r.randint(0, 60))]
        spots = P.best_fit_decreasing(sizes, 40)
        free = {}
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            seq, offset = spots[k]
            fits = [c for c in free.values() if c >= sizes[k]]
            if seq in free:
                assert free[seq] == min(fits)
            else:
                assert not fits
                free[seq] = 40
            assert offset == 40 - free[seq]
            free[seq] -= sizes[k]


def test_query(spark, sf_dir):
    r = P.op2_packing(spark, sf_dir).first()
    assert r.ids_crc32 >= 0
    assert zlib.crc32(b"") == 0
