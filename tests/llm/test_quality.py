import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import quality as Q


def slow_score(model, raw):
    """One text, chunk by chunk and position by position."""
    size = max(1, len(raw))
    padded = np.zeros(-(-size // Q.STRIDE) * Q.STRIDE + Q.KERNEL, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    h = {p: np.maximum(model["embed"][padded[p : p + Q.KERNEL]].reshape(-1) @ model["filter"] + model["bias"], 0) for p in range(0, size, Q.STRIDE)}
    chunks, k = [], 0
    while True:
        chunks.append(np.max([h[p] for p in h if k <= p < k + Q.CHUNK], axis=0))
        if k + Q.CHUNK >= size:
            break
        k += Q.HOP
    z = np.max(chunks, 0) @ model["top"] + np.mean(chunks, 0) @ model["mean"] + model["base"][0]
    return 1 / (1 + np.exp(-z))


def test_scores_cover_the_whole_text():
    r = random.Random(1)
    model = Q.fresh_model(3)
    texts = [bytes(r.randrange(1, 256) for _ in range(n)) for n in (0, 1, 7, 8, 9, 130, 1023, 1024, 1025, 1100, 1153, 5000)]
    offsets = np.cumsum([0, *map(len, texts)])
    got = Q.score_texts(model, np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert np.allclose(got, [slow_score(model, t) for t in texts], atol=1e-5)
    # A long text is scored in parts.
    for n in (5000, 896 * 4, 896 * 4 + 128, 896 * 4 + 129, 896 * 4 + 135, 896 * 6 + 1):
        own = np.frombuffer(bytes(r.randrange(1, 256) for _ in range(n)), np.uint8)
        parts = Q.score_texts(model, own, np.array([0, n]), step=896)
        assert np.allclose(parts, slow_score(model, own.tobytes()), atol=1e-5)


def test_gradients_match_differences():
    r = np.random.default_rng(2)
    model = {k: v.astype(np.float64) for k, v in Q.fresh_model(4).items()}
    x = r.integers(0, 256, (3, Q.CHUNK)).astype(np.uint8)
    rows, y = [np.array([0, 1]), np.array([2])], np.array([1.0, 0.0])

    def loss(m):
        out = 0
        for i, t in zip(rows, y, strict=True):
            pooled = np.array([np.maximum(Q._windows(m, c) @ m["filter"] + m["bias"], 0).max(0) for c in x[i]])
            z = pooled.max(0) @ m["top"] + pooled.mean(0) @ m["mean"] + m["base"][0]
            out -= (t * z - np.log1p(np.exp(z))) / len(y)
        return out

    grads = Q._gradients(model, x, rows, y)
    for name, at in (("filter", (5, 3)), ("bias", (3,)), ("top", (2,)), ("mean", (1,)), ("base", (0,)), ("embed", (int(x[0, 100]), 2))):
        moved = []
        for d in (1e-6, -1e-6):
            m = {k: v.copy() for k, v in model.items()}
            m[name][at] += d
            moved.append(loss(m))
        assert abs((moved[0] - moved[1]) / 2e-6 - grads[name][at]) < 1e-5


def test_learns_and_filters(spark, docs, clash):
    r = random.Random(3)
    words = ["the", "of", "river", "stone", "green"]
    rows = [(i, " ".join(r.choice(words) + ("%%%" if i % 4 == 0 else "") for _ in range(60))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    odd = [(None, None), (1000, ""), (1001, None), (7, rows[7][1])]
    table = clash(docs(*rows, *odd))
    scored = Q.add_scores(table, Q.fit(table, labels))
    assert scored.columns == [*table.columns, "__score"]
    got = [(x.doc_id, x["__score"]) for x in scored.collect()]
    assert len(got) == 404
    assert all(0 <= s <= 1 for _, s in got)
    held = [(i, s) for i, s in got if i is not None and i < 400 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= Q.KEEP) == (i % 4 != 0) for i, s in held]) > 0.95
    kept = Q.keep_good(table, labels)
    assert kept.columns == table.columns
    assert 250 < kept.count() < 330


def test_training_takes_whole_texts(spark, docs):
    long = "".join(chr(33 + i % 90) for i in range(4000))
    table = docs((1, long), (2, "short"), (3, None), (3, "twin"), (4, "x" * 100))
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4)], "doc_id long, quality int")
    texts = lambda **k: sorted(t[0] + b"".join(c[Q.CHUNK - Q.HOP :] for c in t[1:]) for t in Q.training_rows(table, labels, **k)[0])
    kept = [i for i in (1, 2, 3, 4) if zlib.crc32(str(i).encode()) % 5]
    want = sorted(t.encode() for i, t in [(1, long), (2, "short"), (3, ""), (3, "twin"), (4, "x" * 100)] if i in kept)
    assert texts() == want
    assert texts(size=200) == [t for t in want if len(t) < 200]
    assert len(texts(rows=1)) == 1


def test_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    table = docs((1, "a"), (2, None))
    assert [r.score for r in Q.add_scores(table, Q.fit(table, none)).collect()] == [0.5, 0.5]
    assert Q.keep_good(table, none).count() == 2
    assert Q.add_scores(table.limit(0), Q.fresh_model()).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = Q.op5_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9
    assert F is not None
