"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of ``KERNEL`` bytes run over the whole text; their
responses are max-pooled within overlapping chunks, and the chunks' maxima and means
are combined by one logistic unit. Training takes the whole texts of a bounded sample of
labelled rows: in the order of a hash of their ids, at most ``SAMPLE_ROWS`` rows, less
the longest of them where all take more than ``SAMPLE_BYTES`` bytes. Scoring takes every byte of every text
and nothing else of a row; a long text is scored in parts of whole chunks, whose maxima
and sums are put together.

Defined results: a null text is empty, and an empty text is scored like a text of
padding; without labelled rows every score is 0.5; of several labels of an id the least
counts; repeated rows are learned from and scored each, and get equal scores; a score of
exactly the threshold is accepted; a null id is never held out; an empty table gives no
rows; other columns are kept, whatever their names (a new column whose name is taken
gets underscores before it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import column_bytes, free_name, hash_sample, materialize, slices, table

#: Chunks of CHUNK bytes begin every HOP bytes; both are multiples of STRIDE.
CHUNK, HOP, KERNEL, STRIDE = 1024, 896, 8, 4
WIDTH, FILTERS = 6, 32
#: Labelled rows that are learned from, and bytes of their texts.
SAMPLE_ROWS, SAMPLE_BYTES = 5000, 16 << 20
#: Optimisation steps; few rows are gone over more often.
STEPS, BATCH, RATE, DECAY = 1000, 64, 4e-3, 1e-4
KEEP = 0.3
#: Bytes that are scored at once, and chunks that are learned from at once.
STEP, AT_ONCE = 1 << 18, 64
Model = dict[str, np.ndarray]


def fresh_model(seed: int = 7) -> Model:
    r = np.random.default_rng(seed)
    model = {
        "embed": r.normal(0, 0.5, (256, WIDTH)), "filter": r.normal(0, (2 / (KERNEL * WIDTH)) ** 0.5, (KERNEL * WIDTH, FILTERS)), "bias": np.zeros(FILTERS),
        "top": r.normal(0, 0.1, FILTERS), "mean": r.normal(0, 0.1, FILTERS), "base": np.zeros(1),
    }
    model["embed"][0] = 0
    return {k: v.astype(np.float32) for k, v in model.items()}


def _windows(model: Model, padded: np.ndarray) -> np.ndarray:
    """Embedded windows of KERNEL bytes, one every STRIDE bytes."""
    flat = np.ascontiguousarray(model["embed"][padded]).reshape(-1)
    n = (len(padded) - KERNEL) // STRIDE + 1
    step = flat.itemsize
    return np.lib.stride_tricks.as_strided(flat, (n, KERNEL * WIDTH), (STRIDE * WIDTH * step, step))


def _chunk_count(size: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-(size - (CHUNK - HOP)) // HOP))


def _pooled(model: Model, raw: np.ndarray, offsets: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Maxima of the filters over the first ``chunks`` chunks of each text of a buffer."""
    size = np.diff(offsets)
    # Every text gets room of its own, closed by padding that its last window needs.
    room = -(-np.maximum(size, 1) // STRIDE) * STRIDE + KERNEL
    at = np.concatenate([[0], np.cumsum(room)])
    padded = np.zeros(at[-1], np.uint8)
    padded[np.arange(len(raw)) + np.repeat(at[:-1] - offsets[:-1], size)] = raw
    h = np.maximum(_windows(model, padded) @ model["filter"] + model["bias"], 0)
    text = np.repeat(np.arange(len(size)), chunks)
    k = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = (at[text] + k * HOP) // STRIDE
    end = np.minimum(begin + CHUNK // STRIDE, (at[text] + np.maximum(size[text], 1) - 1) // STRIDE + 1)
    # Chunks overlap: reduceat over (begin, end) pairs, of which every other result counts.
    pairs = np.stack([begin, np.minimum(end, len(h) - 1)], 1).ravel()
    return np.maximum.reduceat(h, pairs, axis=0)[::2]


def score_texts(model: Model, raw: np.ndarray, offsets: np.ndarray, step: int = STEP) -> np.ndarray:
    """Probability of label 1 for each text of a buffer."""
    chunks = _chunk_count(np.diff(offsets))
    if len(chunks) == 1 and chunks[0] * HOP > 2 * step:
        each, most = max(1, step // HOP), int(chunks[0])
        top, total = np.zeros(FILTERS, np.float32), np.zeros(FILTERS)
        for k in range(0, most, each):
            # A part ends with the last window of its last chunk.
            part = raw[k * HOP : (k + each) * HOP + CHUNK - HOP + KERNEL]
            own = _pooled(model, part, np.array([0, len(part)]), np.array([min(each, most - k)]))
            top, total = np.maximum(top, own.max(axis=0)), total + own.sum(axis=0)
        top, mean = top[None], total[None] / most
    else:
        pooled, first = _pooled(model, raw, offsets, chunks), np.cumsum(chunks) - chunks
        top = np.maximum.reduceat(pooled, first, axis=0)
        mean = np.add.reduceat(pooled, first, axis=0) / chunks[:, None]
    z = top.astype(np.float64) @ model["top"] + mean.astype(np.float64) @ model["mean"] + float(model["base"][0])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[list[bytes]], labels: np.ndarray, seed: int = 7) -> Model:
    """Adam on the log loss. ``texts``: the chunks of each row (``chunks_of``)."""
    model, r = fresh_model(seed), np.random.default_rng(seed)
    x = np.zeros((sum(map(len, texts)), CHUNK), np.uint8)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    for i, c in enumerate(c for t in texts for c in t):
        x[i, : len(c)] = np.frombuffer(c, np.uint8)
    valid = np.array([max(1, -(-len(c) // STRIDE)) for t in texts for c in t])
    rows = np.split(np.arange(len(owner)), np.cumsum([len(t) for t in texts])[:-1])
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    model["base"][0] = np.log(share / (1 - share))
    m1, m2 = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    t = 0
    epochs = -(-STEPS // -(-len(texts) // BATCH))
    for epoch in range(epochs):
        order = r.permutation(len(texts))
        for b in range(0, len(order), BATCH):
            docs = order[b : b + BATCH]
            grads = _gradients(model, x, [rows[i] for i in docs], labels[docs], valid)
            t += 1
            rate = RATE * (1 - epoch / epochs) + 2e-4
            for k, g in grads.items():
                g = g + DECAY * model[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                model[k] -= (rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
            model["embed"][0] = 0
    return model


def _gradients(model: Model, x: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, valid: np.ndarray | None = None) -> Model:
    """Gradients of the mean log loss; ``valid``: windows of each chunk that begin in its text."""
    chunk = np.concatenate(rows)
    n = np.array([len(i) for i in rows])
    first = np.cumsum(n) - n
    own = x[chunk]
    arg, pooled = np.zeros((len(own), FILTERS), np.int64), np.zeros((len(own), FILTERS), model["filter"].dtype)
    per = (CHUNK - KERNEL) // STRIDE + 1
    for k in range(0, len(own), AT_ONCE):
        flat = model["embed"][own[k : k + AT_ONCE]]
        step = flat.strides
        windows = np.lib.stride_tricks.as_strided(flat, (len(flat), per, KERNEL * WIDTH), (step[0], STRIDE * step[1], step[2]))
        h = (windows.reshape(-1, KERNEL * WIDTH) @ model["filter"]).reshape(len(flat), per, FILTERS)
        if valid is not None:
            h[np.arange(per) >= valid[chunk[k : k + AT_ONCE], None]] = -np.inf
        arg[k : k + AT_ONCE] = a = h.argmax(axis=1)
        pooled[k : k + AT_ONCE] = np.take_along_axis(h, a[:, None], 1)[:, 0]
    pooled = np.maximum(pooled + model["bias"], 0)
    doc = np.repeat(np.arange(len(rows)), n)
    top = np.maximum.reduceat(pooled, first, axis=0)
    mean = np.add.reduceat(pooled, first, axis=0) / n[:, None]
    z = top @ model["top"] + mean @ model["mean"] + model["base"][0]
    dz = (1 / (1 + np.exp(-z)) - labels) / len(rows)
    is_top = pooled == top[doc]
    dp = (is_top * model["top"] + model["mean"] / n[doc, None]) * dz[doc, None] * (pooled > 0)
    # Only the window that gave a maximum gets a gradient.
    places = own[np.arange(len(own))[:, None, None], arg[:, :, None] * STRIDE + np.arange(KERNEL)]
    won = model["embed"][places].reshape(len(own), FILTERS, KERNEL * WIDTH)  # chunk, filter, window
    grads = {"filter": np.einsum("cf,cfw->wf", dp, won), "bias": dp.sum(0), "top": dz @ top, "mean": dz @ mean, "base": np.array([dz.sum()])}
    into = (dp[:, :, None] * model["filter"].T[None]).reshape(len(own), FILTERS, KERNEL, WIDTH)
    embed = np.zeros_like(model["embed"])
    np.add.at(embed, places.ravel(), into.reshape(-1, WIDTH))
    return grads | {"embed": embed}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def chunks_of(text: bytes) -> list[bytes]:
    """The chunks of a text as in scoring."""
    return [text[k * HOP : k * HOP + CHUNK] for k in range(int(_chunk_count(np.array(len(text)))))]


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> tuple[list[list[bytes]], np.ndarray]:
    """Chunks and labels of at most ``rows`` labelled rows that are not held out, by a hash of
    their ids; where their texts take more than ``size`` bytes, the longest are passed over."""
    own = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    own = own.groupBy(F.col(id_col).alias("_id")).agg(F.min(label).cast("double").alias("_label"))
    picked = materialize(hash_sample(own, "_id", own.count(), rows), "labelled")
    texts = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    order = F.struct(F.xxhash64("_id").alias("h"), F.col("_id").alias("i"), F.xxhash64("_text").alias("t"))
    joined = texts.join(F.broadcast(picked), F.col("_doc") == F.col("_id")).select(order.alias("_order"), "_label", F.octet_length("_text").alias("_n"), "_text")
    # Repeated ids may make more rows than were picked.
    first = joined.select("_order", "_label", "_n").orderBy("_order", "_label").limit(rows).collect()
    left, most = size, -1
    for n in sorted(r["_n"] for r in first):
        if n > left:
            break
        left, most = left - n, n
    got = joined.where(F.col("_n") <= most).orderBy("_order", "_label").limit(sum(r["_n"] <= most for r in first)).collect()
    return [chunks_of(r["_text"].encode()) for r in got], np.array([r["_label"] for r in got], np.float32)


def fit(docs: DataFrame, labels: DataFrame, **columns: str) -> Model | None:
    """A model, or None where there is nothing to learn from."""
    texts, y = training_rows(docs, labels, **columns)
    return train(texts, y) if len(texts) else None


def add_scores(docs: DataFrame, model: Model | None, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each row."""
    into = free_name(docs, into)
    if model is None:
        return docs.withColumn(into, F.lit(0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index(text))
            raw, offs = column_bytes(column if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(pa.string()))
            score = np.concatenate([score_texts(model, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in slices(offs, STEP)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, into])

    return docs.mapInArrow(run, docs.withColumn(into, F.lit(0.0)).schema)


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = KEEP) -> DataFrame:
    """The rows whose score reaches ``threshold``; columns as given."""
    score = free_name(docs, "_score")
    return add_scores(docs, fit(docs, labels, text=text), text, score).where(F.col(score) >= threshold).select(*docs.columns)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score and whether its label was kept from training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = add_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
