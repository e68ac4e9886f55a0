"""Packing token sequences: best-fit decreasing.

Documents are tokenized, closed with an end id and cut: overlong ones first into full
windows, so that one tail shorter than a window is left. Tails, longest first, each go
to the tightest open window that holds them; a segment tree over the remaining
capacities finds it. Each task packs the tails of its own rows in blocks of bounded
size, so there is no shuffle and no gathering; a block leaves a few windows part-filled
at most.

Defined results: a null text is empty, and an empty text is the end id alone; repeated
rows are packed each; an empty table gives no pieces; other columns are left alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import table

WINDOW = 1024
#: Bytes of tails that are packed together.
BLOCK_BYTES = 32 << 20
# Fixed value: where byte-level tokenizers cut a text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts go through the first library, whose cutting has no limit on blanks.
LONG = 1 << 20
PIECES = "id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Open windows by remaining capacity. A segment tree over the capacities counts them;
    descending it finds the smallest capacity that is large enough."""

    def __init__(self, window: int):
        self.window = window
        self.leaves = 1 << (window + 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, n: int) -> None:
        i = self.leaves + capacity
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """Smallest capacity of an open window that is at least ``need``."""
        i = self.leaves + need
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.leaves

    def put(self, capacity: int, name: int) -> None:
        if capacity:
            self.at[capacity].append(name)
            self._add(capacity, 1)

    def take(self, capacity: int) -> int:
        self._add(capacity, -1)
        return self.at[capacity].pop()


def best_fit_decreasing(sizes: list[int], window: int) -> list[tuple[int, int]]:
    """(sequence, offset) for each size; sequences are numbered from 0."""
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    tree, used = OpenWindows(window), 0
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        capacity = tree.tightest(sizes[k])
        if capacity is None:
            name, capacity, used = used, window, used + 1
        else:
            name = tree.take(capacity)
        out[k] = (name, window - capacity)
        tree.put(capacity - sizes[k], name)
    return out


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks of the tokens of a tokenizer file, if it is a plain byte-level BPE whose merges come
    in the order of their ids; else None."""
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    # Bytes that print stand for themselves in the file, the others for characters from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    added = {t["content"] for t in spec["added_tokens"]}
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    whole = len(merged) + 256 == len(vocab) and merged == sorted(merged) and len(set(merged)) == len(merged)
    return {bytes(byte[c] for c in t): i for t, i in vocab.items()} if whole else None


class Encoder:
    """Ids of texts from a tokenizer file.

    A plain byte-level BPE is run by a second library from the same file: its ids are the
    same (the tests compare them on every code point) and take a quarter of the time. Texts
    that spell an added token, and other tokenizers, go through the first.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        ranks = byte_ranks(spec)
        self.fast = tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = []
        for t in texts:
            if self.fast is None or len(t) > LONG or any(a in t for a in self.added):
                ids = self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids
            else:
                ids = self.fast.encode_ordinary(t)
            out.append(np.array(ids, "<u4").tobytes())
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """Pieces of the packed documents: id, start (its document's ids before it), length,
    ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset in the sequence.

    A sequence_id holds the task's number and a running number there.
    """
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer_path), TaskContext.get().partitionId() << 40
        used, tails, held = 0, [], 0

        def record(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names[1:], columns[1:], strict=True))], names=names)

        def place() -> list[tuple]:
            nonlocal used
            spots = best_fit_decreasing([n for _, _, n, _, _ in tails], window)
            rows = [(i, s, n, ids, total, task + used + seq, off) for (i, s, n, ids, total), (seq, off) in zip(tails, spots, strict=True)]
            used += 1 + max((seq for seq, _ in spots), default=-1)
            return rows

        kind = None
        for b in batches:
            kind = b.column(0).type
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                rows = []
                for i, ids in zip(part.column(0).to_pylist(), enc.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    total = len(ids) // 4
                    full = total // window
                    for w in range(full):
                        rows.append((i, w * window, window, ids[4 * w * window : 4 * (w + 1) * window], total, task + used, 0))
                        used += 1
                    if total % window:
                        tails.append((i, full * window, total % window, ids[4 * full * window :], total))
                        held += 4 * (total % window)
                if rows:
                    yield record(rows, kind)
                if held > BLOCK_BYTES:
                    yield record(place(), kind)
                    tails, held = [], 0
        if tails:
            yield record(place(), kind)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text).cast("string")).mapInArrow(run, PIECES.format(kind=kind))


def byte_bpe_path() -> str:
    """The vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with a checksum of its ids."""
    out = pack(table(spark, sf_dir, "documents"), byte_bpe_path())
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
