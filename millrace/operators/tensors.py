"""Hidden states as packed binary chunks: a row holds some tokens of one sample, all layers of each.

Half-precision numbers take two bytes, single-precision ones four, little-endian, in the order
(token, layer, component). A sample's chunks lie side by side in files that are ranges of
samples; the manifest of their table is the directory, so a range of samples opens its files
only, and what needs no numbers (pointers, sizes) reads none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of numbers in a chunk; one token is never parted.
CHUNK_BYTES = 4 << 20
DTYPES = {"half": np.dtype("<f2"), "single": np.dtype("<f4")}
CHUNKS = "sample_idx long, first_token int, n_tokens int, layers int, width int, dtype string, data binary"
ROWS = "sample_idx long, token_idx int, layer int, vec array<float>"


def _stacked(vectors: pa.Array, tokens: np.ndarray, layers: np.ndarray) -> np.ndarray:
    """(token, layer, component) of one sample's consecutive rows; what is missing is zero."""
    sizes = np.asarray(vectors.value_lengths().fill_null(0))
    width = int(sizes.max(initial=0))
    places = tokens - tokens[0]
    out = np.zeros((int(places[-1]) + 1, int(layers.max()) + 1, width), np.float32)
    if (sizes != width).any():
        raise ValueError("vectors of a sample differ in length")
    if len(np.unique(places * out.shape[1] + layers)) != len(places):
        raise ValueError("a sample has two vectors for one token and layer")
    out[places, layers] = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), width)
    return out


def pack(states: DataFrame, dtype: str = "half", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks (``CHUNKS``) of states (sample_idx, token_idx, layer, vec), dealt by range and sorted.

    States without a token_idx are one token a sample. Numbers beyond half precision become
    infinite. A sample whose vectors differ in length, or that has two for a token and layer, is an error.
    """
    kind = DTYPES[dtype]
    rows = states if "token_idx" in states.columns else states.withColumn("token_idx", F.lit(0))
    own = rows.select(F.col("sample_idx").cast("long"), F.col("token_idx").cast("int"), F.col("layer").cast("int"), F.col("vec").cast("array<float>"))
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of one sample, without a gap
        size = 0

        def chunks() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            sample, tokens, layers = table.column(0)[0].as_py(), np.asarray(table.column(1)), np.asarray(table.column(2))
            cube = _stacked(table.column(3).combine_chunks(), tokens, layers)
            step = max(1, chunk_bytes // max(1, cube[0].size * kind.itemsize))
            with np.errstate(over="ignore"):
                out = [(sample, int(tokens[0]) + k, len(part), part.shape[1], part.shape[2], dtype, part.astype(kind).tobytes()) for k in range(0, len(cube), step) for part in (cube[k : k + step],)]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            samples, tokens = np.asarray(b.column(0)), np.asarray(b.column(1))
            starts = np.flatnonzero(np.r_[True, samples[1:] != samples[:-1]])
            for lo, hi in zip(starts, np.r_[starts[1:], b.num_rows], strict=True):
                part = b.slice(int(lo), int(hi - lo))
                first = int(tokens[lo])
                last = held and (held[-1].column(0)[0].as_py(), held[-1].column(1)[-1].as_py())
                full = size >= chunk_bytes and last and last[1] != first
                if held and (last[0] != samples[lo] or full):
                    yield from chunks()
                    held, size = [], 0
                held.append(part)
                size += part.nbytes
        if held:
            yield from chunks()

    dealt = own.repartitionByRange("sample_idx", "token_idx").sortWithinPartitions("sample_idx", "token_idx", "layer")
    return dealt.mapInArrow(run, CHUNKS)


def unpack(chunks: DataFrame) -> DataFrame:
    """States (``ROWS``) of chunks, a row a token and layer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sample, first, n, layers, width, dtype, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                flat = np.frombuffer(data, DTYPES[dtype]).astype(np.float32)
                rows = n * layers
                vec = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * width + 1, width) if width else np.zeros(rows + 1), pa.int32()), pa.array(flat))
                token, layer = np.divmod(np.arange(rows, dtype=np.int32), layers)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, sample)), pa.array((token + first).astype(np.int32)), pa.array(layer.astype(np.int32)), vec], names=["sample_idx", "token_idx", "layer", "vec"])

    return chunks.select(*(c.split()[0] for c in CHUNKS.split(", "))).mapInArrow(run, ROWS)


def cube(chunks: list) -> np.ndarray:
    """(token, layer, component) of one sample from its chunk rows."""
    parts = [np.frombuffer(c["data"], DTYPES[c["dtype"]]).reshape(c["n_tokens"], c["layers"], c["width"]) for c in sorted(chunks, key=lambda c: c["first_token"])]
    return np.concatenate(parts) if parts else np.zeros((0, 0, 0), np.float16)
