"""Sums and means of vectors by key, without a row per component.

Each task adds the vectors of a key up as they arrive, Arrow batch by Arrow batch, and sends
one row (keys, number, sum) on; these partial sums are dealt by key, sorted and added up
again, one after another. So what is shuffled is at most a vector per key and task, however
many vectors there are and however wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of sums that a task holds before it sends them on.
HELD = 32 << 20


def _matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) for each length of vector in a column; null vectors are left out, a null
    component is not a number."""
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    for width in np.unique(lengths[lengths >= 0]):
        at = np.flatnonzero(lengths == width)
        flat = vectors.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        yield at, flat.reshape(len(at), int(width))


def _added(codes: np.ndarray, counts: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, counts, sums) with the rows of equal codes added up, by ascending code."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[starts], np.add.reduceat(counts[order], starts), np.add.reduceat(matrix[order], starts, axis=0)


class _Sums:
    """Running sums by (key, width), in the order in which keys were first seen."""

    def __init__(self, names: list[str], types: list[pa.DataType]):
        self.names, self.types = names, types
        self.rows: dict[tuple, list] = {}
        self.held = 0

    def add(self, keys: list[pa.Array], counts: np.ndarray, vectors: pa.Array) -> None:
        frame = pd.DataFrame({i: k.to_pandas(integer_object_nulls=True) for i, k in enumerate(keys)})
        codes = frame.groupby(list(frame.columns), sort=False, dropna=False).ngroup().to_numpy()
        first = np.unique(codes, return_index=True)[1]
        named = list(zip(*(k.take(pa.array(first)).to_pylist() for k in keys), strict=True))
        for at, matrix in _matrices(vectors):
            width = matrix.shape[1]
            for code, n, total in zip(*_added(codes[at], counts[at], matrix), strict=True):
                own = self.rows.get((named[code], width))
                if own is None:
                    self.rows[named[code], width] = [n, total]
                    self.held += 8 * width + 200
                else:
                    own[0] += n
                    own[1] = own[1] + total

    def take(self, keep: tuple | None = None) -> pa.RecordBatch | None:
        """Everything that is held, or everything but the sums of one key."""
        out = [(key, n, total) for (key, _), (n, total) in self.rows.items() if keep is None or key != keep]
        self.rows = {k: v for k, v in self.rows.items() if keep is not None and k[0] == keep}
        self.held = sum(8 * width + 200 for _, width in self.rows)
        if not out:
            return None
        columns = [pa.array(c, t) for c, t in zip(zip(*(key for key, _, _ in out), strict=True), self.types, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n, _ in out], pa.int64()), pa.array([t for _, _, t in out], pa.list_(pa.float64()))], names=[*self.names, "n", "total"])


def _summed_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", n long, total array<double>"


def partial_sums(df: DataFrame, keys: list[str], vec: str = "vec", held: int = HELD) -> DataFrame:
    """(keys, n, total) of what each task holds: a row a key and task, or more where a task's sums
    take more than ``held`` bytes."""
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for b in batches:
            if not b.num_rows:
                continue
            sums = sums or _Sums(keys, [f.type for f in list(b.schema)[:k]])
            sums.add(b.columns[:k], np.ones(b.num_rows, np.int64), b.column(k))
            if sums.held > held:
                yield sums.take()
        if sums and (rest := sums.take()):
            yield rest

    return df.select(*keys, F.col(vec).cast("array<double>").alias("_vec")).mapInArrow(run, _summed_schema(df, keys))


def sum_vectors(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """(keys, n, total): number and sum of the vectors of each key, in double precision.

    A null vector does not count; a null component is not a number. Vectors of several lengths under
    one key have a row a length.
    """
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for b in batches:
            if not b.num_rows:
                continue
            sums = sums or _Sums(keys, [f.type for f in list(b.schema)[:k]])
            sums.add(b.columns[:k], np.asarray(b.column(k)), b.column(k + 1))
            # Rows come in the order of their keys: only the last key can go on.
            if done := sums.take(tuple(c[b.num_rows - 1].as_py() for c in b.columns[:k])):
                yield done
        if sums and (rest := sums.take()):
            yield rest

    return partial_sums(df, keys, vec).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _summed_schema(df, keys))


def mean_vectors(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """(keys, vec): the mean of the vectors of each key, in single precision."""
    mean = F.transform("total", lambda x: (x / F.col("n")).cast("float"))
    return sum_vectors(df, keys, vec).select(*keys, mean.alias(vec))
