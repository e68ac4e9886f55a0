"""Embedding whitening on an exact scatter matrix: residue-number arithmetic.

Entries become integers, floor(1024 * c). For each of several primes a task takes its rows modulo
the prime and multiplies them with themselves in blocks. Primes are below 2^20 and blocks have
2^13 rows at most, so every sum in a product is an integer below 2^53 and the double-precision
product is exact. Spark adds the residues of all tasks for each prime and entry; Chinese
remaindering makes the exact integers of them. A column of ones goes along, so the sums and the
number of rows come out the same way. n * scatter - sums * sums is the centred scatter times n,
still exact; it is divided once, and a double-precision eigendecomposition follows.

How many primes there are follows from the number of rows and the largest entry. The driver sees
(d + 1)^2 integers a prime, whatever the number of rows. The offset of 100000 that the query's
contract adds to each entry changes neither a covariance nor a deviation, and stays out.

Defined results: vectors that are null, empty or hold a null or non-finite entry take no
part, nor do those whose length is not the most frequent one (the greater of equally
frequent ones); repeated vectors count each; directions without spread, that is eigenvalues below
1e4 * d double-precision units of the largest, are no components, so a table of one vector
gives no rows, nor does an empty one; null ids stay; entries beyond a long are taken as its limit;
a deviation beyond a long is null in the query and a decimal in the operator.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import materialize, table

SCALE = 1024
PRIME_BITS, BLOCK_ROWS = 20, 1 << 13
#: Bytes of rows that are multiplied at once.
BLOCK_BYTES = 1 << 24
MOST = 8


def primes_beyond(bound: int) -> list[int]:
    """The largest primes below 2^20 whose product exceeds ``bound``; two at least."""
    out, product, p = [], 1, (1 << PRIME_BITS) - 1
    while product <= bound or len(out) < 2:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out


def from_residues(residues: dict[int, np.ndarray]) -> np.ndarray:
    """The integers, as Python's, nearest to zero that have these residues (a prime's array each)."""
    product = int(np.prod(np.array(list(residues), object)))
    total = 0
    for p, r in residues.items():
        rest = product // p
        total = total + r.astype(object) * (rest * pow(rest, -1, p))
    total = total % product
    return np.where(total > product // 2, total - product, total)


def residue_products(rows: np.ndarray, primes: list[int]) -> dict[int, np.ndarray]:
    """For each prime the scatter matrix of the rows, with a column of ones, modulo the prime."""
    out = {}
    for p in primes:
        r = np.ones((len(rows), rows.shape[1] + 1))
        r[:, :-1] = rows % p
        out[p] = (r.T @ r).astype(np.int64) % p
    return out


def entries(vector: Column, scale: int = SCALE) -> Column:
    """A vector's entries as integers; null where it takes no part."""
    x = vector.cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when((F.size(x) > 0) & ~odd, F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))))


def usable(vectors: DataFrame, vector: str, scale: int = SCALE) -> tuple[DataFrame, int, int, int]:
    """Rows that take part, with their entries in ``_y``; their length, number and largest entry."""
    rows = vectors.withColumn("_y", entries(F.col(vector), scale)).where("_y IS NOT NULL")
    size = F.size("_y").alias("d")
    found = rows.groupBy(size).agg(F.count("*").alias("n"), F.max(F.array_max("_y")).alias("most"), F.min(F.array_min("_y")).alias("least")).orderBy(F.desc("n"), F.desc("d")).first()
    if found is None:
        return rows, 0, 0, 0
    return rows.where(F.size("_y") == found.d), found.d, found.n, max(abs(found.most), abs(found.least))


def blocks(batches: Iterator[pa.RecordBatch], column: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of bounded size with the entries of their rows."""
    step = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * d)))
    for b in batches:
        for k in range(0, b.num_rows, step):
            part = b.slice(k, step)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass
class Whitening:
    """What was fitted: ``components`` are columns, by falling eigenvalue; ``largest`` bounds the
    entries."""

    n: int
    largest: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def exact_scatter(rows: DataFrame, d: int, n: int, largest: int) -> np.ndarray:
    """Scatter matrix of ``_y`` and ones, as Python's integers."""
    primes = primes_beyond(2 * n * max(largest, 1) ** 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for _, y in blocks(batches, 0, d):
            for p, r in residue_products(y, primes).items():
                total[p] = (total[p] + r) % p if p in total else r
        for p, r in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, p)), pa.array(np.arange(d + 1)), pa.array(list(r), pa.list_(pa.int64()))], names=["prime", "i", "residues"])

    parts = rows.select("_y").mapInArrow(run, "prime long, i long, residues array<long>")
    each = parts.select("prime", "i", F.posexplode("residues").alias("j", "r")).where("j >= i")
    sums = each.groupBy("prime", "i", "j").agg(F.pmod(F.sum("r"), F.col("prime")).alias("r"))
    residues = {p: np.zeros((d + 1, d + 1), np.int64) for p in primes}
    got = sums.toPandas()
    for p, own in got.groupby("prime"):
        i, j = own["i"].to_numpy(np.int64), own["j"].to_numpy(np.int64)
        residues[int(p)][i, j] = residues[int(p)][j, i] = own["r"].to_numpy(np.int64)
    return from_residues(residues)


def fit(vectors: DataFrame, vector: str = "embedding", most: int = MOST, scale: int = SCALE) -> tuple[DataFrame, Whitening | None]:
    """The rows that take part and what whitens them; None where nothing has spread."""
    rows, d, n, largest = usable(vectors, vector, scale)
    if not n:
        return rows, None
    scatter = exact_scatter(rows, d, n, largest)
    sums = scatter[:-1, -1]
    centred = n * scatter[:-1, :-1] - np.outer(sums, sums)
    covariance = (centred / (n * n)).astype(float)
    values, components = np.linalg.eigh(covariance)
    values, components = values[::-1][:most], components[:, ::-1][:, :most]
    spread = values > values[0] * d * 1e4 * np.finfo(float).eps
    if not spread.any():
        return rows, None
    components = components[:, spread]
    # Either sign will do: the largest entry is positive.
    components = components * np.sign(components[np.abs(components).argmax(0), np.arange(components.shape[1])])
    return rows, Whitening(n, largest, [int(s) for s in sums], values[spread], components, float(np.trace(covariance)))


def project(rows: DataFrame, id_col: str, model: Whitening) -> DataFrame:
    """(id, deviation, whitened array) of rows with ``_y``; the deviation is exact."""
    d, n = len(model.sums), model.n
    kind = rows.schema[id_col].dataType.simpleString()
    spread = 2 * n * model.largest
    whole = spread < 1 << 62 and d * spread**2 < 1 << 63
    matrix = model.components / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.array(model.sums, np.int64 if whole else object)
        for b, y in blocks(batches, 1, d):
            off = n * (y if whole else y.astype(object)) - sums
            deviation = (off * off).sum(axis=1)
            shown = pa.array(deviation, pa.int64()) if whole else pa.array([str(x) for x in deviation])
            # One at a time: which rows are projected together must not change a bit of any.
            white = np.einsum("rd,dk->rk", (off / n).astype(float), matrix)
            yield pa.RecordBatch.from_arrays([b.column(0), shown, pa.array(list(white), pa.list_(pa.float64()))], names=["id", "deviation", "whitened"])

    out = rows.select(F.col(id_col).alias("id"), "_y").mapInArrow(run, f"id {kind}, deviation {'long' if whole else 'string'}, whitened array<double>")
    return out if whole else out.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))


def covariance_of(white: DataFrame, k: int) -> np.ndarray:
    """Covariance of the whitened vectors, centred before multiplying."""
    part = lambda i: F.get("whitened", F.lit(i))
    mean = white.agg(*(F.avg(part(i)).alias(f"m{i}") for i in range(k))).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = white.agg(*(F.avg((part(i) - mean[i]) * (part(j) - mean[j])).alias(f"c{i}_{j}") for i, j in pairs)).first()
    out = np.zeros((k, k))
    for (i, j), c in zip(pairs, found, strict=True):
        out[i, j] = out[j, i] = c
    return out


def whiten(vectors: DataFrame, vector: str = "embedding", id_col: str = "vec_id", most: int = MOST, scale: int = SCALE) -> tuple[DataFrame, Whitening | None, float | None]:
    """(id, deviation, whitened) of each row that takes part, what was fitted, and the largest
    absolute entry of the whitened vectors' covariance less the identity."""
    rows, model = fit(vectors, vector, most, scale)
    if model is None:
        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"id {kind}, deviation long, whitened array<double>"), None, None
    white = materialize(project(rows, id_col, model), "whitened")
    k = len(model.values)
    return white, model, float(np.abs(covariance_of(white, k) - np.eye(k)).max())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on each of up to eight components."""
    white, model, error = whiten(table(spark, sf_dir, "embeddings"))
    explained = F.get(F.array(*(F.lit(float(x)) for x in (model.explained if model else [0.0]))), F.col("at"))
    each = white.select("id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "value"))
    return each.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation",
        F.col("value").alias("whitened"), explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
