"""What the training-data operators share: shared-folder tables, table reads and
views of Arrow string columns as byte buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import files

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    Read from ``spark.checkpoint.dir``. Where that is unset, a temporary folder is made and
    remembered on a single machine, as in tests; a cluster has to name one.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
        base = getattr(spark, "_millrace_dir", None) or tempfile.mkdtemp(prefix="millrace-")
        spark._millrace_dir = base
    return base.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that were running, not
    the whole plan above this point.
    """
    return _stored(df, name, compression)[0]


def _stored(df: DataFrame, name: str, compression: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables in the shared folder that are needed for a while only. Meanwhile Spark deletes the shuffle
    files of a query when it ends: what is read again is a table. Rows go to Python and come from files
    in batches of few bytes: workers and the JVM's buffers keep the size of the largest they had.
    ``settings`` hold meanwhile too."""

    SETTINGS = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": "2m",
        "spark.sql.parquet.columnarReaderBatchSize": "512",
    }

    def __init__(self, spark: SparkSession, settings: dict[str, str] | None = None):
        self.spark, self.paths = spark, []
        settings = {**self.SETTINGS, **(settings or {})}
        self.before = {k: spark.conf.get(k, None) for k in settings}
        for k, v in settings.items():
            spark.conf.set(k, v)

    def table(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        out, path = _stored(df, name, compression)
        self.paths.append(path)
        return out

    def clear(self) -> None:
        """Delete the tables. What was made from them has to be stored by now."""
        for path in self.paths:
            files.delete(self.spark, path)
        self.paths = []
        for k, v in self.before.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_digest(col: Column) -> Column:
    """First 128 bits of the SHA-256 of a text, as binary: the key of its content."""
    return F.unhex(F.substring(F.sha2(col.cast("binary"), 256), 1, 32))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that does not clash with the columns of ``df``."""
    have, name = {c.lower() for c in df.columns}, wanted
    while name.lower() in have:
        name = f"_{name}"
    return name


def hash_sample(df: DataFrame, key: str, rows: int, most: int) -> DataFrame:
    """At most ``most`` of the ``rows`` rows of ``df``, those of the smallest hashes of column ``key``.

    A row takes part by its hash before anything is ordered, so that what the tasks send on
    stays near ``most`` rows in all.
    """
    hashed = F.xxhash64(key)
    if rows > 4 * most:
        df = df.where(F.pmod(hashed, F.lit(1 << 30)) < int(2 * most / rows * (1 << 30)) + 1)
    return df.orderBy(F.pmod(hashed, F.lit(1 << 30)), hashed, key).limit(most)


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; null is empty.

    Text ``i`` is ``bytes[offsets[i]:offsets[i + 1]]``.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each (a longer row stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j
