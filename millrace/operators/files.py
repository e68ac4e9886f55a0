"""Calls to the file system that Spark reads from; the one place that takes the session's JVM handles."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _open(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, folder: str, glob: str = "*") -> list[tuple[str, int]]:
    """(name, bytes) of what matches in a folder, by name; nothing where there is no folder."""
    _, p, fs = _open(spark, f"{folder.rstrip('/')}/{glob}")
    return sorted((f.getPath().getName(), f.getLen()) for f in fs.globStatus(p) or ())


def delete(spark: SparkSession, path: str) -> None:
    _, p, fs = _open(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    jvm, p, fs = _open(spark, path)
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    _, p, fs = _open(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def move_new(spark: SparkSession, staged: str, path: str) -> bool:
    """Give a whole file its name in one step; False where the name is taken."""
    jvm, p, fs = _open(spark, path)
    if fs.exists(p):
        return False
    return fs.rename(jvm.org.apache.hadoop.fs.Path(staged), p)
