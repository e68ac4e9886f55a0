"""Incremental form of the upsert: a file stream whose batches are merged into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.upsert import upsert


def upsert_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str] | None = None, seq: str = "seq") -> StreamingQuery:
    """Merge all files of ``source`` that are new since the last call; what was merged is
    remembered in ``checkpoint``, and merging a batch again changes nothing."""

    def merge(batch: DataFrame, _epoch: int) -> None:
        upsert(batch, target, keys, seq)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
