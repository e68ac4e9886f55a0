"""Gapless indexes and prefix sums without putting a whole table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def index_in_blocks(df: DataFrame, block: list[Column], within: list[Column], into: str, per: list[str] | None = None) -> DataFrame:
    """``df`` with a 0-based index in the order of ``block`` and then ``within``, starting anew for
    each value of the columns ``per``.

    Rows are numbered inside their block; the sizes of the blocks before, one row a block,
    are the only thing that is put in order as a whole.
    """
    per, names = per or [], [f"_b{i}" for i in range(len(block))]
    keyed = df.withColumns(dict(zip(names, block, strict=True)))
    key = [*per, *names]
    sizes = keyed.groupBy(*key).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*per).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*within)))
    return numbered.join(base, key).withColumn(into, (F.col("_base") + F.col("_r") - 1).cast("long")).select(*(c for c in df.columns if c != into), into)
