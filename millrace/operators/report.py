"""Statistics of runs."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.store import VersionedTable


def accuracy(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_samples, n_processed, n_correct, n_errors, accuracy); rows hold processed, error
    and correct as booleans. Accuracy is correct over processed, 0 where none is."""
    done, right = F.count_if("processed"), F.count_if(F.col("processed") & F.col("correct"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_samples"), done.alias("n_processed"), right.alias("n_correct"), F.count_if("error").alias("n_errors"),
        F.coalesce(F.try_divide(right.cast("double"), done.cast("double")), F.lit(0.0)).alias("accuracy"),
    )


def total_accuracy(stats: DataFrame) -> DataFrame:
    """One row over all models and datasets: correct over samples, null without samples."""
    return stats.agg(F.sum("n_samples").alias("n_samples"), F.sum("n_correct").alias("n_correct"), F.try_divide(F.sum("n_correct").cast("double"), F.sum("n_samples").cast("double")).alias("accuracy"))


def running_accuracy(rows: DataFrame, keys: list[str], order: str = "sample_idx", block: int = 65536) -> DataFrame:
    """Per processed row the percentage correct up to it.

    A prefix sum in two levels: within blocks of ``block`` positions, each a window of its
    own, plus the sums of the blocks before; only these meet in one task a group.
    """
    columns, right = rows.columns, F.coalesce(F.col("correct").cast("long"), F.lit(0))
    own = rows.withColumns({"_b": F.floor(F.col(order) / block), "_c": right, "_k": F.when(F.col("correct").isNotNull(), 1).otherwise(0)})
    by = [*keys, "_b"]
    sums = own.groupBy(*by).agg(F.sum("_c").alias("_sc"), F.sum("_k").alias("_sk"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*(F.col(k).alias(f"_at{i}") for i, k in enumerate(by)), *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(s) for s in ("_sc", "_sk")))
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Null keys are a group, and null positions a block of their own before the others.
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_at{i}")) for i, k in enumerate(by)))
    inner = own.withColumns({"_c": F.sum("_c").over(upto), "_k": F.sum("_k").over(upto)}).join(base, same)
    share = F.try_divide((F.col("_sc") + F.col("_c")).cast("double"), (F.col("_sk") + F.col("_k")).cast("double"))
    return inner.select(*columns, (share * 100).alias("running_accuracy"))


#: What a table has to keep for ``stored_running_accuracy``.
RUNNING = {"n_right": "count_if(correct)", "n_told": "count(correct)"}


def stored_running_accuracy(table: VersionedTable) -> DataFrame:
    """``running_accuracy`` of a versioned table that keeps ``RUNNING`` for its groups and is ordered by
    them and then by position: what comes before a file is known from the manifest."""
    keys, order = table.groups, table.order[len(table.groups) :]
    base = table.stats_before().withColumnsRenamed({k: f"_at{i}" for i, k in enumerate(["_name", *keys])})
    own = table.read_with_files()
    columns = [c for c in own.columns if c != "_name"]
    upto = Window.partitionBy("_name", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = own.withColumns({"_c": F.sum(F.coalesce(F.col("correct").cast("long"), F.lit(0))).over(upto), "_k": F.count("correct").over(upto)})
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_at{i}")) for i, k in enumerate(["_name", *keys])))
    # A row a file and group: no more than the manifest holds.
    found = counted.join(F.broadcast(base), same)
    share = F.try_divide((F.col("n_right") + F.col("_c")).cast("double"), (F.col("n_told") + F.col("_k")).cast("double"))
    return found.select(*columns, (share * 100).alias("running_accuracy"))


def line_counts(lines: DataFrame, file: str = "file_name") -> DataFrame:
    """(file, n): lines of each file, and of all with a null name."""
    return lines.rollup(file).agg(F.count("*").alias("n"))


def summary(result: dict) -> str:
    """A report as lines for a console: a table of models and datasets, then the total."""
    lines = [f"run {result['run_id']}", f"{'model':<28} {'dataset':<16} {'samples':>8} {'done':>8} {'right':>8} {'errors':>7} {'accuracy':>9}"]
    samples = right = 0
    for model, own in sorted(result["models"].items()):
        for dataset, s in sorted(own["datasets"].items()):
            lines.append(f"{model:<28} {dataset:<16} {s['n_samples']:>8} {s['n_processed']:>8} {s['n_correct']:>8} {s['n_errors']:>7} {s['accuracy']:>9.2%}")
            samples, right = samples + s["n_samples"], right + s["n_correct"]
    return "\n".join([*lines, f"total {right} of {samples}" + (f" ({right / samples:.2%})" if samples else "")])


def report(stats: DataFrame, run_id: str, **more: object) -> dict:
    """The nested report of a run; ``stats`` has a row per model and dataset."""
    models: dict[str, dict] = {}
    for r in stats.toLocalIterator():
        models.setdefault(r["model"], {"datasets": {}})["datasets"][r["dataset"]] = {k: r[k] for k in ("n_samples", "n_processed", "n_correct", "n_errors", "accuracy")}
    return {"run_id": run_id, **more, "models": models}
