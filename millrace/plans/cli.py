"""Command line: process recorded generations of a run and report on it."""

from __future__ import annotations

import argparse
import json
from datetime import datetime
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import files
from millrace.operators.report import report, summary
from millrace.operators.states import state_tables
from millrace.operators.store import VersionedTable
from millrace.operators.upsert import OUTPUT_COLUMNS, StateStore, metadata_rows
from millrace.plans.process import process, require_states
from millrace.schemas import GENERATIONS, SAMPLE_KEY
from millrace.session import session
from millrace.sources.jsonl import load_samples
from millrace.sources.normalize import NORMALIZERS

# What a run covers by default.
MODELS = ["Llama-3-8B-Instruct", "Mistral-7B-Instruct-v0.2", "Qwen2-7B-Instruct"]
DATASETS = ["mmlu", "gsm8k", "mgsm", "math", "commonsenseqa", "hotpotqa", "theoremqa", "belebele"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace", description=__doc__)
    p.add_argument("--data-root", default="storage/datasets")
    p.add_argument("--model-root", default="storage/models", help="folder whose subfolders name models beside the default ones")
    p.add_argument("--generations", required=True, help="Parquet table of recorded generations")
    p.add_argument("--output-dir", default="storage/results")
    p.add_argument("--steps", help="Parquet table of recorded steps: sample key, step, logits, token")
    p.add_argument("--states", help="Parquet table of recorded hidden states: sample key, step_states, prompt_states")
    p.add_argument("--models", nargs="+", default=MODELS)
    p.add_argument("--datasets", nargs="+", default=DATASETS)
    p.add_argument("--max-samples", type=int)
    p.add_argument("--max-new-tokens", type=int, default=2048)
    p.add_argument("--language", default="en")
    for what in ("per-token", "mean", "prompt-last"):
        p.add_argument(f"--save-{what}", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--resume", action="store_true")
    p.add_argument("--run-id")
    return p


def run_name(models: list[str], datasets: list[str], now: datetime) -> str:
    return f"run_{now:%Y%m%d_%H%M%S}_m{len(models)}_d{len(datasets)}"


def check_names(named: list[str], known: list[str], what: str) -> None:
    if unknown := sorted(set(named) - set(known)):
        raise ValueError(f"unknown {what}: {', '.join(unknown)}; known: {', '.join(known)}")


#: Tables of a run by dataset: what is summed for the report, from each file's statistics.
RUN_TABLES = {
    "metadata": {"n_processed": "count(*)", "n_correct": "count_if(is_correct)"},
    "outputs": {},
    "errors": {"n_errors": "count(*)"},
}


def run_table(spark: SparkSession, out: str, name: str, dataset: str) -> VersionedTable:
    """A table of a run; a model's rows are files of their own."""
    return VersionedTable(spark, f"{out}/{name}/{dataset}", ["model", "sample_id"], ["model", "dataset"], RUN_TABLES[name])


def run_dataset(out: str, model: str, samples: DataFrame, generations: DataFrame, steps: DataFrame | None, states: DataFrame | None, save: list[str], resume: bool) -> None:
    """Process and store one model's samples of a dataset; with ``resume``, those from the first
    on that is not stored as valid."""
    store = StateStore(samples.sparkSession, f"{out}/states/{model}/{samples.first()['dataset']}") if not samples.isEmpty() else None
    if store is None:
        return
    todo = store.remaining(samples) if resume else samples
    wanted = states is not None and bool(save)
    rows = process(todo, require_states(generations, states) if wanted else generations, steps).persist()
    good, failed = rows.where("error IS NULL"), rows.where("error IS NOT NULL").select(*SAMPLE_KEY, "error")
    try:
        table = partial(run_table, store.spark, out, dataset=store.path.rsplit("/", 1)[1])
        table("metadata").upsert(metadata_rows(good), SAMPLE_KEY)
        table("outputs").upsert(good.select(*SAMPLE_KEY[:3], *OUTPUT_COLUMNS), SAMPLE_KEY)
        table("errors").remove(good.select(*SAMPLE_KEY))  # what succeeds now is no error any more
        table("errors").upsert(failed, SAMPLE_KEY)
        tables = {}
        if wanted:
            own = good.select(*SAMPLE_KEY, "sample_idx").join(states, SAMPLE_KEY)
            size = own.select(F.max(F.greatest(F.size(F.get("step_states", F.lit(0))), F.size("prompt_states"))), F.max(F.size(F.get(F.get("step_states", F.lit(0)), F.lit(0))))).first()
            made = state_tables(own, max(size[0] or 1, 1), max(size[1] or 1, 1))
            tables = {name: made[name] for name in save}
        store.save(rows.select("sample_idx", "sample_id", F.col("error").isNull().alias("valid"), "error"), **tables)
        if "token_states" in tables:
            store.finalize()
    finally:
        rows.unpersist()


def run_statistics(spark: SparkSession, out: str, datasets: list[str]) -> DataFrame | None:
    """(model, dataset, n_samples, n_processed, n_correct, n_errors, accuracy) of a run, from the
    manifests of its tables: no sample's row is read."""
    parts = []
    for d in datasets:
        done, errors = (run_table(spark, out, name, d).stats() for name in ("metadata", "errors"))
        parts += [done.withColumn("n_errors", F.lit(0).cast("long")), errors.select("model", "dataset", *(F.lit(0).cast("long").alias(c) for c in RUN_TABLES["metadata"]), "n_errors")]
    each = reduce(DataFrame.unionByName, parts)
    names = ["n_processed", "n_correct", "n_errors"]
    total = each.groupBy("model", "dataset").agg(*(F.sum(c).alias(c) for c in names))
    share = F.coalesce(F.try_divide(F.col("n_correct").cast("double"), F.col("n_processed").cast("double")), F.lit(0.0))
    return total.select("model", "dataset", (F.col("n_processed") + F.col("n_errors")).alias("n_samples"), *names, share.alias("accuracy"))


def main(argv: list[str] | None = None) -> dict:
    a = parser().parse_args(argv)
    spark = session()
    started = datetime.now()
    check_names(a.datasets, list(NORMALIZERS), "datasets")
    check_names(a.models, MODELS + [name for name, _ in files.listed(spark, a.model_root) if name not in MODELS], "models")
    resume = bool(a.resume and a.run_id)
    run_id = a.run_id if resume else run_name(a.models, a.datasets, started)
    out = f"{a.output_dir.rstrip('/')}/{run_id}"
    if resume and not files.exists(spark, out):
        raise ValueError(f"no run to resume at {out}")
    # A file's rows are in order, and files in the order of their names.
    recorded = spark.read.schema(GENERATIONS).parquet(a.generations).withColumn("seq", F.struct("_metadata.file_path", "_metadata.row_index"))
    wanted = recorded.where(F.col("language") == a.language)
    more = [spark.read.parquet(p) if p else None for p in (a.steps, a.states)]
    save = [name for flag, name in ((a.save_per_token, "token_states"), (a.save_mean, "mean_states"), (a.save_prompt_last, "prompt_last_states")) if flag]
    for dataset in a.datasets:
        samples = load_samples(spark, a.data_root, dataset, a.language, a.max_samples)
        for model in a.models:
            own = (F.col("dataset") == dataset) & (F.col("model") == model)
            run_dataset(out, model, samples, wanted.where(own), *(t if t is None else t.where(own & (F.col("language") == a.language)) for t in more), save, resume)
    result = report(run_statistics(spark, out, a.datasets), run_id, start_time=started.isoformat(), end_time=datetime.now().isoformat(), configuration=vars(a))
    text = json.dumps(result, indent=2, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/collection_results")
    print(text if a.verbose else summary(result))
    return result


if __name__ == "__main__":
    main()
