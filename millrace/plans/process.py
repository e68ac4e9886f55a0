"""From samples and recorded generations to metadata, outputs and statistics, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.answers import add_labels
from millrace.functions.metrics import finish_reason, generation_metrics
from millrace.functions.prompts import render
from millrace.operators.store import keep_last
from millrace.schemas import GENERATIONS, SAMPLE_KEY

#: An inference hook: batches of (model, dataset, language, sample_id, prompt) to GENERATIONS rows.
InferenceHook = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def prompts(samples: DataFrame, models: DataFrame) -> DataFrame:
    """(model, …sample columns, prompt): every sample for every model. Models are a short list
    of configured names, so each sample row is copied once a model."""
    names = [r.model_name for r in models.select("model_name").toLocalIterator()]
    prompt = render(F.col("dataset"), F.col("question"), F.col("answer_type"), F.col("language"))
    return samples.withColumn("model", F.explode(F.array(*map(F.lit, names)))).withColumn("prompt", prompt)


def generate(prompted: DataFrame, hook: InferenceHook) -> DataFrame:
    """Generations by a hook that loads its model once a task."""
    return prompted.select("model", "dataset", "language", "sample_id", "prompt").mapInPandas(hook, GENERATIONS)


def isolated(one: Callable[[dict], dict]) -> InferenceHook:
    """A hook from a function of one row (a dict) to its generation (a dict of the GENERATIONS
    columns it knows): where it raises, the row gets an error and the others go on."""
    names = [f.split()[0] for f in GENERATIONS.split(", ")]

    def hook(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                key = {k: row[k] for k in SAMPLE_KEY}
                try:
                    out.append({**dict(one(row)), **key})
                except Exception as e:  # noqa: BLE001  one sample must not end the run
                    out.append({**key, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=names).astype(object).where(lambda d: d.notna(), None)

    return hook


def process(samples: DataFrame, generations: DataFrame, steps: DataFrame | None = None, seq: str = "seq") -> DataFrame:
    """The last generation of each sample, with its sample, prompt, answer, label, metrics and finish
    reason; a row with an error has nulls there. ``seq`` orders the generations of a sample;
    without such a column the later row is the last. ``steps``: (sample key, logits, token), one row
    per step.
    """
    key = ["dataset", "language", "sample_id"]
    ok = F.col("error").isNull()
    # Which generation is the last is settled before the join: after it, rows have no order.
    rows = add_labels(keep_last(None, generations, SAMPLE_KEY, seq).join(samples, key)).withColumns({
        "prompt": render(F.col("dataset"), F.col("question"), F.col("answer_type"), F.col("language")),
        "extracted_answer": F.when(ok, F.col("extracted_answer")),
        "correct": F.when(ok, F.col("correct")),
        "generated_length": F.when(ok, F.coalesce(F.size("generated_token_ids"), F.lit(0))),
        "finish_reason": F.when(ok, finish_reason(F.col("generated_token_ids"), F.col("terminators"), F.col("max_new_tokens"))),
    })
    if steps is None:
        return rows.withColumns({"max_probability": F.lit(0.0), "perplexity": F.lit(float("inf")), "entropy": F.lit(0.0)})
    out = rows.join(generation_metrics(steps, SAMPLE_KEY), SAMPLE_KEY, "left")
    return out.fillna({"max_probability": 0.0, "perplexity": float("inf"), "entropy": 0.0})


def require_states(generations: DataFrame, states: DataFrame, step_states: str = "step_states") -> DataFrame:
    """Generations of which those that have tokens but no states are errors."""
    there = states.where(F.size(step_states) > 0).select(*SAMPLE_KEY).distinct().withColumn("_there", F.lit(True))
    lacking = F.col("error").isNull() & (F.coalesce(F.size("generated_token_ids"), F.lit(0)) > 0) & F.col("_there").isNull()
    told = generations.join(there, SAMPLE_KEY, "left").withColumn("error", F.when(lacking, "hidden states are missing although there are tokens").otherwise(F.col("error")))
    return told.drop("_there")
