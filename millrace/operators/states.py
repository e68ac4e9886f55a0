"""Hidden states as long tables: one vector per (sample, token, layer)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import half_round
from millrace.operators.vectors import mean_vectors


def zeros(layers: Column | int, width: Column | int) -> Column:
    """A (layers, width) array of zeros."""
    row = F.array_repeat(F.lit(0.0).cast("float"), width)
    return F.array_repeat(row, layers)


def last_position(positions: Column) -> Column:
    """The vector of the last position; a bare vector is itself the only one."""
    return F.try_element_at(positions, F.lit(-1))


def token_states(steps: DataFrame, key: str = "sample_idx", states: str = "step_states") -> DataFrame:
    """(key, token_idx, layer, vec) from one row per sample holding (step, layer) vectors; vectors
    are rounded to half precision. A sample without steps has no rows."""
    by_step = steps.select(key, F.posexplode(states).alias("token_idx", "layers"))
    by_layer = by_step.select(key, "token_idx", F.posexplode("layers").alias("layer", "vec"))
    return by_layer.withColumn("vec", half_round(F.col("vec").cast("array<float>")))


def mean_states(tokens: DataFrame, key: str = "sample_idx") -> DataFrame:
    """(key, layer, vec): mean over a sample's tokens, component by component.

    Tasks add vectors up before anything is shuffled, so that is a vector per sample, layer
    and task, whatever the number of tokens; there is never a row per component.
    """
    return mean_vectors(tokens, [key, "layer"])


def pad_layers(states: DataFrame, samples: DataFrame, layers: int, width: int, key: str = "sample_idx", cut: bool = True) -> DataFrame:
    """Exactly ``layers`` rows per sample: missing ones are zeros; with ``cut``, others go."""
    frame = samples.select(key, F.explode(F.sequence(F.lit(0), F.lit(layers - 1))).alias("layer"))
    own = states.where(F.col("layer") < layers) if cut else states
    filled = frame.join(own, [key, "layer"], "left" if cut else "full")
    return filled.withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0).cast("float"), width)))


def prompt_last_states(prompts: DataFrame, layers: int, width: int, key: str = "sample_idx", states: str = "prompt_states") -> DataFrame:
    """(key, layer, vec): the last prompt position of each layer, padded and cut to ``layers``."""
    own = prompts.select(key, F.posexplode(states).alias("layer", "positions")).select(key, "layer", last_position(F.col("positions")).alias("vec"))
    return pad_layers(own, prompts, layers, width, key)


def state_tables(records: DataFrame, layers: int, width: int, key: str = "sample_idx", steps: str = "step_states", prompt: str = "prompt_states") -> dict[str, DataFrame]:
    """The three tables of a run's hidden states, by name, from one row a sample that holds the
    (step, layer) vectors of its generation and the (layer, position) vectors of its prompt.

    A sample without steps has no token states and zeros as its means; one without prompt
    states has zeros there.
    """
    tokens = token_states(records, key, steps)
    return {
        "token_states": tokens,
        "mean_states": pad_layers(mean_states(tokens, key), records, layers, width, key),
        "prompt_last_states": prompt_last_states(records, layers, width, key, prompt),
    }


def layer_probe(states: DataFrame, models: DataFrame) -> DataFrame:
    """(model_name, n_layers): layers seen in a model's states, else its configured number + 1."""
    seen = states.groupBy("model_name").agg((F.max("layer") + 1).alias("seen"))
    return models.join(seen, "model_name", "left").select("model_name", F.coalesce("seen", F.coalesce("n_layers", F.lit(0)) + 1).cast("int").alias("n_layers"))


def model_metadata(configs: DataFrame) -> DataFrame:
    """Models from their configurations, whose names for a thing differ."""

    def any_of(*names: str) -> Column:
        there = [F.col(n) for n in names if n in configs.columns]
        return F.coalesce(*there, F.lit(0)).cast("int") if there else F.lit(0)

    return configs.select(
        "model_name",
        any_of("num_hidden_layers", "n_layer", "n_layers").alias("n_layers"),
        any_of("hidden_size", "n_embd", "d_model").alias("hidden_dim"),
        any_of("vocab_size").alias("vocab_size"),
        (F.coalesce("model_type", F.lit("unknown")) if "model_type" in configs.columns else F.lit("unknown")).alias("model_type"),
    )
