"""Confidence metrics of a generation from its step logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import bound

#: Probabilities are kept from zero by this inside logarithms.
FLOOR = 1e-12


def step_metrics(logits: Column, token: Column) -> Column:
    """struct(top, bits, ln) of one step: the largest probability of its softmax, its entropy in
    bits, and ln of the chosen token's probability.

    In double precision, shifted by the maximum; one pass for the sum and one for the
    entropy. Probabilities are floored inside logarithms only; a token outside the
    vocabulary counts as the floor, no token gives a null.
    """

    def with_sum(b: Column) -> Column:
        z = F.aggregate(b["x"], F.lit(0.0), lambda acc, v: acc + F.exp(v - b["m"]))
        return F.struct(b["x"].alias("x"), b["m"].alias("m"), z.alias("z"))

    def measured(b: Column) -> Column:
        p = lambda v: F.exp(v - b["m"]) / b["z"]
        bits = -F.aggregate(b["x"], F.lit(0.0), lambda acc, v: acc + p(v) * F.log2(F.greatest(p(v), F.lit(FLOOR))))
        chosen = F.when((token >= 0) & (token < F.size(b["x"])), p(F.get(b["x"], token.cast("int"))))
        ln = F.when(token.isNotNull(), F.ln(F.greatest(F.coalesce(chosen, F.lit(0.0)), F.lit(FLOOR))))
        return F.struct((1 / b["z"]).alias("top"), bits.alias("bits"), ln.alias("ln"))

    x = logits.cast("array<double>")
    return bound(bound(F.struct(x.alias("x"), F.array_max(x).alias("m")), with_sum), measured)


def generation_metrics(steps: DataFrame, keys: list[str], logits: str = "logits", token: str = "token") -> DataFrame:
    """(keys, max_probability, perplexity, entropy) from one row per step: its logits and the
    token chosen there (null: no token). Steps without a token count for the first and
    the last only; without any token the perplexity is infinite.

    Each step is reduced to three numbers before the aggregation, so vocabularies are
    never shuffled.
    """
    each = steps.select(*keys, step_metrics(F.col(logits), F.col(token)).alias("s"))
    each = each.select(*keys, F.col("s.top").alias("top"), F.col("s.bits").alias("bits"), F.col("s.ln").alias("ln"))
    return each.groupBy(*keys).agg(
        F.avg("top").alias("max_probability"),
        F.coalesce(F.exp(-F.avg("ln")), F.lit(float("inf"))).alias("perplexity"),
        F.avg("bits").alias("entropy"),
    )


def with_defaults(metrics: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each sample; one without steps gets (0, infinity, 0)."""
    out = samples.select(*keys).join(metrics, keys, "left")
    return out.fillna({"max_probability": 0.0, "perplexity": float("inf"), "entropy": 0.0})


def finish_reason(tokens: Column, terminators: Column, most: Column) -> Column:
    """empty, eos, length or other; a final terminator wins over the length."""
    n = F.coalesce(F.size(tokens), F.lit(0))
    return F.when(n <= 0, "empty").when(F.array_contains(terminators, F.element_at(tokens, -1)), "eos").when(n >= most, "length").otherwise("other")


def terminator_set(eos: Column, *known: Column) -> Column:
    """The end token and the known special ones, each once, in order; nulls are unknown."""
    return F.array_distinct(F.array_compact(F.array(eos, *known)))


def split_sequence(sequence: Column, input_length: Column) -> Column:
    """struct(generated_length, generated_tokens) of a full sequence."""
    n = F.size(sequence) - input_length
    return F.struct(n.alias("generated_length"), F.slice(sequence, input_length + 1, F.greatest(n, F.lit(0))).alias("generated_tokens"))


def chat_text(messages: DataFrame, keys: list[str], order: str = "turn", content: str = "text") -> DataFrame:
    """(keys, prompt): the contents of a conversation joined by blanks, in order. A conversation
    is one prompt, so its turns have to meet in one row."""
    turns = F.array_sort(F.collect_list(F.struct(order, content)))
    return messages.groupBy(*keys).agg(F.array_join(F.transform(turns, lambda t: t[content]), " ").alias("prompt"))
