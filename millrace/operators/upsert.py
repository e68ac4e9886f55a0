"""Keep-last upserts and the tables of a run."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import tensors
from millrace.operators.store import VersionedTable, keep_last
from millrace.schemas import SAMPLE_KEY

__all__ = ["OUTPUT_COLUMNS", "StateStore", "csr_pointers", "keep_last", "metadata_rows", "output_rows", "remaining", "resume_index", "stored", "upsert"]

OUTPUT_COLUMNS = ["sample_id", "prompt", "generated_text", "extracted_answer", "max_probability", "perplexity", "entropy"]


def upsert(new: DataFrame, path: str, keys: list[str] | None = None, seq: str = "seq", order: list[str] | None = None, **how: object) -> None:
    """Merge a batch into the table at ``path``, whose files are ranges of ``order`` (sample_id);
    an empty batch changes nothing. ``how``: what ``VersionedTable`` takes besides."""
    VersionedTable(new.sparkSession, path, order or ["sample_id"], **how).upsert(new, keys or SAMPLE_KEY, seq)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """What upserts have made of the table at ``path``; None before the first."""
    return VersionedTable(spark, path, ["sample_id"]).read()


def _with_order(processed: DataFrame) -> list[str]:
    """The column that orders rows of one key, where there is one."""
    return ["seq"] if "seq" in processed.columns else []


def metadata_rows(processed: DataFrame) -> DataFrame:
    """The 13 columns kept of each processed sample, and what orders rows of one sample."""
    return processed.select(
        "sample_id", "dataset", "language", "model", "question", "answer_gt", "answer_type", F.col("correct").alias("is_correct"),
        F.col("generated_length").alias("answer_token_count"), "finish_reason", "generated_length", "prompt_length", "extracted_answer", *_with_order(processed),
    )


def output_rows(processed: DataFrame) -> DataFrame:
    """The 7 columns of texts and metrics of each processed sample, and what orders rows of one."""
    return processed.select(*OUTPUT_COLUMNS, *_with_order(processed))


class StateStore:
    """Hidden states and sample status of a run: packed chunks in versioned tables.

    Every write is an attempt with a number of its own. A sample's status is written after
    its states, so a status says that those of its attempt are whole; of several attempts
    the last counts, and states of others are passed over. Ragged tables need no empty
    slices: a sample without tokens has no rows, and pointers are derived (``finalize``).
    """

    #: How each table's numbers are kept.
    TABLES = {"token_states": "half", "mean_states": "single", "prompt_last_states": "single"}
    STATUS = "sample_idx long, sample_id long, valid boolean, error string, attempt long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.path}/{name}", ["sample_idx"])

    def _rows(self, name: str, schema: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
        found = self.table(name).read(lo, hi)
        return self.spark.createDataFrame([], schema) if found is None else found

    def status(self, lo: int | None = None, hi: int | None = None) -> DataFrame:
        """The last status of each sample."""
        rows = self._rows("sample_status", self.STATUS, lo, hi)
        last = F.max_by(F.struct(*rows.columns), "attempt").alias("_row")
        return rows.groupBy("sample_idx").agg(last).select("_row.*")

    def chunks(self, name: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
        """The chunks of the last attempt of each valid sample, of samples from ``lo`` to ``hi``."""
        return self._counting(name, lo, hi).drop("attempt")

    def _counting(self, name: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
        done = self.status(lo, hi).where("valid").select("sample_idx", "attempt")
        return self._rows(name, f"{tensors.CHUNKS}, attempt long", lo, hi).join(done, ["sample_idx", "attempt"], "left_semi")

    def states(self, name: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
        """The states of the last attempt of each valid sample, a row a vector."""
        rows = tensors.unpack(self.chunks(name, lo, hi))
        return rows if name == "token_states" else rows.drop("token_idx")

    def sample(self, name: str, sample_idx: int) -> np.ndarray:
        """One sample's states as an array (token, layer, component)."""
        return tensors.cube(self.chunks(name, sample_idx, sample_idx).collect())

    def remaining(self, samples: DataFrame) -> DataFrame:
        """Samples (by sample_idx) from the first one on that is not valid."""
        known = samples.select("sample_idx").join(self.status(), "sample_idx", "left")
        return remaining(samples, known)

    def pointers(self) -> DataFrame | None:
        """What ``finalize`` wrote last."""
        return self.table("pointers").read()

    def finalize(self) -> DataFrame:
        """(sample_idx, ptr) over the token states, from the chunks' sizes, written beside them."""
        counts = self.chunks("token_states").groupBy("sample_idx").agg(F.sum("n_tokens").alias("n"))
        ptr = csr_pointers(self.status(), counts)
        self.table("pointers").overwrite(ptr.repartitionByRange("sample_idx").sortWithinPartitions("sample_idx"))
        return self.pointers()

    def compact(self) -> None:
        """Leave out what no longer counts: chunks of earlier attempts and of samples that are not valid,
        and all but the last status of each sample. Files are then ranges that do not overlap."""
        for name in self.TABLES:
            if self.table(name).version() >= 0:
                self._rewritten(name, self._counting(name), ["sample_idx", "first_token"])
        if self.table("sample_status").version() >= 0:
            self._rewritten("sample_status", self.status(), ["sample_idx"])

    def _rewritten(self, name: str, rows: DataFrame, by: list[str]) -> None:
        self.table(name).overwrite(rows.repartitionByRange(*by).sortWithinPartitions(*by))

    def save(self, status: DataFrame, **states: DataFrame) -> None:
        """Append states and then the status (sample_idx, sample_id, valid, and an error where it
        failed) of the samples of one attempt."""
        if unknown := set(states) - set(self.TABLES):
            raise ValueError(str(sorted(unknown)))
        last = self._rows("sample_status", self.STATUS).agg(F.max("attempt")).first()[0]
        attempt = F.lit(0 if last is None else last + 1).cast("long")
        for name, df in states.items():
            self.table(name).append(tensors.pack(df, self.TABLES[name]).withColumn("attempt", attempt))
        error = F.col("error") if "error" in status.columns else F.lit(None).cast("string")
        rows = status.select(F.col("sample_idx").cast("long"), F.col("sample_id").cast("long"), "valid", error.alias("error"), attempt.alias("attempt"))
        self.table("sample_status").append(rows.repartitionByRange("sample_idx").sortWithinPartitions("sample_idx"))


def csr_pointers(status: DataFrame, counts: DataFrame, idx: str = "sample_idx", block: int = 65536) -> DataFrame:
    """(idx, ptr) for each sample and one past the last: tokens of all samples before it.

    A prefix sum in two levels: within blocks of ``block`` samples, each a window of its
    own, plus the sum of the blocks before; only the block totals meet in one task.
    """
    n = status.select(idx).join(counts, idx, "left").select(F.col(idx).cast("long").alias(idx), F.coalesce("n", F.lit(0)).cast("long").alias("n")).withColumn("_b", F.floor(F.col(idx) / block))
    totals = n.groupBy("_b").agg(F.sum("n").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = totals.select("_b", before.alias("base"))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("_b").orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = n.withColumn("p", inner).join(base, "_b").select(idx, (F.col("base") + F.col("p")).alias("ptr"))
    end = n.agg((F.coalesce(F.max(idx), F.lit(-1)) + 1).alias(idx), F.coalesce(F.sum("n"), F.lit(0)).alias("ptr"))
    return rows.union(end)


def resume_index(status: DataFrame, idx: str = "sample_idx") -> DataFrame:
    """One row: the first position that is not valid, else the number of positions."""
    return status.agg(F.coalesce(F.min(F.when(~F.coalesce("valid", F.lit(False)), F.col(idx))), F.count("*")).cast("long").alias("resume_index"))


def remaining(samples: DataFrame, status: DataFrame, idx: str = "sample_idx") -> DataFrame:
    """Samples from the resume index on."""
    return samples.join(F.broadcast(resume_index(status, idx)), F.col(idx) >= F.col("resume_index")).drop("resume_index")
