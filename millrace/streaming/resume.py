"""Where a run goes on, kept as state while samples arrive.

A stream of sample statuses keeps, for each model and dataset, which positions are valid: as
intervals, so a run that goes through its samples in order is one pair of numbers, however long.
A status that arrives later counts over an earlier one; within a batch the one with the greatest
``seq`` does.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.store import VersionedTable

EVENTS = "model string, dataset string, sample_idx long, valid boolean, seq long"
POSITIONS = "model string, dataset string, resume_index long, n_valid long, n_seen long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Intervals:
    """A set of whole numbers as disjoint intervals [low, high), in order."""

    def __init__(self, lows: list[int], highs: list[int]):
        self.lows, self.highs = list(lows), list(highs)

    def _at(self, x: int) -> int:
        """The interval that holds x, or -1."""
        k = bisect.bisect_right(self.lows, x) - 1
        return k if k >= 0 and x < self.highs[k] else -1

    def add(self, x: int) -> None:
        if self._at(x) >= 0:
            return
        k = bisect.bisect_right(self.lows, x)  # the interval after x
        before, after = k > 0 and self.highs[k - 1] == x, k < len(self.lows) and self.lows[k] == x + 1
        if before and after:
            self.highs[k - 1] = self.highs.pop(k)
            self.lows.pop(k)
        elif before:
            self.highs[k - 1] = x + 1
        elif after:
            self.lows[k] = x
        else:
            self.lows.insert(k, x)
            self.highs.insert(k, x + 1)

    def discard(self, x: int) -> None:
        k = self._at(x)
        if k < 0:
            return
        low, high = self.lows[k], self.highs[k]
        rest = [(a, b) for a, b in ((low, x), (x + 1, high)) if a < b]
        self.lows[k : k + 1] = [a for a, _ in rest]
        self.highs[k : k + 1] = [b for _, b in rest]

    def first_missing(self) -> int:
        return self.highs[0] if self.lows and self.lows[0] == 0 else 0

    def __len__(self) -> int:
        return sum(self.highs) - sum(self.lows)


class ResumePositions(StatefulProcessor):
    """A row per model and dataset of a batch: the first position that is not valid."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("positions", "valid_lows array<long>, valid_highs array<long>, seen_lows array<long>, seen_highs array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        old = self.state.get() if self.state.exists() else ([], [], [], [])
        valid, seen = Intervals(old[0], old[1]), Intervals(old[2], old[3])
        last: dict[int, tuple[int, bool]] = {}
        for part in rows:
            for idx, ok, seq in part[["sample_idx", "valid", "seq"]].itertuples(index=False, name=None):
                if idx not in last or seq >= last[idx][0]:
                    last[idx] = (seq, bool(ok))
        for idx in sorted(last):
            (valid.add if last[idx][1] else valid.discard)(int(idx))
            seen.add(int(idx))
        self.state.update((valid.lows, valid.highs, seen.lows, seen.highs))
        yield pd.DataFrame({"model": [key[0]], "dataset": [key[1]], "resume_index": [valid.first_missing()], "n_valid": [len(valid)], "n_seen": [len(seen)]})

    def close(self) -> None:
        pass


def resume_positions(events: DataFrame) -> DataFrame:
    """(model, dataset, resume_index, n_valid, n_seen) of a stream of ``EVENTS``, as they change. A null
    position is passed over, a null validity is none."""
    whole = events.where("sample_idx IS NOT NULL").select("model", "dataset", "sample_idx", F.coalesce("valid", F.lit(False)).alias("valid"), F.coalesce("seq", F.lit(0)).alias("seq"))
    return whole.groupBy("model", "dataset").transformWithStateInPandas(ResumePositions(), POSITIONS, "Update", "none")


def resume_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Take in all files of ``source`` that are new since the last call, and keep the positions in the
    versioned table ``target``. Needs a state store that ``transformWithState`` can use (RocksDB)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def keep(batch: DataFrame, _epoch: int) -> None:
        VersionedTable(spark, target, ["model", "dataset"]).upsert(batch, ["model", "dataset"])

    found = resume_positions(spark.readStream.schema(EVENTS).parquet(source))
    return found.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
