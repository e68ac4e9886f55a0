"""Batches for an inference hook: prompts of like length together, errors row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame

from millrace.schemas import GENERATIONS, SAMPLE_KEY

#: Rows in, as many results out: dicts of the GENERATIONS columns that it knows, and "states" (any
#: truth) where it returned hidden states.
Model = Callable[[list[dict]], list[dict]]
LACKING = "hidden states are missing although there are tokens"


class Buckets:
    """Deals rows into batches whose rows times longest length stay within an area.

    Rows wait by the next power of two of their length; a batch leaves when another row would
    overfill it. So what waits is at most an area a power of two.
    """

    def __init__(self, area: int, length: Callable[[dict], int]):
        self.area, self.length = area, length
        self.waiting: dict[int, list[dict]] = {}

    def add(self, row: dict) -> list[dict]:
        """The batch that the row drives out, if any."""
        width = 1 << max(0, self.length(row) - 1).bit_length()
        held = self.waiting.setdefault(width, [])
        out: list[dict] = []
        if held and (len(held) + 1) * width > self.area:
            out, self.waiting[width] = held, []
        self.waiting[width].append(row)
        return out

    def rest(self) -> Iterator[list[dict]]:
        """What waits, longest first."""
        for width in sorted(self.waiting, reverse=True):
            if self.waiting[width]:
                yield self.waiting[width]
        self.waiting = {}


def batched(model: Callable[[], Model], area: int, length: Callable[[dict], int] = lambda row: len(row["prompt"]), need_states: bool = False) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A hook that makes its model once a task and calls it with batches of bounded area.

    Where a batch fails, its rows are tried alone, and those that fail again are errors. With
    ``need_states`` a row that has tokens but no states is an error too.
    """
    names = [f.split()[0] for f in GENERATIONS.split(", ")]

    def checked(row: dict, result: dict) -> dict:
        key = {k: row[k] for k in SAMPLE_KEY}
        tokens = result.get("generated_token_ids")
        if need_states and not result.get("error") and tokens is not None and len(tokens) and not result.get("states"):
            return {**key, "error": LACKING}
        return {**{k: v for k, v in result.items() if k in names}, **key}

    def answers(run: Model, rows: list[dict]) -> list[dict]:
        try:
            results = run(rows)
            if len(results) != len(rows):
                raise ValueError(f"{len(results)} results for {len(rows)} rows")
            return [checked(r, x) for r, x in zip(rows, results, strict=True)]
        except Exception as e:  # noqa: BLE001  one sample must not end the run
            if len(rows) > 1:
                return [x for r in rows for x in answers(run, [r])]
            return [{**{k: rows[0][k] for k in SAMPLE_KEY}, "error": f"{type(e).__name__}: {e}"}]

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)

    def hook(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, buckets = None, Buckets(area, length)
        for batch in batches:
            for row in batch.to_dict("records"):
                run = run or model()
                if full := buckets.add(row):
                    yield frame(answers(run, full))
        for left in buckets.rest():
            yield frame(answers(run, left))

    return hook


def generate_batched(prompted: DataFrame, model: Callable[[], Model], area: int, length: Callable[[dict], int] | None = None, need_states: bool = False, resources: ResourceProfile | None = None) -> DataFrame:
    """Generations of prompts (model, dataset, language, sample_id, prompt), in batches of bounded
    area; ``resources``: what a task of this stage needs, say a GPU."""
    hook = batched(model, area, need_states=need_states, **({"length": length} if length else {}))
    rows = prompted.select("model", "dataset", "language", "sample_id", "prompt")
    return rows.mapInPandas(hook, GENERATIONS, **({"profile": resources} if resources else {}))
