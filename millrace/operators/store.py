"""Tables that change by whole versions: Parquet files and a manifest that names them.

A change writes new files beside the old ones and then gives the next manifest its name, in one
step: whoever reads sees the version before or the one after, and a writer that dies leaves at
most files that no manifest names. The manifest has the range of keys of each file, so
an upsert reads and rewrites the files whose ranges its rows fall into, and a read of a range
opens the files that can hold it. It also has the statistics of each file, so the table's
statistics are a sum over the manifest: where a row is replaced, its file's statistics are too.
"""

from __future__ import annotations

import bisect
import json
import math
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators import files

ROWS_PER_FILE = 1 << 20
#: The name that the manifest has for a row's file.
NAME = "element_at(split(_metadata.file_path, '/files/'), -1)"


class ConcurrentChangeError(RuntimeError):
    """Another writer has made the version that this one was about to make."""


def keep_last(old: DataFrame | None, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Union by name; of each key the row of the newer table and, there, of the greatest ``seq``.

    ``seq`` orders the rows of a batch and is not kept; a batch without it is in the order of
    its rows, of which the later wins. Rows that a join has moved have no order: number them before.
    ``old`` may be a batch of its own, with ``seq``; without it there is one row of each key.
    """
    if seq not in new.columns:
        new = new.withColumn(seq, F.monotonically_increasing_id())
    fresh = new.withColumn("_gen", F.lit(1))
    both = fresh if old is None else old.withColumn("_gen", F.lit(0)).unionByName(fresh, allowMissingColumns=True)
    columns = [c for c in both.columns if c not in ("_gen", seq)]
    # max_by aggregates before the shuffle: a key that was written very often is one row a task.
    picked = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("_gen", seq)).alias("_row"))
    return picked.select("_row.*")


def _ranked(key: tuple) -> tuple:
    """A key that compares like Spark's: nulls come first."""
    return tuple((False,) if v is None else (True, v) for v in key)


class VersionedTable:
    """A table at ``path`` whose files are ranges of the columns ``order``.

    ``statistics``: names and SQL aggregates that are kept for each value of ``groups``; they have
    to be sums. A table is changed by upserts and removals, whose files never overlap, or by
    appends, whose files may.
    """

    def __init__(self, spark: SparkSession, path: str, order: list[str], groups: list[str] | None = None, statistics: dict[str, str] | None = None, rows_per_file: int = ROWS_PER_FILE):
        self.spark, self.path, self.order = spark, path.rstrip("/"), order
        self.groups, self.sums, self.rows_per_file = groups or [], statistics or {}, rows_per_file

    # Versions.

    def version(self) -> int:
        """The newest version, -1 before the first."""
        found = files.listed(self.spark, f"{self.path}/manifest", "*.json")
        return int(found[-1][0].removesuffix(".json")) if found else -1

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        if v < 0:
            return {"version": -1, "schema": None, "files": []}
        return json.loads(files.read_text(self.spark, f"{self.path}/manifest/{v:012d}.json"))

    def _commit(self, seen: int, schema: StructType, kept: list[dict]) -> None:
        staged = f"{self.path}/manifest/{uuid.uuid4().hex}.tmp"
        files.write_text(self.spark, staged, json.dumps({"version": seen + 1, "schema": schema.jsonValue(), "files": kept}))
        if not files.move_new(self.spark, staged, f"{self.path}/manifest/{seen + 1:012d}.json"):
            files.delete(self.spark, staged)
            raise ConcurrentChangeError(f"version {seen + 1} of {self.path} is there already")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete all but the newest ``keep`` versions, and the files that only they, or no manifest,
        name. No change may be under way."""
        newest = self.version()
        for v in range(newest - keep, -1, -1):
            files.delete(self.spark, f"{self.path}/manifest/{v:012d}.json")
        used = {f["name"].split("/")[0] for v in range(max(0, newest - keep + 1), newest + 1) for f in self.manifest(v)["files"]}
        stale = [name for name, _ in files.listed(self.spark, f"{self.path}/files") if name not in used]
        for name in stale:
            files.delete(self.spark, f"{self.path}/files/{name}")
        return stale

    # Reading.

    def _frame(self, manifest: dict, some: list[dict]) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        if not some:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/files/{f['name']}" for f in some))

    def read(self, lo: object = None, hi: object = None, version: int | None = None) -> DataFrame | None:
        """The table, or the rows whose first ordering column is from ``lo`` to ``hi``; None before
        the first version."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            return None
        own = [f for f in manifest["files"] if (hi is None or f["lo"][0] is None or f["lo"][0] <= hi) and (lo is None or (f["hi"][0] is not None and f["hi"][0] >= lo))]
        rows, first = self._frame(manifest, own), F.col(self.order[0])
        rows = rows if lo is None else rows.where(first >= F.lit(lo))
        return rows if hi is None else rows.where(first <= F.lit(hi))

    def read_with_files(self, version: int | None = None) -> DataFrame | None:
        """The table with the manifest's name of each row's file in ``_name``."""
        rows = self.read(version=version)
        return None if rows is None else rows.withColumn("_name", F.expr(NAME))

    def stats_before(self, version: int | None = None) -> DataFrame:
        """(_name, groups, statistics): for each file and group that it has rows of, the sums over all
        files before it in the table's order. Files must not overlap."""
        upto: dict[tuple, list] = {}
        rows = []
        for f in sorted(self.manifest(version)["files"], key=lambda f: _ranked(f["lo"])):
            for row in f["stats"]:
                key, own = tuple(row[: len(self.groups)]), row[len(self.groups) :]
                before = upto.get(key, [0] * len(own))
                rows.append((f["name"], *key, *before))
                upto[key] = [a + b for a, b in zip(before, own, strict=True)]
        schema = ", ".join(["_name string", *(f"`{g}` string" for g in self.groups), *(f"`{s}` long" for s in self.sums)])
        return self.spark.createDataFrame(rows, schema)

    def stats(self, version: int | None = None) -> DataFrame:
        """(groups, statistics), from the manifest alone."""
        total: dict[tuple, list] = {}
        for f in self.manifest(version)["files"]:
            for row in f["stats"]:
                key, own = tuple(row[: len(self.groups)]), row[len(self.groups) :]
                total[key] = [a + b for a, b in zip(total.get(key, [0] * len(own)), own, strict=True)]
        schema = ", ".join([*(f"`{g}` string" for g in self.groups), *(f"`{s}` long" for s in self.sums)])
        return self.spark.createDataFrame([(*k, *v) for k, v in total.items()], schema)

    # Changing.

    def _written(self, rows: DataFrame, by: list[str]) -> list[dict]:
        """Write rows that are dealt already, a folder for each value of ``by``; entries of the files."""
        folder = uuid.uuid4().hex
        (rows.write.partitionBy(*by) if by else rows.write).parquet(f"{self.path}/files/{folder}")
        return self._described(folder, rows.drop(*by).schema)

    def _described(self, folder: str, schema: StructType) -> list[dict]:
        place = f"{self.path}/files/{folder}"
        back = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(place)
        name = F.expr(NAME).alias("_name")
        key = F.struct(*self.order)
        sums = [F.expr(e).cast("long").alias(f"_s{i}") for i, e in enumerate(self.sums.values())]
        grouped = back.groupBy(name, *(F.col(g).cast("string").alias(f"_g{i}") for i, g in enumerate(self.groups)))
        found: dict[str, dict] = {}
        for r in grouped.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"), F.count("*").alias("_n"), *sums).toLocalIterator():
            lo, hi = list(r["_lo"]), list(r["_hi"])
            own = found.setdefault(r["_name"], {"name": r["_name"], "lo": lo, "hi": hi, "rows": 0, "stats": []})
            own["lo"], own["hi"] = min(own["lo"], lo, key=_ranked), max(own["hi"], hi, key=_ranked)
            own["rows"] += r["_n"]
            own["stats"].append([*(r[f"_g{i}"] for i in range(len(self.groups))), *(r[f"_s{i}"] or 0 for i in range(len(self.sums)))])
        return sorted(found.values(), key=lambda f: _ranked(f["lo"]))

    def _route(self, entries: list[dict]):  # noqa: ANN202
        """A column: the number of the file into whose range, or the gap after it, a row falls; the
        number of files for rows beyond a last file that is full."""
        lows = [_ranked(f["lo"]) for f in entries]
        n = len(entries)
        last = _ranked(entries[-1]["hi"]) if entries else ()
        closed = not entries or entries[-1]["rows"] * 2 >= self.rows_per_file

        @F.pandas_udf("int")
        def place(key: pd.DataFrame) -> pd.Series:
            own = (_ranked(tuple(None if pd.isna(v) else v for v in row)) for row in key.astype(object).itertuples(index=False, name=None))
            return pd.Series([n if closed and (not n or k > last) else max(0, bisect.bisect_right(lows, k) - 1) for k in own], dtype="int32")

        return place(F.struct(*self.order))

    def _rewrite(self, batch: DataFrame, change) -> None:  # noqa: ANN001
        """Replace the files that the batch's rows fall into by what ``change`` makes of their rows."""
        manifest = self.manifest()
        entries, route = manifest["files"], self._route(manifest["files"])
        sizes = {r["_file"]: r["n"] for r in batch.groupBy(route.alias("_file")).agg(F.count("*").alias("n")).collect()}
        touched = [entries[k] for k in sorted(sizes) if k < len(entries)]
        merged = change(self._frame(manifest, touched) if touched else None)
        if merged is None:
            return
        parts = math.ceil((sum(sizes.values()) + sum(f["rows"] for f in touched)) / self.rows_per_file)
        # A range of rows may run over a file that is left alone: each old file's rows stay apart.
        dealt = merged.withColumn("_file", route).repartitionByRange(max(1, parts), "_file", *self.order).sortWithinPartitions("_file", *self.order)
        added = self._written(dealt, ["_file"])
        left = [f for k, f in enumerate(entries) if k not in sizes]
        self._commit(manifest["version"], merged.schema, sorted(left + added, key=lambda f: _ranked(f["lo"])))

    def upsert(self, batch: DataFrame, keys: list[str], seq: str = "seq") -> None:
        """Merge a batch; an empty one changes nothing. ``keys`` have to hold the ordering columns."""
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                self._rewrite(batch, lambda old: keep_last(old, batch, keys, seq))
        finally:
            batch.unpersist()

    def remove(self, keys: DataFrame) -> None:
        """Remove the rows whose values are in ``keys`` (its columns hold the ordering ones)."""
        if self.version() >= 0 and not keys.isEmpty():
            self._rewrite(keys, lambda old: None if old is None else old.join(keys.distinct(), keys.columns, "left_anti"))

    def append(self, dealt: DataFrame) -> None:
        """Add rows that are dealt to tasks and sorted as they shall lie in files."""
        manifest = self.manifest()
        added = self._written(dealt, [])
        schema = StructType.fromJson(manifest["schema"]) if manifest["schema"] else dealt.schema
        self._commit(manifest["version"], schema, manifest["files"] + added)

    def overwrite(self, dealt: DataFrame) -> None:
        """The rows instead of all that were there."""
        self._commit(self.version(), dealt.schema, self._written(dealt, []))
