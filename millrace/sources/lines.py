"""JSON-lines files as a data source of Spark: numbered lines without a shuffle, and a head that stops.

Files are cut into splits. A first job counts the line ends of each split, which takes one
number a split to the driver; their prefix sums number the lines, so the second job reads each
split with the number of its first line at hand and moves no text between tasks. For the first
n lines splits are counted in growing waves, as far as n lines go, and only these are read: the
last task stops in the middle of its split.

A line ends with \\n or \\r\\n and belongs to the split that its first byte is in. Bytes that are not
UTF-8 are replaced. Files are opened with pyarrow's file systems (local folders and object
stores); what only Spark opens goes through ``jsonl.read_lines``.
"""

from __future__ import annotations

import base64
import fnmatch
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 64 << 20
BLOCK = 1 << 16
#: Bytes of lines that are handed to Spark at once.
BATCH_BYTES = 4 << 20


@dataclass
class Split(InputPartition):
    """A part of a file: its number, place, size of the file, and the number of its first line."""

    number: int
    file: str
    start: int
    end: int
    size: int
    first: int = 0
    most: int = -1


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def readable(path: str) -> bool:
    """Whether this source can open a path."""
    try:
        system, place = _opened(path)
        return system.get_file_info(place).type != fs.FileType.NotFound
    except (OSError, ValueError, pa.ArrowException):
        return False


def splits(path: str, glob: str = "*", split_bytes: int = SPLIT_BYTES) -> list[Split]:
    """The splits of a file, or of the files of a folder that match, in the order of their names."""
    system, place = _opened(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.File:
        found = [info]
    else:
        every = system.get_file_info(fs.FileSelector(place))
        found = sorted((f for f in every if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, glob) and not f.base_name.startswith(("_", "."))), key=lambda f: f.base_name)
    cuts = [(f.path, start, min(start + split_bytes, f.size), f.size) for f in found for start in range(0, f.size, split_bytes)]
    return [Split(i, *c) for i, c in enumerate(cuts)]


def count_lines(stream: pa.NativeFile, split: Split) -> int:
    """Lines whose first byte is in the split."""
    at, n = max(0, split.start - 1), int(split.start == 0)
    stream.seek(at)
    while at < split.end - 1:
        block = stream.read(min(1 << 20, split.end - 1 - at))
        if not block:
            break
        n += block.count(b"\n")
        at += len(block)
    return n


def lines_of(stream: pa.NativeFile, split: Split) -> Iterator[list[bytes]]:
    """The lines of a split, some at a time, as far as is asked for."""
    left = split.most if split.most >= 0 else split.size
    at = max(0, split.start - 1)
    stream.seek(at)
    rest, inside = b"", split.start == 0
    while left > 0:
        block = stream.read(BLOCK)
        data = rest + block
        if not inside:  # the line that begins before the split
            cut = data.find(b"\n")
            if cut < 0:
                if not block:
                    return
                at += len(data)
                continue
            data, at, inside = data[cut + 1 :], at + cut + 1, True
        if at >= split.end:
            return
        lines = data.split(b"\n")
        rest = lines.pop()
        if not block and rest:
            lines.append(rest)
        if at + len(data) > split.end:  # some may begin beyond the split
            starts = at + np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])[: len(lines)]
            lines = lines[: int(np.searchsorted(starts, split.end))]
        if lines:
            yield lines[:left]
            left -= len(lines)
        at += len(data) - len(rest)
        if not block or at >= split.end:
            return


class LineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.counting = options.get("mode") == "count"

    def partitions(self) -> list[Split]:
        o = self.options
        own = splits(o["path"], o.get("glob", "*"), int(o.get("split_bytes", SPLIT_BYTES)))
        own = own[int(o.get("from", 0)) : int(o.get("to", len(own)))]
        if "firsts" in o:
            firsts = np.frombuffer(zlib.decompress(base64.b64decode(o["firsts"])), "<i8")
            for s, first in zip(own, firsts, strict=True):
                s.first = int(first)
        if "most" in o:
            for s in own:
                s.most = max(0, int(o["most"]) - s.first)
        return own

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.options["path"])
        with system.open_input_file(partition.file) as stream:
            if self.counting:
                n = count_lines(stream, partition)
                yield pa.RecordBatch.from_arrays([pa.array([partition.number]), pa.array([partition.file]), pa.array([n])], names=["split", "file", "n"])
                return
            name, at = os.path.basename(partition.file), partition.first
            held: list[str] = []
            size = 0

            def batch() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array(np.arange(at, at + len(held))), pa.array(held, pa.string())], names=["file_name", "line_idx", "raw"])

            for lines in lines_of(stream, partition):
                held += [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]
                size += sum(map(len, lines))
                if size > BATCH_BYTES:
                    yield batch()
                    at, held, size = at + len(held), [], 0
            if held:
                yield batch()


class Lines(DataSource):
    """``spark.read.format("jsonl_lines")``; ``scan_lines`` says which options go together."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_lines"

    def schema(self) -> str:
        return "split long, file string, n long" if self.options.get("mode") == "count" else "file_name string, line_idx long, raw string"

    def reader(self, schema) -> LineReader:  # noqa: ANN001, ARG002
        return LineReader(dict(self.options))


def counted(spark: SparkSession, path: str, glob: str, split_bytes: int, lo: int, hi: int) -> dict[int, int]:
    """Lines of each of the splits from ``lo`` to before ``hi``."""
    rows = spark.read.format("jsonl_lines").options(path=path, glob=glob, split_bytes=split_bytes, mode="count", **{"from": lo, "to": hi}).load()
    return {r.split: r.n for r in rows.toLocalIterator()}


def scan_lines(spark: SparkSession, path: str, glob: str = "*.jsonl", as_one: bool = False, head: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file_name, line_idx, raw): lines with their 0-based index in their file, or with ``as_one`` in
    all files in the order of their names; with ``head`` the first so many of all files as one.
    """
    spark.dataSource.register(Lines)
    own = splits(path, glob, split_bytes)
    if not own or head == 0:
        return spark.createDataFrame([], "file_name string, line_idx long, raw string")
    counts: list[int] = []
    wave = 1 if head is not None else len(own)
    while len(counts) < len(own) and (head is None or sum(counts) < head):
        hi = min(len(own), len(counts) + wave)
        got = counted(spark, path, glob, split_bytes, len(counts), hi)
        counts += [got[k] for k in range(len(counts), hi)]
        wave *= 2
    firsts = np.cumsum([0, *counts[:-1]]) if counts else np.zeros(0, np.int64)
    if head is None and not as_one:  # each file begins anew
        begins = np.array([s.start == 0 for s in own])
        firsts = firsts - firsts[begins][np.cumsum(begins) - 1]
    wanted = len(counts) if head is None else int(np.searchsorted(firsts, head))
    packed = base64.b64encode(zlib.compress(np.asarray(firsts[:wanted], "<i8").tobytes())).decode()
    options = {"path": path, "glob": glob, "split_bytes": split_bytes, "from": 0, "to": wanted, "firsts": packed}
    return spark.read.format("jsonl_lines").options(**options, **({} if head is None else {"most": head})).load()
