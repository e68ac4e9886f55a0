"""JSON-lines sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import stringify_json
from millrace.operators import files
from millrace.operators.order import index_in_blocks
from millrace.sources.lines import readable, scan_lines


def list_files(spark: SparkSession, path: str, glob: str = "*.jsonl") -> list[str]:
    """Names of the files of a folder that match, sorted."""
    return [name for name, _ in files.listed(spark, path, glob)]


def read_lines(spark: SparkSession, path: str, glob: str = "*.jsonl", as_one: bool = False) -> DataFrame:
    """(file_name, line_idx, raw): every line with its 0-based index within its file, or with
    ``as_one`` within all files in the order of their names.

    A split of a file is numbered on its own, in the order of its rows, and the splits by
    their offsets; so a large file is numbered by as many tasks as read it.
    """
    lines = spark.read.option("pathGlobFilter", glob).text(path)
    meta = lines.select(
        F.col("value").alias("raw"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
    )
    if as_one:
        indexed = index_in_blocks(meta, [F.col("file_name"), F.col("block")], [F.col("row")], "line_idx")
    else:
        indexed = index_in_blocks(meta, [F.col("block")], [F.col("row")], "line_idx", per=["file_path", "file_name"])
    return indexed.select("file_name", "line_idx", "raw")


def has_key(raw: Column, key: Column | str) -> Column:
    """Whether a JSON object has a key, even if its value is null."""
    return F.coalesce(F.array_contains(F.json_object_keys(raw), key), F.lit(False))


def fragment(raw: Column, key: str) -> Column:
    """The raw JSON of a key's value; 'null' for a JSON null, null for no such key."""
    one = F.from_json(raw, f"`{key}` variant")
    return F.when(has_key(raw, F.lit(key)), F.coalesce(F.to_json(one[key]), F.lit("null")))


def text_of(raw: Column, key: str) -> Column:
    """The value of a key as Python's str() of it; null for no such key."""
    plain = F.get_json_object(raw, f"$.{key}")
    frag = fragment(raw, key)
    return F.when(frag.startswith('"'), plain).otherwise(stringify_json(F.when(~frag.startswith('"'), frag)))


def parse_samples(lines: DataFrame, dataset: str, language: str = "en", max_samples: int | None = None) -> DataFrame:
    """Samples from raw lines (line_idx, raw).

    The head of ``max_samples`` is taken of the raw lines, before any is dropped. The
    question is the first key there is of the language, "question" and "en"; a line
    without any, or whose answer is missing or an empty string, is dropped. A JSON null as
    the answer is the string "None".
    """
    own = lines.where(F.col("line_idx") < max_samples) if max_samples else lines
    raw = F.col("raw")
    question = F.when(has_key(raw, F.lit(language)), F.get_json_object(raw, f"$['{language}']")).when(has_key(raw, F.lit("question")), F.get_json_object(raw, "$.question")).when(has_key(raw, F.lit("en")), F.get_json_object(raw, "$.en"))
    has_question = has_key(raw, F.lit(language)) | has_key(raw, F.lit("question")) | has_key(raw, F.lit("en"))
    rows = own.where(raw.isNotNull() & (F.trim(raw) != "") & has_question).select(
        F.col("line_idx").alias("sample_id"), question.alias("question"), text_of(raw, "answer").alias("answer_gt"),
        F.lit(dataset).alias("dataset"), F.lit(language).alias("language"), F.get_json_object(raw, "$.answer_type").alias("answer_type"),
    )
    kept = rows.where(F.coalesce("answer_gt", F.lit("")) != "")
    return index_in_blocks(kept, [F.floor(F.col("sample_id") / 65536)], [F.col("sample_id")], "sample_idx")


def load_samples(spark: SparkSession, root: str, dataset: str, language: str = "en", max_samples: int | None = None) -> DataFrame:
    """Samples of ``root/dataset.jsonl``, a file or a folder of parts; ValueError if there is none.
    With ``max_samples`` no more is read than holds the first so many lines."""
    path = f"{root.rstrip('/')}/{dataset}.jsonl"
    if not files.exists(spark, path):
        raise ValueError(f"no dataset file at {path}")
    if readable(path):
        lines = scan_lines(spark, path, "*", as_one=True, head=max_samples or None)
    else:
        lines = read_lines(spark, path, "*", as_one=True)
    return parse_samples(lines, dataset, language, max_samples)


def write_jsonl(df: DataFrame, path: str, order: str | list[str] | None = None) -> None:
    """One JSON object per row, nulls left out, as a folder of parts whose names follow ``order``
    (dealt by range, so no task orders the whole); an empty table writes nothing."""
    if not df.isEmpty():
        by = [order] if isinstance(order, str) else order
        rows = df if by is None else df.repartitionByRange(*by).sortWithinPartitions(*by)
        rows.write.mode("overwrite").option("ignoreNullFields", "true").json(path)
