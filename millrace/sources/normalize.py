"""Question-answering datasets in one record shape: one normaliser per source.

Each takes the source's rows with an ``idx`` column (their order) and returns unified
items; ``head`` keeps the first rows per source.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.answers import BOXED
from millrace.functions.text import last_match, strip
from millrace.sources.jsonl import write_jsonl

log = logging.getLogger(__name__)


def head(df: DataFrame, n: int | None) -> DataFrame:
    return df.where(F.col("idx") < n) if n else df


def field(df: DataFrame, name: str, default: str) -> Column:
    """A column, or the default where the source has no such column; a null stays."""
    return F.col(name) if name in df.columns else F.lit(default)


def letter(index: Column) -> Column:
    """0 is A."""
    return F.char(index.cast("int") + 65)


def option_lines(labels: Column | None, texts: Column) -> Column:
    """"label. text" lines; labels and texts are paired as far as both go."""
    if labels is None:
        lines = F.transform(texts, lambda t, i: F.concat(letter(i), F.lit(". "), t))
    else:
        n = F.least(F.size(labels), F.size(texts))
        lines = F.zip_with(F.slice(labels, F.lit(1), n), F.slice(texts, F.lit(1), n), lambda a, t: F.concat(a, F.lit(". "), t))
    return F.array_join(lines, "\n")


def with_choices(question: Column, options: Column) -> Column:
    return F.concat(question, F.lit("\n\nChoices:\n"), options)


def gsm8k_answer(solution: Column) -> tuple[Column, Column]:
    """(answer after the last ####, solution before the first)."""
    parts = F.split(solution, "####")
    return strip(F.try_element_at(parts, F.lit(-1))), strip(F.get(parts, F.lit(0)))


def math_answer(solution: Column) -> Column:
    """Content of the last \\boxed{} without dollar signs; else what follows the last "The answer
    is" up to a stop or a line's end; else ''."""
    s = F.coalesce(solution, F.lit(""))
    boxes = F.regexp_extract_all(s, F.lit(BOXED), F.lit(1))
    told = F.substring_index(F.substring_index(F.substring_index(s, "The answer is", -1), ".", 1), "\n", 1)
    return F.when(F.size(boxes) > 0, F.replace(strip(last_match(s, BOXED)), F.lit("$"), F.lit(""))).when(s.contains("The answer is"), strip(told)).otherwise("")


def hotpot_question(question: Column, titles: Column, sentences: Column, most: int = 5) -> Column:
    """The question with its first ``most`` contexts, if it has any."""
    n = F.least(F.size(titles), F.size(sentences), F.lit(most))
    parts = F.zip_with(F.slice(titles, F.lit(1), n), F.slice(sentences, F.lit(1), n), lambda t, s: F.concat(t, F.lit(": "), F.array_join(s, " ")))
    return F.when(F.coalesce(n, F.lit(0)) > 0, F.concat(question, F.lit("\n\nContext:\n"), F.array_join(parts, "\n\n"))).otherwise(question)


def belebele_letter(number: Column) -> Column:
    """1 is A; strings of digits count; anything else, 0 and less is ''."""
    text = number.cast("string")
    n = F.when(text.rlike("^-?[0-9]+$"), text.try_cast("int"))
    return F.when(n > 0, F.char(n + 64)).otherwise("")


def belebele_question(df: DataFrame) -> Column:
    given = [F.concat(F.lit(f"({chr(64 + i)}) "), F.col(f"mc_answer{i}")) for i in range(1, 5) if f"mc_answer{i}" in df.columns]
    return F.concat(F.lit("Passage:\n"), F.col("flores_passage"), F.lit("\n\nQuestion: "), F.col("question"), F.lit("\n\nChoices:\n"), F.array_join(F.array(*given), "\n") if given else F.lit(""))


def _item(df: DataFrame, dataset: str, kind: Column | str, **columns: Column) -> DataFrame:
    ids = columns.pop("id", F.col("idx"))
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(ids.alias("id"), F.lit(dataset).alias("dataset"), kind.alias("type"), *(c.alias(k) for k, c in columns.items()))


def normalize_mgsm(df: DataFrame) -> DataFrame:
    return _item(df, "mgsm", "math_word_problem", question=F.col("question"), answer=F.coalesce(F.col("answer_number").cast("string"), F.lit("")), language=F.lit("en"))


def normalize_gsm8k(df: DataFrame) -> DataFrame:
    answer, solution = gsm8k_answer(F.col("answer"))
    return _item(df, "gsm8k", "math_word_problem", question=F.col("question"), answer=answer, full_solution=solution)


def normalize_math(df: DataFrame) -> DataFrame:
    """With a ``config`` column the items of a source of several configurations."""
    many = "config" in df.columns
    return _item(
        df, "math", F.col("config") if many else field(df, "type", "unknown"), id=F.concat_ws("_", "config", F.col("idx").cast("string")) if many else F.col("idx"),
        question=field(df, "problem", ""), answer=math_answer(field(df, "solution", "")), level=field(df, "level", ""), solution=field(df, "solution", ""),
    )


def normalize_commonsenseqa(df: DataFrame) -> DataFrame:
    c = F.col("choices")
    return _item(df, "commonsenseqa", "multiple_choice", question=with_choices(F.col("question"), option_lines(c["label"], c["text"])), answer=F.col("answerKey"), num_choices=F.size(c["label"]))


def normalize_hotpotqa(df: DataFrame) -> DataFrame:
    question = hotpot_question(F.col("question"), F.col("context.title"), F.col("context.sentences")) if "context" in df.columns else F.col("question")
    facts = {"supporting_facts": F.col("supporting_facts")} if "supporting_facts" in df.columns else {}
    return _item(df, "hotpotqa", "multi_hop_reasoning", question=question, answer=F.col("answer"), level=field(df, "level", "medium"), **facts)


def normalize_theoremqa(df: DataFrame) -> DataFrame:
    more = {"theorem": F.col("Theorem")} if "Theorem" in df.columns else {}
    return _item(df, "theoremqa", "theorem_application", question=F.col("Question"), answer=F.coalesce(F.col("Answer").cast("string"), F.lit("None")), answer_type=field(df, "Answer_type", ""), **more)


def normalize_belebele(df: DataFrame) -> DataFrame:
    return _item(df, "belebele", "reading_comprehension", en=belebele_question(df), answer=belebele_letter(field(df, "correct_answer_num", "0")), language=F.lit("en"))


def normalize_mmlu(df: DataFrame) -> DataFrame:
    return _item(df, "mmlu", "multiple_choice", question=with_choices(F.col("question"), option_lines(None, F.col("choices"))), answer=letter(F.col("answer")), subject=field(df, "subject", "unknown"), num_choices=F.size("choices"))


def cap_in_order(df: DataFrame, order: list[str], n: int | None, config: str = "config") -> DataFrame:
    """The first ``n`` rows over all configurations, taken in the given order of these.

    The rank limit also holds within each task, so ``n`` rows of each meet at most.
    """
    place = F.array_position(F.array(*map(F.lit, order)), F.col(config))
    own = df.withColumn("_place", place).where(F.col("_place") > 0)
    if not n:
        return own.drop("_place")
    rank = F.row_number().over(Window.orderBy("_place", "idx"))
    return own.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_place", "_rank")


def first_with_rows(*sources: Callable[[], DataFrame]) -> DataFrame | None:
    """The first source that opens and has rows."""
    for k, source in enumerate(sources, 1):
        try:
            df = source()
            if not df.isEmpty():
                return df
            log.warning("source %d of %d has no rows", k, len(sources))
        except Exception as e:  # noqa: BLE001  a source that fails is passed over
            log.warning("source %d of %d failed: %s", k, len(sources), e)
    return None


#: All eight sources; a run of "all" takes every one.
NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "mgsm": normalize_mgsm,
    "gsm8k": normalize_gsm8k,
    "math": normalize_math,
    "commonsenseqa": normalize_commonsenseqa,
    "hotpotqa": normalize_hotpotqa,
    "theoremqa": normalize_theoremqa,
    "belebele": normalize_belebele,
    "mmlu": normalize_mmlu,
}


def prepare(sources: dict[str, list[Callable[[], DataFrame]]], root: str, only: list[str] | None = None, most: int | None = None) -> dict[str, int | None]:
    """Read, normalise and write the wanted datasets as ``root/name.jsonl``.

    ``sources``: for each dataset what opens it, tried in turn; with ``most``, at most so
    many of its first rows (by ``idx``) are taken. A dataset that fails is passed over. Returns
    the number of items of each, None where it failed.
    """
    done: dict[str, int | None] = {}
    for name in only or list(NORMALIZERS):
        done[name] = None
        try:
            raw = first_with_rows(*sources.get(name, []))
            if raw is None:
                log.warning("%s: no source has rows", name)
                continue
            items = NORMALIZERS[name](head(raw, most))
            write_jsonl(items, f"{root.rstrip('/')}/{name}.jsonl", "id")
            done[name] = items.count()
        except Exception as e:  # noqa: BLE001  the other datasets are still prepared
            log.warning("%s failed: %s", name, e)
    return done


def register_dataset(name: str, normalizer: Callable[[DataFrame], DataFrame], template: str | None = None, extractor: str | None = None) -> None:
    """Add a dataset: its normaliser and, if given, its prompt template and extractor's name."""
    from millrace.functions import answers, prompts

    NORMALIZERS[name] = normalizer
    if template is not None:
        prompts.TEMPLATES[name] = template
    if extractor is not None:
        answers.EXTRACTORS[name] = extractor
