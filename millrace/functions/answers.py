"""Answers from generated text: extraction per dataset, normalisation and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import ascii_digits, bound, clean_latex, first_match, last_match, nfkc, strip, strip_end

# Word lists and patterns that results depend on.
ANSWER_PREFIXES = {
    "en": "Answer",
    "bn": "উত্তর",
    "de": "Antwort",
    "es": "Respuesta",
    "fr": "Réponse",
    "ja": "答え",
    "ru": "Ответ",
    "sw": "Jibu",
    "te": "సమాధానం",
    "th": "คำตอบ",
    "zh": "答案",
}
NUMBER = r"(?U)[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"
PAYLOAD = r"(.+?)(?:(?<!\d)\.(?!\d)|$)"
ANSWER_IS = rf"(?isdU)(?:Therefore,?\s*)?(?:the\s+)?answer\s+is\s*{PAYLOAD}"
BOXED = r"(?s)\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"
HOTPOT = (r"(?idU)Answer:\s*(.+?)(?:\.|$)", r"(?idU)answer is\s*(.+?)(?:\.|$)")
YES, NO = ("yes", "true", "correct"), ("no", "false", "incorrect")

# Dataset to the name of its extractor; others are generic.
EXTRACTORS = {
    "mgsm": "numeric",
    "gsm8k": "numeric",
    "math": "boxed",
    "mmlu": "choice4",
    "belebele": "choice4",
    "commonsenseqa": "choice5",
    "hotpotqa": "hotpot",
    "theoremqa": "theorem",
}
NUMERIC_DATASETS = ("mgsm", "gsm8k", "math")


def normalize_text(text: Column) -> Column:
    """NFKC, then full-width and ideographic stops and colons as ASCII; null is empty."""
    return F.translate(nfkc(F.coalesce(text, F.lit(""))), "．。：", "..:")


def without_commas(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(""))


def last_number(c: Column) -> Column:
    """The last number of a text whose commas are dropped, less trailing stops; '' if none."""
    return strip_end(last_match(without_commas(c), NUMBER, 0), ".")


def _first_of(*options: Column) -> Column:
    """The first that is not empty, else ''."""
    return F.coalesce(*(F.nullif(o, F.lit("")) for o in options), F.lit(""))


def numeric(text: Column, language: Column | None = None) -> Column:
    """The last number after the last line-start prefix of the language, else after the last
    "Answer:", else in the first "answer is", else of the text."""

    def after(pattern: str | Column) -> Column:
        return last_number(strip(last_match(text, pattern)))

    line = rf"(?:^|\n)\s*Answer:\s*{PAYLOAD}"
    tiers = [after("(?isdU)" + line), last_number(strip(first_match(text, ANSWER_IS))), last_number(text)]
    if language is not None:
        known = F.create_map(*(F.lit(x) for kv in ANSWER_PREFIXES.items() for x in kv))
        prefix = F.coalesce(known[language], F.lit("Answer"))
        own = F.concat(F.lit(r"(?isdU)(?:^|\n)\s*\Q"), prefix, F.lit(rf"\E:\s*{PAYLOAD}"))
        # English, the common case, keeps its pattern a literal, which is compiled once.
        tiers.insert(0, F.when(prefix != "Answer", after(own)).otherwise(F.lit("")))
    return _first_of(*tiers)


def boxed(text: Column) -> Column:
    """Content of the first \\boxed{}, outer braces peeled and \\text{} taken out."""
    inner = strip(first_match(text, BOXED))
    # One nesting level is matched, so one pair can enclose the whole.
    peeled = F.when(inner.startswith("{") & inner.endswith("}") & (F.length(inner) > 1), strip(inner.substr(F.lit(2), F.length(inner) - 2))).otherwise(inner)
    return F.regexp_replace(peeled, r"\\text\{[^}]*\}", "")


def choice(text: Column, options: int) -> Column:
    """Letter of the last "Answer: X" among the first ``options`` letters."""
    return F.upper(last_match(text, rf"(?iU)Answer\s*:\s*([A-{chr(64 + options)}])"))


def hotpot(text: Column) -> Column:
    """Payload of the last "Answer:", else of the last "answer is", up to a stop on its line."""
    a, b = (F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in HOTPOT)
    last = F.when(F.size(a) > 0, F.try_element_at(a, F.lit(-1))).otherwise(F.coalesce(F.try_element_at(b, F.lit(-1)), F.lit("")))
    return strip_end(strip(last), ".")


def theorem(text: Column, answer_type: Column) -> Column:
    """The first boxed content, else the first "answer is", by answer type; else the last number."""

    def by_type(clean: Column) -> Column:
        low = F.lower(clean)
        return (
            F.when(answer_type == "bool", F.when(low.contains("true") | low.contains("yes"), "True").when(low.contains("false") | low.contains("no"), "False").otherwise(""))
            .when(answer_type.isin("integer", "float"), last_number(clean))
            .when(answer_type.isin("list of integer", "list of float"), strip(first_match(clean, r"\[([^\]]+)\]")))
            .when(answer_type == "option", F.upper(first_match(clean, r"(?i)\(([a-d])\)")))
            .otherwise(clean)
        )

    candidate = _first_of(strip(first_match(text, BOXED)), strip(first_match(text, ANSWER_IS)))
    # Of the branches one is worked out.
    return F.coalesce(bound(F.struct(candidate.alias("c"), text.alias("t")), lambda x: F.when(x["c"] == "", last_number(x["t"]))), by_type(clean_latex(candidate)))


def generic(text: Column) -> Column:
    """The first "answer is" payload, else the first "Answer:" payload."""
    found = F.regexp_extract_all(text, F.lit(ANSWER_IS), F.lit(1))
    return strip(F.when(F.size(found) > 0, F.get(found, F.lit(0))).otherwise(first_match(text, HOTPOT[0])))


def extract(dataset: Column, text: Column, language: Column, answer_type: Column) -> Column:
    """The answer in a normalised text, by the dataset's extractor."""
    by = {"numeric": numeric(text, language), "boxed": boxed(text), "choice4": choice(text, 4), "choice5": choice(text, 5), "hotpot": hotpot(text), "theorem": theorem(text, answer_type)}
    branches = [(F.lower(dataset) == name, by[kind]) for name, kind in EXTRACTORS.items()]
    return reduce(lambda acc, b: acc.when(*b), branches[1:], F.when(*branches[0])).otherwise(generic(text))


def normalize_answer(answer: Column) -> Column:
    """An answer as it is compared: the first bracketed list, or else the text without blanks and
    commas, \\left and \\right, and trailing zeros of a decimal."""
    a = F.coalesce(answer, F.lit(""))
    items = F.when(a.contains("[") & a.contains("]"), first_match(a, r"\[([^\]]+)\]")).otherwise(F.lit(""))
    listed = F.concat(F.lit("["), strip(F.regexp_replace(items, r"(?U)\s+", " ")), F.lit("]"))
    plain = F.regexp_replace(F.replace(a, F.lit("\\dfrac"), F.lit("\\frac")), r"\\(left|right)([(\[\])])", "$2")
    plain = F.translate(plain, " ,", "")
    plain = F.when(plain.contains("."), strip_end(strip_end(plain, "0"), ".")).otherwise(plain)
    return F.when(items != "", listed).otherwise(plain)


def same_number(a: Column, b: Column, within: float = 1e-6) -> Column:
    """Whether both read as finite numbers less than ``within`` apart."""

    def number(c: Column) -> Column:
        c = ascii_digits(strip(c))
        digits = r"[0-9]+(?:_[0-9]+)*"
        ok = c.rlike(rf"^[+-]?(?:{digits}\.?(?:{digits})?|\.{digits})(?:[eE][+-]?{digits})?$")
        return F.when(ok, F.replace(c, F.lit("_"), F.lit(""))).try_cast("double")

    return F.coalesce(F.abs(number(a) - number(b)) < within, F.lit(False))


def same_phrase(a: Column, b: Column) -> Column:
    """Equal, one within the other, or both of the yes or of the no class; case ignored."""
    a, b = strip(F.lower(a)), strip(F.lower(b))
    return (a == b) | a.contains(b) | b.contains(a) | (a.isin(*YES) & b.isin(*YES)) | (a.isin(*NO) & b.isin(*NO))


def validate(dataset: Column, extracted: Column, truth: Column, answer_type: Column) -> Column:
    """Whether an extracted answer is right; an empty one never is."""
    return validate_normalized(dataset, extracted, normalize_answer(extracted), normalize_answer(truth), answer_type)


def validate_normalized(dataset: Column, extracted: Column, e: Column, g: Column, answer_type: Column) -> Column:
    """``validate`` with both sides normalised already."""
    name = F.lower(dataset)
    as_number = name.isin(*NUMERIC_DATASETS) | ((name == "theoremqa") & F.coalesce(answer_type.isin("integer", "float"), F.lit(False)))
    right = F.when(name == "hotpotqa", same_phrase(e, g)).otherwise((as_number & same_number(e, g)) | (F.lower(e) == F.lower(g)))
    return F.when(F.coalesce(extracted, F.lit("")) == "", F.lit(False)).otherwise(right)


def add_labels(df: DataFrame, text: str = "generated_text") -> DataFrame:
    """``df`` (dataset, a generated text, answer_gt, language, answer_type) with extracted_answer
    and correct. Each step is a column of its own, so none is worked out twice."""
    types = F.col("answer_type")
    out = df.withColumn("_text", normalize_text(F.col(text)))
    out = out.withColumn("extracted_answer", extract(F.col("dataset"), F.col("_text"), F.col("language"), types))
    out = out.withColumns({"_e": normalize_answer(F.col("extracted_answer")), "_g": normalize_answer(F.col("answer_gt"))})
    return out.withColumn("correct", validate_normalized(F.col("dataset"), F.col("extracted_answer"), F.col("_e"), F.col("_g"), types)).drop("_text", "_e", "_g")
