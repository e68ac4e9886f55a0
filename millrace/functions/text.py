"""String functions with Python's meaning, natively where Spark has them.

Patterns carry flags: d (only \\n ends a line), U (Unicode classes), i, s as needed.
"""

from __future__ import annotations

import ast
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ASCII_ONLY = r"^[\x00-\x7F]*$"


def strip(c: Column) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+\z", "")


#: The decimal digits of all scripts, by value.
DIGITS = "".join(c for c in map(chr, range(128, 0x20000)) if unicodedata.category(c) == "Nd")
DIGIT_VALUES = "".join(str(unicodedata.decimal(c)) for c in DIGITS)


def ascii_digits(c: Column) -> Column:
    """The digits of any script as ASCII ones."""
    return F.when(c.rlike(ASCII_ONLY), c).otherwise(F.translate(c, DIGITS, DIGIT_VALUES))


def strip_end(c: Column, char: str) -> Column:
    return F.rtrim(c, F.lit(char))


def first_match(c: Column, pattern: str | Column, group: int = 1) -> Column:
    """The group of the first match, '' where there is none."""
    return F.coalesce(F.get(F.regexp_extract_all(c, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(group)), F.lit(0)), F.lit(""))


def last_match(c: Column, pattern: str | Column, group: int = 1) -> Column:
    """The group of the last match, '' where there is none."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(c, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(group)), F.lit(-1)), F.lit(""))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(c: Column) -> Column:
    """NFKC form; only texts beyond ASCII reach Python."""
    return F.coalesce(_nfkc(F.when(~c.rlike(ASCII_ONLY), c)), c)


def python_str(value: object) -> str:
    """A JSON value as Python prints it."""
    return str(value)


@F.pandas_udf(StringType())
def _stringify(s: pd.Series) -> pd.Series:
    return s.map(lambda x: python_str(json.loads(x)), na_action="ignore")


def stringify_json(raw: Column) -> Column:
    """A raw JSON fragment as Python's str() gives it: strings unquoted, true as True, null as
    None. Plain strings and integers, which need nothing else, stay native."""
    plain = raw.rlike(r'^"[^"\\]*"$')
    whole = raw.rlike(r"^-?(?:0|[1-9][0-9]*)$")
    return F.when(plain, raw.substr(F.lit(2), F.length(raw) - 2)).when(whole & (raw != "-0"), raw).otherwise(_stringify(F.when(~plain & ~whole | (raw == "-0"), raw)))


def half_round(vector: Column) -> Column:
    """Each component rounded to half precision, ties to even; exact in single precision.

    A number is scaled by its last place in half precision, rounded to a whole number and scaled
    back; all three are exact. What rounds beyond the largest number is infinite.
    """

    def one(x: Column) -> Column:
        d = x.cast("double")
        size = F.abs(d)
        # For a power of two the logarithm may fall short, and the place is then finer than need be.
        place = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)), F.lit(-14)) - 10)
        same = (size == 0) | F.isnan(d) | (size == float("inf"))
        return F.when(same, d).when(size >= 65520, F.signum(d) * float("inf")).otherwise(F.rint(d / place) * place).cast("float")

    return F.transform(vector.cast("array<float>") if isinstance(vector, Column) else F.col(vector).cast("array<float>"), one)


_MOST_BITS = 20_000


def arithmetic(text: str) -> int | float:
    """Value of an expression of numbers, +, -, * and **; ValueError for anything else or for
    numbers beyond a bound. The text is parsed, never run."""

    def value(node: ast.AST) -> int | float:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            x = value(node.operand)
            return -x if isinstance(node.op, ast.USub) else +x
        if isinstance(node, ast.BinOp):
            a, b = value(node.left), value(node.right)
            if isinstance(node.op, ast.Add):
                return a + b
            if isinstance(node.op, ast.Sub):
                return a - b
            if isinstance(node.op, ast.Mult):
                if isinstance(a, int) and isinstance(b, int) and a.bit_length() + b.bit_length() > _MOST_BITS:
                    raise ValueError("too large")
                return a * b
            if isinstance(node.op, ast.Pow):
                if isinstance(a, int) and isinstance(b, int) and b > 0 and a.bit_length() * b > _MOST_BITS:
                    raise ValueError("too large")
                return a**b
        raise ValueError("not arithmetic")

    if len(text) > 400:
        raise ValueError("too long")
    return value(ast.parse(text.strip(" "), mode="eval").body)


_FRACTION = re.compile(r"\\frac\{([^}]+)\}\{([^}]+)\}")


def latex_to_plain(text: str) -> str:
    """An answer without LaTeX: the first fraction as a decimal, commands and braces gone, pi as
    3.14159, and simple products worked out."""
    text = text.replace("$", "")
    if m := _FRACTION.search(text):
        try:
            text = text.replace(m[0], str(float(m[1]) / float(m[2])))
        except (ValueError, ZeroDivisionError, OverflowError):
            pass
    for command in (r"\\[a-zA-Z]+", r"\\\(", r"\\\)", r"[{}]"):
        text = re.sub(command, "", text)
    text = re.sub(r"(\d+(?:\.\d+)?)\\?pi", r"\1*3.14159", text).replace("\\pi", "3.14159").replace("pi", "3.14159")
    if "*" in text and re.fullmatch(r"[0-9.*+\- ]*", text):
        try:
            result = arithmetic(text)
            if isinstance(result, (int, float)):
                text = str(result)
        except (ValueError, SyntaxError, ArithmeticError, RecursionError, MemoryError):
            pass
    return text.strip()


@F.pandas_udf(StringType())
def _latex(s: pd.Series) -> pd.Series:
    return s.map(latex_to_plain, na_action="ignore")


def bound(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)`` with the value worked out once, however often the body names it; the
    optimiser does not copy it into the places that name it, as it does with a column."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_latex(c: Column) -> Column:
    """``latex_to_plain``; only texts with a fraction, a product or pi reach Python."""

    def native(x: Column) -> Column:
        easy = F.regexp_replace(F.replace(x, F.lit("$"), F.lit("")), r"\\[a-zA-Z]+", "")
        easy = F.regexp_replace(easy, r"\\\(|\\\)", "")
        easy = F.regexp_replace(easy, r"[{}]", "")
        # What is left when a command goes can spell pi.
        hard = x.contains("\\frac") | x.contains("*") | x.contains("pi") | easy.contains("pi")
        return F.struct(F.when(~hard, strip(easy)).alias("easy"))

    split = bound(c, native)
    # The argument names the text itself: Spark cannot take a function of ``bound`` out to Python.
    return F.coalesce(split["easy"], _latex(F.when(c.rlike(r"(?s)\\frac|\*|p.*i"), c)))
