"""Cases of extraction, normalisation and validation, and a comparison with a plain specification."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import answers as A
from millrace.functions import prompts as P
from millrace.functions import text as T


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).repartition(1).select(column).collect()]


CASES = [
    ("gsm8k", "en", None, "Steps\nAnswer: 1,234.", "1234"),
    ("gsm8k", "en", None, "Answer: 5\nmore 7", "7"),
    ("gsm8k", "en", None, "The answer is 42. Done", "42"),
    ("gsm8k", "en", None, "10-5", "-5"),
    ("gsm8k", "en", None, "no digits", ""),
    ("gsm8k", "en", None, None, ""),
    ("mgsm", "de", None, "x 1\nAntwort: 8", "8"),
    ("mgsm", "sw", None, "x\nJibu: 9. kisha 4", "4"),
    ("mgsm", "ja", None, "答え：１２。", "12"),
    ("math", "en", None, r"\boxed{\frac{1}{2}} then \boxed{3}", r"\frac{1}{2}"),
    ("math", "en", None, r"\boxed{{7}}", "7"),
    ("math", "en", None, r"\boxed{5\text{ cm}}", "5"),
    ("math", "en", None, r"\boxed{a{b{c}}}", ""),
    ("mmlu", "en", None, "Answer: because; answer : c", "C"),
    ("mmlu", "en", None, "Answer: (C)", ""),
    ("mmlu", "en", None, "Answer: E", ""),
    ("commonsenseqa", "en", None, "Answer: E", "E"),
    ("hotpotqa", "en", None, "Answer: Paris.", "Paris"),
    ("hotpotqa", "en", None, "Answer: Paris\nmore", ""),
    ("hotpotqa", "en", None, "Answer: St. Louis", "St"),
    ("theoremqa", "en", "bool", r"\boxed{unknown}", "False"),
    ("theoremqa", "en", "integer", "Therefore, the answer is $1,024$.", "1024"),
    ("theoremqa", "en", "float", r"\boxed{\frac{1}{4}}", "0.25"),
    ("theoremqa", "en", "float", r"\boxed{2pi}", "6.28318"),
    ("theoremqa", "en", "float", r"\boxed{2\pi}", "2"),
    ("theoremqa", "en", "list of integer", "the answer is [2, 3, 4].", "2, 3, 4"),
    ("theoremqa", "en", "option", "the answer is (b).", "B"),
    ("theoremqa", "en", None, "nothing 3.", "3"),
    ("new", "en", None, "the answer is 42. Done", "42. Done"),
    ("new", "en", None, "Answer: x y. z", "x y"),
]


def test_extract(spark):
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(CASES)], "i int, dataset string, language string, answer_type string, t string")
    found = A.extract(F.col("dataset"), A.normalize_text(F.col("t")), F.col("language"), F.col("answer_type"))
    got = dict(df.select("i", found).collect())
    assert {c[3]: got[i] for i, c in enumerate(CASES)} == {c[3]: c[4] for c in CASES}


def test_normalize_answer(spark):
    cases = {"[1,  2]": "[1, 2]", r"\dfrac{1}{2}": r"\frac{1}{2}", "1,000.50": "1000.5", "1.5e10": "1.5e1", r"\left( 1 \right)": "(1)", "0.500": "0.5", None: "", "": "", "[]x": "[]x"}
    assert values(spark, A.normalize_answer(F.col("a")), [(k,) for k in cases], "a string") == list(cases.values())


@pytest.mark.parametrize(
    ("dataset", "kind", "extracted", "truth", "right"),
    [
        ("gsm8k", None, "3.0000001", "3", True), ("gsm8k", None, "3.00001", "3", False), ("gsm8k", None, "1_0", "10", True), ("gsm8k", None, "1d", "1", False), ("gsm8k", None, "", "", False),
        ("hotpotqa", None, "in", "Berlin", True), ("hotpotqa", None, "incorrect", "correct", True), ("hotpotqa", None, "yes", "true", True), ("hotpotqa", None, ",", "Paris", True), ("hotpotqa", None, "", "Paris", False), ("hotpotqa", None, "London", "Paris", False),
        ("theoremqa", "list of integer", "2, 3, 4", "[2, 3, 4]", False), ("theoremqa", "option", "B", "(b)", False), ("theoremqa", "float", "0.25", "0.250000001", True), ("mmlu", None, "b", "B", True), ("math", None, "X", "x", True),
    ],
)
def test_validate(spark, dataset, kind, extracted, truth, right):
    c = A.validate(F.lit(dataset), F.lit(extracted), F.lit(truth), F.lit(kind).cast("string"))
    assert spark.range(1).select(c).first()[0] is right


def test_numeric_like_its_specification(spark):
    r = random.Random(3)
    parts = ["Answer:", "answer is", "the ", "\n", " ", "1", "23", ".", ",", "-", "4.5", "x", "Therefore, ", "\u00a0", "e3"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(1500)]
    number, payload = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?", r"(.+?)(?:(?<!\d)\.(?!\d)|$)"

    def last(s):
        found = re.findall(number, s.replace(",", ""))
        return found[-1].rstrip(".") if found else ""

    def spec(t):
        tries = [m[-1].strip() for m in [re.findall(rf"(?is)(?:^|\n)\s*Answer:\s*{payload}", t)] if m]
        tries += [m[1].strip() for m in [re.search(rf"(?is)answer\s+is\s*{payload}", t)] if m]
        return next((n for n in map(last, [*tries, t]) if n), "")

    got = values(spark, A.numeric(F.col("t")), [(t,) for t in texts], "t string")
    assert got == [spec(t) for t in texts]


def test_latex_and_arithmetic(spark):
    cases = [r"\frac{1}{0}", r"$\frac{3}{4}$", "2*3", "2**3", "9**9**9", "007*2", r"p\xi", r"3\cdot 4", "1.5*2", r"\(x\)", "pi", None]
    assert values(spark, T.clean_latex(F.col("t")), [(c,) for c in cases], "t string") == [None if c is None else T.latex_to_plain(c) for c in cases]
    assert T.latex_to_plain("2*3 - 1") == "5"
    assert T.latex_to_plain("9**9**9") == "9**9**9"
    with pytest.raises((ValueError, SyntaxError)):
        T.arithmetic("__import__('os')")


def test_stringify_and_half(spark):
    cases = {'"a b"': "a b", '"q\\"x"': 'q"x', "true": "True", "null": "None", "3.0": "3.0", "[1,2]": "[1, 2]", "1e3": "1000.0", "12": "12", "-0": "0", '{"a":null}': "{'a': None}"}
    assert values(spark, T.stringify_json(F.col("t")), [(c,) for c in cases], "t string") == list(cases.values())
    assert values(spark, T.half_round(F.col("v")), [([0.1, 70000.0],)], "v array<float>") == [[0.0999755859375, float("inf")]]


def test_prompts(spark):
    def prompt(dataset, question, kind=None, language="en"):
        return spark.range(1).select(P.render(F.lit(dataset), F.lit(question), F.lit(kind).cast("string"), F.lit(language))).first()[0]

    assert prompt("MATH", "q$1") == "Question: q$1\nPlease reason step by step, and put your final answer within \\boxed{{}}.\n"
    assert "Antwort:" in prompt("mgsm", "Answer: stays", language="de")
    assert prompt("mgsm", "Answer: stays", language="de").count("Answer:") == 1
    assert prompt("mgsm", "q", language="xx") == prompt("gsm8k", "q")
    assert "{answer_type}" in prompt("theoremqa", "q")
    assert "### Answer_type: bool" in prompt("theoremqa", "q", "bool")
    assert prompt("unknown", "just this") == "just this"
