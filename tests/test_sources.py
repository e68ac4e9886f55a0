import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import jsonl as J
from millrace.sources import normalize as N


def test_line_index_over_many_splits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(f"line {i} " + "x" * 50 for i in range(3000)) + "\n")
    (tmp_path / "b.jsonl").write_text("only\n")
    (tmp_path / "c.txt").write_text("not read\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = J.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = {r.line_idx: r.raw for r in rows if r.file_name == "a.jsonl"}
    assert len(rows) == 3001
    assert all(a[i].startswith(f"line {i} ") for i in range(3000))


def test_load_samples(spark, tmp_path):
    items = [{"question": "q0", "answer": 1}, {"answer": "2"}, {"question": "q2", "answer": None}, {"en": "q3", "answer": "4", "answer_type": "bool"}, {"question": "q4", "answer": ""}, {"fr": None, "question": "q5", "answer": [1, 2]}]
    (tmp_path / "d.jsonl").write_text("".join(json.dumps(i) + "\n" for i in items))
    rows = J.load_samples(spark, str(tmp_path), "d").orderBy("sample_id").collect()
    assert [(r.sample_id, r.sample_idx, r.question, r.answer_gt, r.answer_type) for r in rows] == [(0, 0, "q0", "1", None), (2, 1, "q2", "None", None), (3, 2, "q3", "4", "bool"), (5, 3, "q5", "[1, 2]", None)]
    assert [r.sample_id for r in J.load_samples(spark, str(tmp_path), "d", max_samples=2).collect()] == [0]
    fr = {r.sample_id: (r.question, r.language) for r in J.load_samples(spark, str(tmp_path), "d", "fr").collect()}
    assert fr[5] == (None, "fr")
    assert fr[0] == ("q0", "fr")
    with pytest.raises(ValueError, match="no dataset file"):
        J.load_samples(spark, str(tmp_path), "missing")


def test_normalisers(spark):
    one = lambda df: df.collect()[0].asDict()
    row = lambda schema, *v: spark.createDataFrame([v], "idx int, " + schema)
    got = one(N.normalize_gsm8k(row("question string, answer string", 0, "q", "a b #### 1,234")))
    assert (got["answer"], got["full_solution"], got["type"]) == ("1,234", "a b", "math_word_problem")
    assert one(N.normalize_mgsm(row("question string, answer_number int", 1, "q", None)))["answer"] == ""
    assert one(N.normalize_math(row("problem string, solution string", 2, "p", r"\boxed{1} .. \boxed{$2$}"))) | {} == {"id": 2, "dataset": "math", "type": "unknown", "question": "p", "answer": "2", "level": "", "solution": r"\boxed{1} .. \boxed{$2$}"}
    assert one(N.normalize_math(row("config string, problem string, solution string", 2, "alg", "p", "The answer is 7. ok"))) | {} == {"id": "alg_2", "dataset": "math", "type": "alg", "question": "p", "answer": "7", "level": "", "solution": "The answer is 7. ok"}
    got = one(N.normalize_commonsenseqa(row("question string, choices struct<label:array<string>,text:array<string>>, answerKey string", 0, "q", (["A", "B"], ["x", "y", "z"]), "B")))
    assert (got["question"], got["answer"], got["num_choices"]) == ("q\n\nChoices:\nA. x\nB. y", "B", 2)
    got = one(N.normalize_hotpotqa(row("question string, answer string, context struct<title:array<string>,sentences:array<array<string>>>", 0, "q", "a", ([f"t{i}" for i in range(7)], [["s", "u"]] * 7))))
    assert got["question"] == "q\n\nContext:\n" + "\n\n".join(f"t{i}: s u" for i in range(5))
    assert got["level"] == "medium"
    got = one(N.normalize_theoremqa(row("Question string, Answer string, Answer_type string", 0, "q", "3", "integer")))
    assert (got["answer"], got["answer_type"], "theorem" in got) == ("3", "integer", False)
    for n, letter in (("3", "C"), ("0", ""), ("x", ""), ("-2", "")):
        got = one(N.normalize_belebele(row("question string, flores_passage string, mc_answer1 string, correct_answer_num string", 0, "q", "p", "one", n)))
        assert (got["answer"], got["en"]) == (letter, "Passage:\np\n\nQuestion: q\n\nChoices:\n(A) one")
    assert one(N.normalize_mmlu(row("question string, choices array<string>, answer int", 0, "q", ["x", "y"], 1)))["answer"] == "B"
    assert set(N.NORMALIZERS) == {"mgsm", "gsm8k", "math", "commonsenseqa", "hotpotqa", "theoremqa", "belebele", "mmlu"}


def test_caps_and_fallback(spark):
    rows = spark.createDataFrame([(i, c) for c in ("b", "a", "z") for i in range(4)], "idx int, config string")
    assert sorted((r.config, r.idx) for r in N.cap_in_order(rows, ["b", "a"], 6).collect()) == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("b", 2), ("b", 3)]
    assert N.head(rows, 2).count() == 6
    assert N.head(rows, None).count() == 12

    def broken():
        raise OSError

    assert N.first_with_rows(broken, lambda: rows.limit(0), lambda: rows).count() == 12
    assert N.first_with_rows(broken) is None


def test_write_jsonl(spark, tmp_path):
    out = str(tmp_path / "x")
    J.write_jsonl(spark.createDataFrame([(1, None), (2, "b")], "id int, theorem string"), out)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ['{"id":1}', '{"id":2,"theorem":"b"}']
    J.write_jsonl(spark.range(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    assert F is not None


def test_prepare_and_load(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"q{i}", f"so #### {i}") for i in range(30)], "idx int, question string, answer string").repartition(3)

    def broken():
        raise OSError("no such source")

    got = N.prepare({"gsm8k": [broken, lambda: rows], "mmlu": [broken], "mgsm": [lambda: rows]}, str(tmp_path), ["gsm8k", "mmlu", "mgsm"], most=20)
    assert got == {"gsm8k": 20, "mmlu": None, "mgsm": None}
    assert J.list_files(spark, str(tmp_path)) == ["gsm8k.jsonl"]
    samples = J.load_samples(spark, str(tmp_path), "gsm8k").orderBy("sample_id").collect()
    assert [(s.sample_id, s.question, s.answer_gt) for s in samples] == [(i, f"q{i}", str(i)) for i in range(20)]


def test_digits_of_any_script(spark):
    from millrace.functions import answers as A

    df = spark.createDataFrame([("\u0661\u0662.5", "12.5"), ("\uff11\uff12", "12"), ("\U0001d7db", "3"), ("\u0661x", "1")], "a string, b string")
    assert [r[0] for r in df.select(A.same_number(F.col("a"), F.col("b"))).collect()] == [True, True, True, False]
