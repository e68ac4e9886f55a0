"""Queries of the evaluation operators over the test tables, each with its SQL.

The tables hold no model output, so inputs are derived from their columns by one SQL
text that both engines run (``INPUTS``); the operators then run in Spark and, written
out as SQL, in the other engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import answers as A
from millrace.functions import metrics as M
from millrace.functions import prompts as P
from millrace.functions import text as T
from millrace.operators import report as R
from millrace.operators import states as H
from millrace.operators import upsert as U
from millrace.session import read_table
from millrace.sources import normalize as N
from millrace.sources.jsonl import parse_samples

NL, BS, LB, RB = "chr(10)", "chr(92)", "chr(123)", "chr(125)"
N_ = "CAST(o_custkey % 97 AS STRING)"
#: Derived inputs: SQL that both engines accept; a table stands in braces.
INPUTS = {
    "gen": f"""
SELECT o_orderkey AS sample_id, {N_} AS answer_gt,
  CASE o_orderkey % 10
    WHEN 0 THEN 'Steps 3 and 4.' || {NL} || 'Answer: ' || {N_} || '.'
    WHEN 1 THEN 'Therefore, the answer is ' || {N_} || '.5. Done'
    WHEN 2 THEN 'Answer: because; answer : ' || chr(CAST(65 + o_orderkey % 5 AS INT))
    WHEN 3 THEN 'so ' || {BS} || 'boxed' || {LB} || {LB} || {N_} || {RB} || {RB} || ' then ' || {BS} || 'boxed' || {LB} || '7' || {RB}
    WHEN 4 THEN 'values 1,234 and 10-' || {N_}
    WHEN 5 THEN 'nothing to see, ' || o_orderpriority
    WHEN 6 THEN 'x 1' || {NL} || 'Antwort: ' || {N_} || '. danach' || {NL} || 'Answer: 5'
    WHEN 7 THEN 'Answer: St. Louis' || {NL} || 'answer: ' || lower(o_orderpriority) || '. ok'
    WHEN 8 THEN 'the answer is ' || {BS} || 'boxed' || {LB} || '5' || {BS} || 'text' || {LB} || ' cm' || {RB} || {RB}
    ELSE 'Answer: 1,0' || {N_} || {NL} || 'more 12e3'
  END AS text
FROM {{orders}}""",
    "theorem": f"""
SELECT o_orderkey AS sample_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'bool' WHEN 1 THEN 'integer' WHEN 2 THEN 'list of integer' WHEN 3 THEN 'option' ELSE 'text' END AS answer_type,
  CASE CAST(floor(o_orderkey / 5) AS BIGINT) % 5
    WHEN 0 THEN 'Therefore, the answer is $[' || {N_} || ', 3, 4]$ (b).'
    WHEN 1 THEN {BS} || 'boxed' || {LB} || 'unknown ' || {N_} || {RB} || ' the answer is 4'
    WHEN 2 THEN 'so it is true that 12 and 1,0' || {N_}
    WHEN 3 THEN 'the answer is (C) or ' || {BS} || 'left yes, 2.50'
    ELSE 'The answer is 3.25 metres. Not 4'
  END AS text
FROM {{orders}}""",
    "latex": f"""
SELECT o_orderkey AS sample_id, CASE o_orderkey % 5
    WHEN 0 THEN {BS} || 'frac' || {LB} || {N_} || {RB} || {LB} || '4' || {RB} || '$'
    WHEN 1 THEN {N_} || '*2'
    WHEN 2 THEN '$' || {N_} || '*2.5' || {BS} || 'pi'
    WHEN 3 THEN {BS} || 'frac' || {LB} || '1' || {RB} || {LB} || '0' || {RB} || ' of ' || {N_}
    ELSE {BS} || 'frac' || {LB} || '1' || {RB} || {LB} || '4' || {RB} || ' ' || {N_} || '*2pi' END AS text
FROM {{orders}}""",
    "pairs": f"""
SELECT o_orderkey AS sample_id,
  CASE o_orderkey % 7 WHEN 0 THEN {N_} || '.50' WHEN 1 THEN '1,0' || {N_} WHEN 2 THEN '[' || {N_} || ',  2]' WHEN 3 THEN {BS} || 'dfrac' || {LB} || '1' || {RB} || {LB} || '2' || {RB}
    WHEN 4 THEN 'Yes' WHEN 5 THEN '' ELSE {BS} || 'left( ' || {N_} || ' ' || {BS} || 'right)' END AS a,
  CASE CAST(floor(o_orderkey / 7) AS BIGINT) % 6 WHEN 0 THEN {N_} || '.5' WHEN 1 THEN '10' || {N_} || '.0000001' WHEN 2 THEN '[' || {N_} || ', 2]' WHEN 3 THEN {BS} || 'frac' || {LB} || '1' || {RB} || {LB} || '2' || {RB}
    WHEN 4 THEN 'correct' ELSE '(' || {N_} || ')' END AS b
FROM {{orders}}""",
    "items": f"""
SELECT line_idx, CASE line_idx % 6
    WHEN 0 THEN '{{{{"question": "' || q || '", "answer": "' || CAST(line_idx AS STRING) || '"}}}}'
    WHEN 1 THEN '{{{{"answer": "7"}}}}'
    WHEN 2 THEN '{{{{"question": "' || q || '", "answer": null}}}}'
    WHEN 3 THEN '{{{{"en": "' || q || '", "answer": ' || CAST(line_idx AS STRING) || '}}}}'
    WHEN 4 THEN '{{{{"question": "' || q || '", "answer": ""}}}}'
    ELSE '{{{{"de": "' || q || '", "question": "x", "answer": true, "answer_type": "bool"}}}}' END AS raw
FROM (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS line_idx, regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g') AS q FROM {{conversations}} WHERE role = 'user')""",
    "solutions": f"""
SELECT doc_id, CASE doc_id % 4
    WHEN 0 THEN {BS} || 'boxed' || {LB} || '1' || {RB} || ' and ' || {BS} || 'boxed' || {LB} || '$' || CAST(n_chars AS STRING) || '$' || {RB}
    WHEN 1 THEN 'The answer is 3. The answer is ' || CAST(n_chars AS STRING) || '. ok'
    WHEN 2 THEN 'steps ' || CAST(doc_id AS STRING) || ' #### x #### 1,' || CAST(n_chars AS STRING)
    ELSE 'plain' END AS solution
FROM {{documents}}""",
    "steps": """
SELECT CAST(floor(vec_id / 10) AS BIGINT) AS sample_id, CAST(vec_id % 10 AS BIGINT) AS step, embedding AS logits, CAST((vec_id * 11) % 70 AS BIGINT) AS token
FROM {embeddings}""",
    "runs": """
SELECT CASE WHEN d.doc_id % 50 = 7 THEN NULL ELSE d.doc_id END AS sample_idx, CASE WHEN d.doc_id % 50 = 7 THEN CAST(d.doc_id AS STRING) ELSE d.source END AS model,
  CASE WHEN d.doc_id % 40 = 3 THEN NULL ELSE d.lang END AS dataset, l.doc_id IS NOT NULL AS processed, l.doc_id IS NULL AS error, coalesce(l.quality = 1, false) AS correct
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "status": """
SELECT d.doc_id AS sample_idx, l.doc_id IS NOT NULL AS valid, CASE WHEN l.doc_id IS NOT NULL THEN CAST(d.doc_id % 5 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS n
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
}
_REGEX_G = re.compile(r", 'g'\)")


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input, in Spark."""
    sql = INPUTS[name]
    tables = {t: read_table(spark, sf_dir, t) for t in set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql))}
    return spark.sql(_REGEX_G.sub(")", sql), **tables)


def given(name: str) -> str:
    """A derived input, as a parenthesised query for the other engine."""
    sql = re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", INPUTS[name]).replace("{{", "{").replace("}}", "}")
    return f"({sql})"


# The other engine has no look-behind: stops that touch a digit are hidden while a pattern runs.
D_NUMBER = r"[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
D_PAYLOAD = r"(.+?)(?:\.|\n?$)"
D_ANSWER_IS = rf"(?is)(?:Therefore,?\s*)?(?:the\s+)?answer\s+is\s*{D_PAYLOAD}"
D_BOXED = r"(?s)\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"


def d_hide(e: str) -> str:
    return rf"regexp_replace(regexp_replace({e}, '([0-9])\.', '\1' || chr(31), 'g'), '\.([0-9])', chr(31) || '\1', 'g')"


def d_last(e: str, pattern: str, group: int = 1) -> str:
    return f"coalesce(regexp_extract_all({e}, '{pattern}', {group})[-1], '')"


def d_first(e: str, pattern: str, group: int = 1) -> str:
    return f"coalesce(regexp_extract_all({e}, '{pattern}', {group})[1], '')"


def d_strip(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def d_last_number(e: str) -> str:
    return f"rtrim({d_last(f'replace({e}, chr(44), chr(32)[2:])', D_NUMBER, 0)}, '.')"


def d_shown(e: str) -> str:
    return f"replace({e}, chr(31), '.')"


def d_or(*options: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({o}, '')" for o in options) + ", '')"


def d_numeric(e: str, prefix: str | None = None) -> str:
    def after(p: str) -> str:
        return d_last_number(d_strip(d_shown(d_last(d_hide(e), rf"(?is)(?:^|\n)\s*{p}:\s*{D_PAYLOAD}"))))

    tiers = [after(prefix)] if prefix else []
    return d_or(*tiers, after("Answer"), d_last_number(d_strip(d_shown(d_first(d_hide(e), D_ANSWER_IS)))), d_last_number(e))


def d_boxed(e: str) -> str:
    inner = d_strip(d_first(e, D_BOXED))
    peeled = rf"CASE WHEN {inner} LIKE '{{%}}' THEN {d_strip(f'regexp_replace({inner}, chr(94) || chr(92) || chr(123) || chr(124) || chr(92) || chr(125) || chr(36), chr(32)[2:], chr(103))')} ELSE {inner} END"
    return rf"regexp_replace({peeled}, '\\text\{{[^}}]*\}}', '', 'g')"


def d_choice(e: str, n: int) -> str:
    return f"upper({d_last(e, rf'(?i)Answer\s*:\s*([A-{chr(64 + n)}])')})"


def d_hotpot(e: str) -> str:
    a, b = (rf"regexp_extract_all({e}, '(?i){p}\s*(.+?)(?:\.|\n?$)', 1)" for p in ("Answer:", "answer is"))
    return f"rtrim({d_strip(f'CASE WHEN len({a}) > 0 THEN {a}[-1] ELSE coalesce({b}[-1], chr(32)[2:]) END')}, '.')"


def d_generic(e: str) -> str:
    found = f"regexp_extract_all({d_hide(e)}, '{D_ANSWER_IS}', 1)"
    plain = d_first(e, r"(?i)Answer:\s*(.+?)(?:\.|\n?$)")
    return d_strip(f"CASE WHEN len({found}) > 0 THEN {d_shown(f'{found}[1]')} ELSE {plain} END")


def d_latex(e: str) -> str:
    return d_strip(rf"regexp_replace(regexp_replace(replace({e}, '$', ''), '\\[a-zA-Z]+', '', 'g'), '\\\(|\\\)|[{{}}]', '', 'g')")


def d_theorem(e: str) -> str:
    candidate = d_or(d_strip(d_first(e, D_BOXED)), d_strip(d_shown(d_first(d_hide(e), D_ANSWER_IS))))
    # Columns of the enclosing query: candidate, clean.
    return f"""SELECT sample_id, answer_type, CASE WHEN candidate = '' THEN {d_last_number('text')}
  WHEN answer_type = 'bool' THEN CASE WHEN lower(clean) LIKE '%true%' OR lower(clean) LIKE '%yes%' THEN 'True' WHEN lower(clean) LIKE '%false%' OR lower(clean) LIKE '%no%' THEN 'False' ELSE '' END
  WHEN answer_type = 'integer' THEN {d_last_number('clean')}
  WHEN answer_type = 'list of integer' THEN {d_strip(d_first('clean', r'\[([^\]]+)\]'))}
  WHEN answer_type = 'option' THEN upper({d_first('clean', r'(?i)\(([a-d])\)')})
  ELSE clean END AS answer
FROM (SELECT *, {d_latex('candidate')} AS clean FROM (SELECT *, {candidate} AS candidate FROM {given('theorem')}))"""


def d_normalize(e: str) -> str:
    plain = rf"replace(replace(regexp_replace(replace({e}, '\dfrac', '\frac'), '\\(left|right)([(\[\])])', '\2', 'g'), ' ', ''), ',', '')"
    items = d_first(e, r"\[([^\]]+)\]")
    return rf"CASE WHEN contains({e}, '[') AND contains({e}, ']') AND {items} <> '' THEN '[' || {d_strip(rf'regexp_replace({items}, chr(92) || chr(115) || chr(43), chr(32), chr(103))')} || ']' WHEN contains({plain}, '.') THEN rtrim(rtrim({plain}, '0'), '.') ELSE {plain} END"


def d_same_number(a: str, b: str) -> str:
    ok = r"'[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?'"
    return f"coalesce(CASE WHEN regexp_full_match({a}, {ok}) AND regexp_full_match({b}, {ok}) THEN abs(try_cast({a} AS DOUBLE) - try_cast({b} AS DOUBLE)) < 1e-6 END, false)"


def d_same_phrase(a: str, b: str) -> str:
    yes, no = ("(" + ", ".join(f"'{w}'" for w in ws) + ")" for ws in (A.YES, A.NO))
    return f"({a} = {b} OR contains({a}, {b}) OR contains({b}, {a}) OR ({a} IN {yes} AND {b} IN {yes}) OR ({a} IN {no} AND {b} IN {no}))"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def over(name: str, table: str, sql: str, **columns: Callable[[], object]) -> None:
    """A query that projects a derived input: a Spark column and the SQL of each."""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = source(spark, sf_dir, table)
        return df.select(df.columns[0], *(make().alias(k) for k, make in columns.items()))


# Answers.
text = lambda: F.col("text")
g = given("gen")
over("extract_numeric", "gen", f"SELECT sample_id, {d_numeric('text')} AS answer FROM {g}", answer=lambda: A.numeric(text()))
over("extract_numeric_localized", "gen", f"SELECT sample_id, {d_numeric('text', 'Antwort')} AS answer FROM {g}", answer=lambda: A.numeric(text(), F.lit("de")))
over("extract_boxed", "gen", f"SELECT sample_id, {d_boxed('text')} AS answer FROM {g}", answer=lambda: A.boxed(text()))
over("extract_mc4", "gen", f"SELECT sample_id, {d_choice('text', 4)} AS answer FROM {g}", answer=lambda: A.choice(text(), 4))
over("extract_mc5", "gen", f"SELECT sample_id, {d_choice('text', 5)} AS answer FROM {g}", answer=lambda: A.choice(text(), 5))
over("extract_hotpot", "gen", f"SELECT sample_id, {d_hotpot('text')} AS answer FROM {g}", answer=lambda: A.hotpot(text()))
over("extract_generic", "gen", f"SELECT sample_id, {d_generic('text')} AS answer FROM {g}", answer=lambda: A.generic(text()))
over("extract_last_number", "gen", f"SELECT sample_id, {d_last_number('text')} AS answer FROM {g}", answer=lambda: A.last_number(text()))
over("extract_theorem", "theorem", d_theorem("text"), answer_type=lambda: F.col("answer_type"), answer=lambda: A.theorem(text(), F.col("answer_type")))
over("clean_latex_native", "theorem", f"SELECT sample_id, {d_latex('text')} AS plain FROM {given('theorem')}", plain=lambda: T.clean_latex(text()))
_latex_sql = f"""
SELECT o_orderkey AS sample_id, CASE o_orderkey % 5
    WHEN 0 THEN CAST(CAST(o_custkey % 97 AS DOUBLE) / 4 AS VARCHAR)
    WHEN 1 THEN CAST(o_custkey % 97 * 2 AS VARCHAR)
    WHEN 2 THEN CAST(CAST(o_custkey % 97 AS DOUBLE) * CAST(2.5 AS DOUBLE) AS VARCHAR)
    WHEN 3 THEN '10 of ' || CAST(o_custkey % 97 AS VARCHAR)
    ELSE '0.25 ' || CAST(o_custkey % 97 AS VARCHAR) || '*2*3.14159' END AS plain
FROM orders"""
over("clean_latex_arith", "latex", _latex_sql, plain=lambda: T.clean_latex(text()))
over("normalize_text_nfkc", "gen", f"SELECT sample_id, text || ':1.5 A' AS plain FROM {g}", plain=lambda: A.normalize_text(F.concat(text(), F.lit("：１．５ Ａ"))))
over("normalize_answer", "pairs", f"SELECT sample_id, {d_normalize('a')} AS plain FROM {given('pairs')}", plain=lambda: A.normalize_answer(F.col("a")))
_norm = f"(SELECT sample_id, {d_normalize('a')} AS a, {d_normalize('b')} AS b FROM {given('pairs')})"
over("validate_numeric", "pairs", f"SELECT sample_id, {d_same_number('a', 'b')} AS same FROM {_norm}", same=lambda: A.same_number(A.normalize_answer(F.col("a")), A.normalize_answer(F.col("b"))))
over("validate_hotpot", "pairs", f"SELECT sample_id, {d_same_phrase('lower(a)', 'lower(b)')} AS same FROM {_norm}", same=lambda: A.same_phrase(A.normalize_answer(F.col("a")), A.normalize_answer(F.col("b"))))
_NAMES = ["gsm8k", "mgsm", "math", "mmlu", "belebele", "commonsenseqa", "hotpotqa", "other"]
_label_sql = f"""
SELECT sample_id, dataset, answer AS extracted_answer, CASE WHEN answer = '' THEN false WHEN dataset = 'hotpotqa' THEN {d_same_phrase('lower(e)', 'lower(g)')}
  ELSE (dataset IN ('gsm8k', 'mgsm', 'math') AND {d_same_number('e', 'g')}) OR lower(e) = lower(g) END AS correct
FROM (SELECT *, {d_normalize('answer')} AS e, {d_normalize('answer_gt')} AS g FROM (
  SELECT sample_id, answer_gt, dataset, CASE dataset WHEN 'gsm8k' THEN {d_numeric('text')} WHEN 'mgsm' THEN {d_numeric('text')} WHEN 'math' THEN {d_boxed('text')} WHEN 'mmlu' THEN {d_choice('text', 4)}
    WHEN 'belebele' THEN {d_choice('text', 4)} WHEN 'commonsenseqa' THEN {d_choice('text', 5)} WHEN 'hotpotqa' THEN {d_hotpot('text')} ELSE {d_generic('text')} END AS answer
  FROM (SELECT *, [{', '.join(map(lit, _NAMES))}][CAST(CAST(floor(sample_id / 10) AS BIGINT) % 8 + 1 AS INT)] AS dataset FROM {g})))"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source(spark, sf_dir, "gen").withColumn("dataset", F.get(F.array(*map(F.lit, _NAMES)), (F.floor(F.col("sample_id") / 10) % 8).cast("int")))
    df = df.withColumns({"language": F.lit("en"), "answer_type": F.lit(None).cast("string")})
    return A.add_labels(df, "text").select("sample_id", "dataset", "extracted_answer", "correct")


query("label_all", _label_sql)(_labelled)


@query("accuracy_by_dataset", f"SELECT dataset, count(*) AS n_samples, count(*) AS n_processed, count(*) FILTER (WHERE correct) AS n_correct, CAST(0 AS BIGINT) AS n_errors, round(count(*) FILTER (WHERE correct) / count(*), 6) AS accuracy FROM ({_label_sql}) GROUP BY dataset")
def accuracy_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).withColumns({"processed": F.lit(True), "error": F.lit(False)})
    return R.accuracy(rows, ["dataset"]).withColumn("accuracy", F.round("accuracy", 6))


# Prompts.
for _name in [*P.TEMPLATES, "unlisted"]:
    _t = P.TEMPLATES.get(_name, "{question}")
    over(
        f"prompt_{_name}", "gen",
        f"SELECT sample_id, replace(replace({lit(_t)}, '{{question}}', text), '{{answer_type}}', CASE WHEN sample_id % 2 = 0 THEN 'integer' ELSE '{{answer_type}}' END) AS prompt FROM {g}",
        prompt=lambda n=_name: P.render(F.lit(n), text(), F.when(F.col("sample_id") % 2 == 0, "integer"), F.lit("en")),
    )
_langs = list(A.ANSWER_PREFIXES)
over(
    "prompt_mgsm_localized", "gen",
    f"SELECT sample_id, language, replace(replace({lit(P.TEMPLATES['mgsm'])}, 'Answer:', [{', '.join(lit(A.ANSWER_PREFIXES[x]) for x in _langs)}][CAST(sample_id % 11 + 1 AS INT)] || ':'), '{{question}}', text) AS prompt "
    f"FROM (SELECT *, [{', '.join(map(lit, _langs))}][CAST(sample_id % 11 + 1 AS INT)] AS language FROM {g})",
    language=lambda: F.get(F.array(*map(F.lit, _langs)), (F.col("sample_id") % 11).cast("int")),
    prompt=lambda: P.render(F.lit("mgsm"), text(), F.lit(None).cast("string"), F.get(F.array(*map(F.lit, _langs)), (F.col("sample_id") % 11).cast("int"))),
)

# Loading and normalising.
_parsed = f"""SELECT line_idx AS sample_id, row_number() OVER (ORDER BY line_idx) - 1 AS sample_idx, question, answer_gt, answer_type FROM (
  SELECT line_idx, line_idx % 6 AS k, raw, json_extract_string(raw, '$.answer_type') AS answer_type,
    CASE WHEN json_exists(raw, '$.{{lang}}') THEN json_extract_string(raw, '$.{{lang}}') WHEN json_exists(raw, '$.question') THEN json_extract_string(raw, '$.question') ELSE json_extract_string(raw, '$.en') END AS question,
    CASE line_idx % 6 WHEN 2 THEN 'None' WHEN 5 THEN 'True' ELSE json_extract_string(raw, '$.answer') END AS answer_gt
  FROM {given('items')} WHERE {{head}}) WHERE k <> 1 AND answer_gt <> ''"""
_samples = ["sample_id", "sample_idx", "question", "answer_gt", "answer_type"]


@query("load_samples", _parsed.replace("{lang}", "en").replace("{head}", "true"))
def load_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_samples(source(spark, sf_dir, "items"), "mgsm").select(*_samples)


@query("load_samples_head", _parsed.replace("{lang}", "en").replace("{head}", "line_idx < 40"))
def load_samples_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_samples(source(spark, sf_dir, "items"), "mgsm", max_samples=40).select(*_samples)


@query("question_fallback", _parsed.replace("{lang}", "de").replace("{head}", "true"))
def question_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_samples(source(spark, sf_dir, "items"), "mgsm", "de").select(*_samples)


over("stringify_json", "items", f"SELECT line_idx, CASE line_idx % 5 WHEN 0 THEN 'True' WHEN 1 THEN '[1, 2]' WHEN 2 THEN '3.0' WHEN 3 THEN 'None' ELSE CAST(line_idx AS VARCHAR) END AS value FROM {given('items')}", value=lambda: T.stringify_json(F.when(F.col("line_idx") % 5 == 0, "true").when(F.col("line_idx") % 5 == 1, "[1,2]").when(F.col("line_idx") % 5 == 2, "3.0").when(F.col("line_idx") % 5 == 3, "null").otherwise(F.col("line_idx").cast("string"))))
over("gsm8k_split", "solutions", f"SELECT doc_id, {d_strip(chr(115) + 'tring_split(solution, ' + lit('####') + ')[-1]')} AS answer, {d_strip('string_split(solution, ' + lit('####') + ')[1]')} AS full_solution FROM {given('solutions')}", answer=lambda: N.gsm8k_answer(F.col("solution"))[0], full_solution=lambda: N.gsm8k_answer(F.col("solution"))[1])
over("math_solution_answer", "solutions", f"SELECT doc_id, CASE WHEN len(regexp_extract_all(solution, '{D_BOXED}', 1)) > 0 THEN replace({d_strip(d_last('solution', D_BOXED))}, '$', '') WHEN contains(solution, 'The answer is') THEN {d_strip('string_split(string_split(string_split(solution, ' + lit('The answer is') + ')[-1], ' + lit('.') + ')[1], chr(10))[1]')} ELSE '' END AS answer FROM {given('solutions')}", answer=lambda: N.math_answer(F.col("solution")))

_words = "string_split(text, ' ')[1:4]"


@query("mc_options", f"SELECT item_id, 'Q?' || chr(10) || chr(10) || 'Choices:' || chr(10) || array_to_string(list_transform(range(1, len({_words}) + 1), lambda i: chr(CAST(64 + i AS INT)) || '. ' || {_words}[i]), chr(10)) AS question FROM benchmark")
def mc_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select("item_id", N.with_choices(F.lit("Q?"), N.option_lines(None, F.slice(F.split("text", " "), 1, 4))).alias("question"))


@query("csqa_options", "SELECT item_id, 'Q?' || chr(10) || chr(10) || 'Choices:' || chr(10) || 'x. ' || string_split(text, ' ')[1] || chr(10) || 'y. ' || string_split(text, ' ')[2] AS question, CAST(2 AS INT) AS num_choices FROM benchmark")
def csqa_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "benchmark").select("item_id", F.col("item_id").alias("idx"), F.lit("Q?").alias("question"), F.lit("x").alias("answerKey"), F.struct(F.array(F.lit("x"), F.lit("y")).alias("label"), F.split("text", " ").alias("text")).alias("choices"))
    return N.normalize_commonsenseqa(rows).select(F.col("id").alias("item_id"), "question", "num_choices")


@query("hotpot_context", "SELECT item_id, 'Q?' || chr(10) || chr(10) || 'Context:' || chr(10) || array_to_string(list_transform(string_split(text, ' ')[1:5], lambda w: w || ': a ' || w), chr(10) || chr(10)) AS question FROM benchmark")
def hotpot_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("text", " ")
    return read_table(spark, sf_dir, "benchmark").select("item_id", N.hotpot_question(F.lit("Q?"), words, F.transform(words, lambda w: F.array(F.lit("a"), w))).alias("question"))


@query("belebele_letter", "SELECT doc_id, CASE WHEN doc_id % 7 BETWEEN 1 AND 4 THEN chr(CAST(64 + doc_id % 7 AS INT)) ELSE '' END AS answer, 'Passage:' || chr(10) || source || chr(10) || chr(10) || 'Question: ' || lang || chr(10) || chr(10) || 'Choices:' || chr(10) || '(A) ' || source || chr(10) || '(C) ' || lang AS en FROM documents")
def belebele_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 7
    rows = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.when(k < 5, k.cast("string")).otherwise("x").alias("correct_answer_num"), F.col("source").alias("flores_passage"), F.col("lang").alias("question"), F.col("source").alias("mc_answer1"), F.col("lang").alias("mc_answer3"))
    return N.normalize_belebele(rows).select(F.col("id").alias("doc_id"), "answer", "en")


@query("mmlu_letter", "SELECT doc_id, chr(CAST(65 + doc_id % 4 AS INT)) AS answer, lang AS subject FROM documents")
def mmlu_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.lit("q").alias("question"), F.array(F.lit("a")).alias("choices"), (F.col("doc_id") % 4).alias("answer"), F.col("lang").alias("subject"))
    return N.normalize_mmlu(rows).select(F.col("id").alias("doc_id"), "answer", "subject")


@query("mgsm_items", "SELECT o_orderkey AS id, 'mgsm' AS dataset, 'math_word_problem' AS type, o_orderpriority AS question, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS answer, 'en' AS language FROM orders")
def mgsm_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.normalize_mgsm(read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("question"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("answer_number")))


@query("theoremqa_items", "SELECT o_orderkey AS id, 'theoremqa' AS dataset, 'theorem_application' AS type, o_orderpriority AS question, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS VARCHAR) END, 'None') AS answer, '' AS answer_type, o_orderstatus AS theorem FROM orders")
def theoremqa_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.normalize_theoremqa(read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("Question"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("Answer"), F.col("o_orderstatus").alias("Theorem")))


@query("math_items_capped", "SELECT id, type FROM (SELECT lang || '_' || CAST(doc_id AS VARCHAR) AS id, lang AS type, row_number() OVER (ORDER BY CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, doc_id) AS r FROM documents WHERE lang IN ('de', 'en', 'fr')) WHERE r <= 300")
def math_items_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("idx"), F.col("lang").alias("config"), F.col("source").alias("problem"), F.lit("").alias("solution"))
    return N.normalize_math(N.cap_in_order(rows, ["de", "en", "fr"], 300)).select("id", "type")


# Metrics.
_s = f"(SELECT sample_id, step, token, unnest(logits) AS x, generate_subscripts(logits, 1) - 1 AS i FROM {given('steps')})"
_steps_sql = f"""(SELECT sample_id, step, max(p) AS top, -sum(p * log2(greatest(p, 1e-12))) AS bits, ln(greatest(coalesce(max(p) FILTER (WHERE i = token), 0), 1e-12)) AS l
FROM (SELECT *, exp(CAST(x AS DOUBLE) - m) / sum(exp(CAST(x AS DOUBLE) - m)) OVER (PARTITION BY sample_id, step) AS p FROM (SELECT *, max(CAST(x AS DOUBLE)) OVER (PARTITION BY sample_id, step) AS m FROM {_s})) GROUP BY sample_id, step)"""


@query("softmax_metrics", f"SELECT sample_id, round(avg(top), 6) AS max_probability, round(avg(bits), 6) AS entropy FROM {_steps_sql} GROUP BY sample_id")
def softmax_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.generation_metrics(source(spark, sf_dir, "steps"), ["sample_id"])
    return m.select("sample_id", F.round("max_probability", 6).alias("max_probability"), F.round("entropy", 6).alias("entropy"))


@query("perplexity", f"SELECT sample_id, round(exp(-avg(l)), 4) AS perplexity FROM {_steps_sql} GROUP BY sample_id")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.generation_metrics(source(spark, sf_dir, "steps"), ["sample_id"]).select("sample_id", F.round("perplexity", 4).alias("perplexity"))


@query("finish_reason", "SELECT vec_id, CASE WHEN n = 0 THEN 'empty' WHEN last IN (2, 99) THEN 'eos' WHEN n >= 3 THEN 'length' ELSE 'other' END AS finish_reason FROM (SELECT vec_id, vec_id % 4 AS n, CASE WHEN vec_id % 5 = 0 THEN 2 ELSE 7 END AS last FROM embeddings)")
def finish_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, last = (F.col("vec_id") % 4).cast("int"), F.when(F.col("vec_id") % 5 == 0, 2).otherwise(7)
    tokens = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.concat(F.array_repeat(F.lit(5), n - 1), F.array(last)))
    ends = M.terminator_set(F.lit(2), F.lit(99), F.lit(2))
    return read_table(spark, sf_dir, "embeddings").select("vec_id", M.finish_reason(tokens, ends, F.lit(3)).alias("finish_reason"))


@query("sequence_split", "SELECT vec_id, CAST(64 - vec_id % 60 AS INT) AS generated_length, coalesce(nullif(round(CAST(embedding[CAST(vec_id % 60 + 1 AS INT)] AS DOUBLE), 6), 0), 0) AS first_generated FROM embeddings")
def sequence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.split_sequence(F.col("embedding"), (F.col("vec_id") % 60).cast("int"))
    return read_table(spark, sf_dir, "embeddings").withColumn("s", s).select("vec_id", F.col("s.generated_length").alias("generated_length"), F.round(F.get("s.generated_tokens", F.lit(0)).cast("double"), 6).alias("first_generated"))


@query("chat_fallback", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def chat_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.chat_text(read_table(spark, sf_dir, "conversations"), ["conv_id"])


# Hidden states: component i of a vector is layer i div 16, dimension i mod 16.
_states = "(SELECT CAST(floor(vec_id / 10) AS BIGINT) AS sample_idx, CAST(vec_id % 10 AS INT) AS token_idx, CAST(floor(i / 16) AS INT) AS layer, CAST(i % 16 AS INT) AS dim, x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"


def _layers(c: str = "embedding"):  # noqa: ANN202
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice(F.col(c), k * 16 + 1, 16).cast("array<float>"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_layer = read_table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("long").alias("sample_idx"), (F.col("vec_id") % 10).cast("int").alias("token_idx"), F.posexplode(_layers()).alias("layer", "vec"))
    return by_layer


@query("mean_states", f"SELECT sample_idx, layer, dim, coalesce(nullif(round(CAST(CAST(avg(CAST(x AS DOUBLE)) AS FLOAT) AS DOUBLE), 5), 0), 0) AS value FROM {_states} GROUP BY ALL")
def mean_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = H.mean_states(_tokens(spark, sf_dir))
    return means.select("sample_idx", "layer", F.posexplode("vec").alias("dim", "v")).select("sample_idx", "layer", "dim", F.round(F.col("v").cast("double"), 5).alias("value"))


@query("token_states_long", f"SELECT sample_idx, token_idx, layer, count(*) AS dims FROM {_states} GROUP BY ALL")
def token_states_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    steps = e.groupBy(F.floor(F.col("vec_id") / 10).cast("long").alias("sample_idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", _layers().alias("l")))), lambda s: s["l"]).alias("step_states"))
    return H.token_states(steps).select("sample_idx", "token_idx", "layer", F.size("vec").cast("long").alias("dims"))


_ulp = "power(2, greatest(floor(log2(abs(CAST(x AS DOUBLE)))), -14) - 10)"
_half_sql = f"""
SELECT sample_idx, token_idx, layer, dim, CASE WHEN x = 0 THEN 0 ELSE round_even(CAST(x AS DOUBLE) / {_ulp}, 0) * {_ulp} END + 0 AS value
FROM {_states}"""


@query("half_round", _half_sql)
def half_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _tokens(spark, sf_dir).select("sample_idx", "token_idx", "layer", F.posexplode(T.half_round("vec")).alias("dim", "value"))
    return each.withColumn("value", F.col("value").cast("double") + 0)


@query("pad_layers", f"SELECT s.sample_idx, CAST(l.layer AS INT) AS layer, coalesce(nullif(round(coalesce(sum(CAST(x AS DOUBLE)), 0), 4), 0), 0) AS total FROM (SELECT DISTINCT sample_idx FROM {_states}) s CROSS JOIN (SELECT unnest(range(0, 6)) AS layer) l LEFT JOIN (SELECT * FROM {_states} WHERE token_idx = 0) t ON t.sample_idx = s.sample_idx AND t.layer = l.layer GROUP BY ALL")
def pad_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _tokens(spark, sf_dir).where("token_idx = 0").select("sample_idx", "layer", "vec")
    out = H.pad_layers(first, first.select("sample_idx").distinct(), 6, 16)
    return out.select("sample_idx", "layer", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("prompt_last_states", "SELECT vec_id AS sample_idx, CAST(layer AS INT) AS layer, coalesce(nullif(round(CAST(embedding[CAST(layer * 16 + 16 AS INT)] AS DOUBLE), 5), 0), 0) AS value FROM embeddings, (SELECT unnest(range(0, 4)) AS layer)")
def prompt_last_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = F.transform(_layers(), lambda v: F.transform(v, lambda x: F.array(x)))
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_idx"), positions.alias("prompt_states"))
    return H.prompt_last_states(rows, 4, 1).select("sample_idx", "layer", F.round(F.get("vec", F.lit(0)).cast("double"), 5).alias("value"))


@query("layer_probe", "SELECT n_name AS model_name, CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 1 ELSE coalesce(nullif(n_regionkey, 0), 0) + 1 END AS INT) AS n_layers FROM nation")
def layer_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    seen = nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("model_name"), F.explode(F.sequence(F.lit(0), F.col("n_nationkey").cast("int"))).alias("layer"))
    return H.layer_probe(seen, nation.select(F.col("n_name").alias("model_name"), F.nullif("n_regionkey", F.lit(0)).alias("n_layers")))


@query("model_metadata", "SELECT n_name AS model_name, CAST(coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END, n_regionkey) AS INT) AS n_layers, CAST(n_regionkey * 16 AS INT) AS hidden_dim, CAST(0 AS INT) AS vocab_size, 'unknown' AS model_type FROM nation")
def model_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation")
    return H.model_metadata(n.select(F.col("n_name").alias("model_name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).alias("num_hidden_layers"), F.col("n_regionkey").alias("n_layer"), (F.col("n_regionkey") * 16).alias("d_model")))


# Storage, resume and reports.
@query("upsert_keep_last", "SELECT user_id AS sample_id, event_type AS dataset, value AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 3 <> 0 DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id"), F.col("event_type").alias("dataset"), F.col("value").alias("score"), F.col("event_id").alias("seq"))
    return U.keep_last(e.where("seq % 3 = 0"), e.where("seq % 3 <> 0"), ["sample_id", "dataset"], "seq").select("sample_id", "dataset", "score")


_st = given("status")


@query("csr_pointers", f"SELECT sample_idx, CAST(coalesce(sum(n) OVER (ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr FROM {_st} UNION ALL SELECT max(sample_idx) + 1, CAST(sum(n) AS BIGINT) FROM {_st}")
def csr_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = source(spark, sf_dir, "status")
    return U.csr_pointers(s, s.select("sample_idx", "n"))


@query("resume_index", f"SELECT CAST(coalesce(min(CASE WHEN NOT valid THEN sample_idx END), count(*)) AS BIGINT) AS resume_index FROM {_st}")
def resume_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.resume_index(source(spark, sf_dir, "status"))


@query("resume_remaining", f"SELECT sample_idx, valid FROM {_st} WHERE sample_idx >= (SELECT coalesce(min(CASE WHEN NOT valid THEN sample_idx END), count(*)) FROM {_st})")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = source(spark, sf_dir, "status")
    return U.remaining(s, s).select("sample_idx", "valid")


_r = given("runs")
_stats = f"SELECT model, dataset, count(*) AS n_samples, count(*) FILTER (WHERE processed) AS n_processed, count(*) FILTER (WHERE correct) AS n_correct, count(*) FILTER (WHERE error) AS n_errors, round(coalesce(count(*) FILTER (WHERE correct) / nullif(count(*) FILTER (WHERE processed), 0), 0), 6) AS accuracy FROM {_r} GROUP BY model, dataset"


@query("accuracy_by_model_dataset", _stats)
def accuracy_by_model_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.accuracy(source(spark, sf_dir, "runs"), ["model", "dataset"]).withColumn("accuracy", F.round("accuracy", 6))


@query("accuracy_total", f"SELECT CAST(sum(n_samples) AS BIGINT) AS n_samples, CAST(sum(n_correct) AS BIGINT) AS n_correct, round(sum(n_correct) / sum(n_samples), 6) AS accuracy FROM ({_stats})")
def accuracy_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.total_accuracy(R.accuracy(source(spark, sf_dir, "runs"), ["model", "dataset"])).withColumn("accuracy", F.round("accuracy", 6))


@query("running_accuracy", f"SELECT model, dataset, sample_idx, round(avg(CAST(correct AS DOUBLE)) OVER (PARTITION BY model, dataset ORDER BY sample_idx NULLS FIRST ROWS UNBOUNDED PRECEDING) * 100, 4) AS running_accuracy FROM {_r} WHERE processed")
def running_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source(spark, sf_dir, "runs").where("processed")
    return R.running_accuracy(rows, ["model", "dataset"]).select("model", "dataset", "sample_idx", F.round("running_accuracy", 4).alias("running_accuracy"))


@query("line_counts", "SELECT source AS file_name, count(*) AS n FROM documents GROUP BY ROLLUP (source)")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.line_counts(read_table(spark, sf_dir, "documents").select(F.col("source").alias("file_name")))
