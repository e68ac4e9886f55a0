"""Chat templates, decoding and batched generation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import decode as D
from millrace.functions import templates as T
from millrace.plans import batches as B

CHATML = "{% for message in messages %}{{ '<|im_start|>' + message['role'] + '\\n' + message['content'] + '<|im_end|>' + '\\n' }}{% endfor %}{% if add_generation_prompt %}{{ '<|im_start|>assistant\\n' }}{% endif %}"
INSTRUCT = """{% if messages[0]['role'] == 'system' %}
    {% set system = messages[0].content %}
    {% set own = messages[1:] %}
{% else %}
    {% set system = '' %}
    {% set own = messages %}
{% endif %}
{{ bos_token }}
{%- for message in own %}
    {%- if (message['role'] == 'user') != (loop.index0 % 2 == 0) %}
        {{- raise_exception('turns must alternate') }}
    {%- endif %}
    {%- if message['role'] == 'user' %}
        {%- if loop.first and system %}
            {{- '[INST] ' ~ system ~ '\\n\\n' ~ message['content'] | trim ~ ' [/INST]' }}
        {%- else %}
            {{- '[INST] ' + message.content.strip() + ' [/INST]' }}
        {%- endif %}
    {%- else %}
        {{- ' ' + message['content'] + eos_token }}
    {%- endif %}
{%- endfor %}
{# the end #}
{%- if not own[-1]['role'] == 'user' and add_generation_prompt is defined %} next{% endif %}"""


def python_instruct(turns):
    system = turns[0][1] if turns[0][0] == "system" else ""
    own = turns[1:] if turns[0][0] == "system" else turns
    out = "<s>"
    for i, (role, text) in enumerate(own):
        if role == "user":
            out += f"[INST] {system}\n\n{text.strip()} [/INST]" if i == 0 and system else f"[INST] {text.strip()} [/INST]"
        else:
            out += f" {text}</s>"
    return out + (" next" if own[-1][0] != "user" else "")


@pytest.fixture(scope="module")
def chats(spark):
    talks = [
        [("user", "hi"), ("assistant", "hello ")],
        [("system", "be brief"), ("user", " a\nb "), ("assistant", "c"), ("user", "d")],
        [("system", ""), ("user", "'quoted' {{ x }} {% y %}")],
        [("user", "")],
    ]
    rows = [(c, t, r, x) for c, talk in enumerate(talks) for t, (r, x) in enumerate(talk)]
    return talks, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def test_templates(chats):
    talks, df = chats
    got = {r.conv_id: r.prompt for r in T.chat_template(df, ["conv_id"], CHATML, add_generation_prompt=True).collect()}
    assert got == {c: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in talk) + "<|im_start|>assistant\n" for c, talk in enumerate(talks)}
    got = T.chat_template(df, ["conv_id"], INSTRUCT, bos_token="<s>", eos_token="</s>", add_generation_prompt=True)
    assert {r.conv_id: r.prompt for r in got.collect()} == {c: python_instruct(talk) for c, talk in enumerate(talks)}
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_template_can_refuse(spark):
    df = spark.createDataFrame([(0, 0, "user", "a"), (0, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="turns must alternate"):
        T.chat_template(df, ["conv_id"], INSTRUCT, bos_token="<s>", eos_token="</s>").collect()


@pytest.mark.parametrize(
    ("template", "want"),
    [
        ("{% for m in messages %}{{ loop.index }}/{{ messages | length }}{% if not loop.last %}, {% endif %}{% endfor %}", "1/2, 2/2"),
        ("a\n  {% if true %}\n  b\n  {% endif %}\nc", "a\n  b\nc"),
        ("{{- messages[1]['content'] | trim | upper -}}  \n x", "Zx"),
        ("{% for m in messages if %}", None), ("{% macro x() %}{% endmacro %}", None), ("{{ m | tojson }}", None), ("{% if x %}", None), ("{{ messages[0].content.evil() }}", None), ("{{ 1 + }}", None),
        ("{{ 'in' if 'y' in messages[0].content else 'out' }}{{ x is defined }}{{ bos_token is defined }}", "inFalseTrue"),
        ("{% if messages[0].role in ['user', 'tool'] and messages[0].content %}yes{% elif true %}no{% endif %}", "yes"),
        ("{% if messages[0].role == 'x' or bos_token == 'B' %}{{ bos_token }}{% endif %}{% if nothing %}no{% endif %}", "B"),
        ("{{ messages[0].content.startswith('xy') and messages[1].content is not none }}", "true"),
        ("", ""),
    ],
)
def test_template_parts(spark, template, want):
    df = spark.createDataFrame([(0, 0, "user", "xy"), (0, 1, "assistant", " z ")], "conv_id long, turn long, role string, text string")
    if want is None:
        with pytest.raises(ValueError):
            T.chat_template(df, ["conv_id"], template)
    else:
        assert T.chat_template(df, ["conv_id"], template, bos_token="B").first().prompt == want


def test_null_contents_and_a_lone_prompt(spark):
    df = spark.createDataFrame([(0, 0, None, None), (0, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert T.chat_template(df, ["conv_id"], CHATML).first().prompt == "<|im_start|>\n<|im_end|>\n<|im_start|>user\nx<|im_end|>\n"
    assert spark.range(1).select(T.as_user(F.lit("q?"), CHATML)).first()[0] == "<|im_start|>user\nq?<|im_end|>\n<|im_start|>assistant\n"


def test_decoding_like_the_tokenizer(spark, sf_dir):
    P = pytest.importorskip("public_tokenizers")
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    vocabulary = D.byte_level(P.path("byte_bpe_50k.json"))
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    rng = np.random.default_rng(1)
    rows = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts] + [[int(i) for i in rng.integers(0, 50257, 30)] for _ in range(300)] + [[int(i) for i in rng.integers(94, 256, 12)] for _ in range(300)]
    rows += [[50256, 464, 50256, 3797], [], [50256]]
    df = spark.createDataFrame([(k, ids) for k, ids in enumerate(rows)], "k int, ids array<int>")
    got = df.select("k", D.decode(F.col("ids"), vocabulary).alias("plain"), D.decode(F.col("ids"), vocabulary, skip_special=False).alias("every"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        assert r.plain == tokenizer.decode(rows[r.k], skip_special_tokens=True)
        assert r.every == tokenizer.decode(rows[r.k], skip_special_tokens=False)
    assert [r.plain for r in got.orderBy("k").limit(len(texts)).collect()] == [t or "" for t in texts]
    odd = spark.createDataFrame([([1 << 30, 0, -5, None],), (None,)], "ids array<int>").select(D.decode(F.col("ids"), vocabulary).alias("t")).collect()
    assert [r.t for r in odd] == ["!", None]
    clean = spark.range(1).select(D.clean_up(F.lit("it 's , do n't ' we 've ! ok ?"))).first()[0]
    assert clean == "it's, don't'we've! ok?"


def test_batches_stay_within_their_area(spark):
    def model():
        def run(rows):
            longest = max(len(r["prompt"]) for r in rows)
            assert len(rows) == 1 or len(rows) * longest <= 64
            return [{"generated_token_ids": [1], "generated_text": f"{len(rows)}", "states": True} for _ in rows]

        return run

    rows = [("m", "d", "en", i, "x" * (1 + i * 7 % 100)) for i in range(300)]
    prompted = spark.createDataFrame(rows, "model string, dataset string, language string, sample_id long, prompt string").repartition(2)
    got = B.generate_batched(prompted, model, area=64, need_states=True).collect()
    assert sorted(r.sample_id for r in got) == list(range(300)) and not [r for r in got if r.error]
    assert max(int(r.generated_text) for r in got) > 4


def test_rows_that_fail_or_lack_states_are_errors(spark):
    def model():
        def run(rows):
            if any(r["sample_id"] == 3 for r in rows):
                raise RuntimeError("out of memory")
            return [{"generated_token_ids": [] if r["sample_id"] == 1 else [5, 6], "generated_text": "t", "states": r["sample_id"] != 2} for r in rows]

        return run

    prompted = spark.createDataFrame([("m", "d", "en", i, "p") for i in range(5)], "model string, dataset string, language string, sample_id long, prompt string").coalesce(1)
    got = {r.sample_id: (r.error, r.generated_text) for r in B.generate_batched(prompted, model, area=100, need_states=True).collect()}
    assert got == {0: (None, "t"), 1: (None, "t"), 2: (B.LACKING, None), 3: ("RuntimeError: out of memory", None), 4: (None, "t")}
    assert B.generate_batched(prompted.limit(0), model, area=10).count() == 0


def test_buckets():
    buckets = B.Buckets(32, lambda r: r["n"])
    out = [b for n in [3, 4, 30, 4, 3, 4, 4, 4, 4, 31, 100] if (b := buckets.add({"n": n}))]
    assert [[r["n"] for r in b] for b in out] == [[30]]
    assert [[r["n"] for r in b] for b in buckets.rest()] == [[100], [31], [3, 4, 4, 3, 4, 4, 4, 4]]
