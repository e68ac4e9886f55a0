"""Metrics, hidden states, storage, reports, the command line and the stream."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import metrics as M
from millrace.operators import report as R
from millrace.operators import states as H
from millrace.operators import upsert as U
from millrace.plans import cli
from millrace.plans.process import generate, isolated
from millrace.schemas import GENERATIONS, TOKEN_STATES
from millrace.streaming.upserts import upsert_stream


def test_metrics(spark):
    steps = spark.createDataFrame([(1, [0.0, 0.0], 1), (2, [0.0, 0.0], 5), (3, [0.0, 0.0], None), (4, [1000.0, 0.0], 0)], "sample_id long, logits array<float>, token int")
    samples = spark.createDataFrame([(i,) for i in range(1, 6)], "sample_id long")
    got = {r.sample_id: (r.max_probability, r.perplexity, r.entropy) for r in M.with_defaults(M.generation_metrics(steps, ["sample_id"]), samples, ["sample_id"]).collect()}
    assert got[1] == pytest.approx((0.5, 2, 1))
    assert got[2] == pytest.approx((0.5, 1e12, 1))
    assert got[3] == (0.5, math.inf, 1.0)
    assert got[4] == pytest.approx((1, 1, 0))
    assert got[5] == (0.0, math.inf, 0.0)


def test_finish_reason_and_split(spark):
    rows = spark.createDataFrame([([],), ([1, 2],), ([1, 3],), ([1],), ([1, 1, 2],)], "t array<int>")
    assert [r[0] for r in rows.select(M.finish_reason(F.col("t"), F.array(F.lit(2)), F.lit(2))).collect()] == ["empty", "eos", "length", "other", "eos"]
    one = spark.range(1)
    assert one.select(M.terminator_set(F.lit(2), F.lit(None).cast("int"), F.lit(7), F.lit(2))).first()[0] == [2, 7]
    assert one.select(M.split_sequence(F.array(*map(F.lit, range(5))), F.lit(3))).first()[0].asDict() == {"generated_length": 2, "generated_tokens": [3, 4]}


def test_states(spark):
    steps = spark.createDataFrame([(0, [[[1.0, 2.0], [0.1, 4.0]], [[3.0, 4.0], [0.3, 0.0]]]), (1, [])], "sample_idx long, step_states array<array<array<float>>>")
    tokens = H.token_states(steps)
    assert tokens.count() == 4
    assert tokens.where("token_idx = 0 and layer = 1").first().vec[0] == 0.0999755859375
    mean = H.pad_layers(H.mean_states(tokens), steps, 3, 2)
    got = {(r.sample_idx, r.layer): r.vec for r in mean.collect()}
    assert got[0, 0] == [2.0, 3.0]
    assert got[0, 2] == got[1, 0] == [0.0, 0.0]
    assert len(got) == 6
    prompts = spark.createDataFrame([(0, [[[9.0], [1.0]], [[2.0]], [[3.0]]])], "sample_idx long, prompt_states array<array<array<float>>>")
    assert sorted((r.layer, r.vec) for r in H.prompt_last_states(prompts, 2, 1).collect()) == [(0, [1.0]), (1, [2.0])]
    assert spark.range(1).select(H.zeros(2, 3)).first()[0] == [[0.0] * 3] * 2


def test_pointers_and_resume(spark):
    status = spark.createDataFrame([(0, True), (1, False), (2, True)], "sample_idx long, valid boolean")
    counts = spark.createDataFrame([(0, 2), (2, 3)], "sample_idx long, n long")
    for block in (1, 2, 65536):
        assert [r.ptr for r in U.csr_pointers(status, counts, block=block).orderBy("sample_idx").collect()] == [0, 2, 2, 5]
    assert U.resume_index(status).first()[0] == 1
    assert U.resume_index(status.where("valid")).first()[0] == 2
    assert [r.sample_idx for r in U.remaining(status, status).orderBy("sample_idx").collect()] == [1, 2]
    assert U.csr_pointers(status.limit(0), counts.limit(0)).collect()[0].ptr == 0


def test_upsert(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["sample_id"]
    batch = lambda *rows: spark.createDataFrame(rows, "sample_id long, v string, seq int")
    read = lambda: [(r.sample_id, r.v) for r in U.stored(spark, path).orderBy("sample_id").collect()]
    U.upsert(batch((1, "a", 0), (2, "b", 1)), path, keys)
    second = batch((2, "c", 0), (0, "d", 1), (0, "e", 2))
    U.upsert(second, path, keys)
    assert read() == [(0, "e"), (1, "a"), (2, "c")]
    U.upsert(second, path, keys)
    U.upsert(second.limit(0), path, keys)
    assert read() == [(0, "e"), (1, "a"), (2, "c")]
    U.upsert(spark.createDataFrame([(3, 5)], "sample_id long, extra int"), path, keys)
    assert len(read()) == 4


def test_store(spark, tmp_path):
    store = U.StateStore(spark, str(tmp_path / "s"))
    assert store.states("mean_states").count() == 0
    store.save(spark.createDataFrame([(0, 7, True)], "sample_idx long, sample_id long, valid boolean"), mean_states=spark.createDataFrame([(0, 0, [1.0])], "sample_idx long, layer int, vec array<float>"))
    assert [tuple(r) for r in store.states("mean_states").collect()] == [(0, 0, [1.0])]
    with pytest.raises(ValueError, match="other"):
        store.save(spark.range(0), other=spark.range(1))


def test_report(spark):
    rows = spark.createDataFrame([("m", "d", i, i < 4, i == 4, i < 2) for i in range(5)], "model string, dataset string, sample_idx int, processed boolean, error boolean, correct boolean")
    stats = R.accuracy(rows, ["model", "dataset"])
    assert stats.first().accuracy == 0.5
    assert R.report(stats, "r1")["models"]["m"]["datasets"]["d"] == {"n_samples": 5, "n_processed": 4, "n_correct": 2, "n_errors": 1, "accuracy": 0.5}
    assert R.total_accuracy(stats).first().accuracy == pytest.approx(0.4)
    assert R.accuracy(rows.where("error"), ["model"]).first().accuracy == 0.0
    assert [r.running_accuracy for r in R.running_accuracy(rows.where("processed"), ["model", "dataset"]).orderBy("sample_idx").collect()] == pytest.approx([100, 100, 200 / 3, 50])


def test_store_keeps_the_last_attempt(spark, tmp_path):
    store = U.StateStore(spark, str(tmp_path / "s"))
    samples = spark.createDataFrame([(i, 10 + i) for i in range(3)], "sample_idx long, sample_id long")
    status = lambda *rows: spark.createDataFrame(rows, "sample_idx long, sample_id long, valid boolean, error string")
    tokens = lambda *rows: spark.createDataFrame([(i, t, layer, [v]) for i, t, layer, v in rows], TOKEN_STATES)
    assert [r.sample_idx for r in store.remaining(samples).orderBy("sample_idx").collect()] == [0, 1, 2]
    store.save(status((0, 10, True, None), (1, 11, False, "out of memory")), token_states=tokens((0, 0, 0, 1.0), (0, 1, 0, 2.0), (1, 0, 0, 9.0)))
    assert [r.sample_idx for r in store.remaining(samples).orderBy("sample_idx").collect()] == [1, 2]
    store.save(status((1, 11, True, None), (2, 12, True, None)), token_states=tokens((1, 0, 0, 3.0), (1, 0, 1, 4.0)))
    assert store.remaining(samples).count() == 0
    assert sorted((r.sample_idx, r.vec[0]) for r in store.states("token_states").collect()) == [(0, 1.0), (0, 2.0), (1, 3.0), (1, 4.0)]
    assert [r.ptr for r in store.finalize().orderBy("sample_idx").collect()] == [0, 2, 3, 3]


def test_compacting_a_store_keeps_what_counts(spark, tmp_path):
    store = U.StateStore(spark, str(tmp_path / "s"))
    store.compact()
    status = lambda *rows: spark.createDataFrame(rows, "sample_idx long, sample_id long, valid boolean")
    for k in range(3):
        rows = [(i, t, 0, [float(10 * k + i)]) for i in range(6) for t in range(3)]
        store.save(status(*((i, i, i != k) for i in range(6) if i != 5 or k == 0)), token_states=spark.createDataFrame(rows, TOKEN_STATES))
    before = sorted(map(tuple, store.states("token_states").collect()))
    assert {r[0] for r in before} == {0, 1, 3, 4, 5} and store.table("token_states").read().count() == 18
    store.compact()
    assert sorted(map(tuple, store.states("token_states").collect())) == before
    assert store.table("token_states").read().count() == 5 and store.table("sample_status").read().count() == 6
    assert sorted(r.sample_idx for r in store.status().where("not valid").collect()) == [2]
    store.table("token_states").vacuum()
    assert sorted(map(tuple, store.states("token_states").collect())) == before


def test_the_last_generation_of_a_sample_counts(spark, tmp_path):
    (tmp_path / "models" / "m").mkdir(parents=True)
    (tmp_path / "gsm8k.jsonl").write_text('{"question": "1+1?", "answer": "2"}\n{"question": "2+2?", "answer": "4"}\n')
    rows = [("m", "gsm8k", "en", i, 3, [5, 2], f"Answer: {k}", [2], 8, None) for k in (9, 2, 4) for i in (0, 1)]
    spark.createDataFrame(rows, GENERATIONS).coalesce(1).write.parquet(str(tmp_path / "g"))
    argv = ["--data-root", str(tmp_path), "--generations", str(tmp_path / "g"), "--output-dir", str(tmp_path / "out"), "--model-root", str(tmp_path / "models"), "--models", "m", "--datasets", "gsm8k"]
    got = cli.main(argv)
    assert got["models"]["m"]["datasets"]["gsm8k"] == {"n_samples": 2, "n_processed": 2, "n_correct": 1, "n_errors": 0, "accuracy": 0.5}
    out = U.stored(spark, f"{tmp_path}/out/{got['run_id']}/outputs/gsm8k").collect()
    assert {r.sample_id: r.extracted_answer for r in out} == {0: "4", 1: "4"}


def test_rows_that_fail_alone(spark):
    def one(row):
        if row["sample_id"] == 1:
            raise RuntimeError("out of memory")
        return {"prompt_length": len(row["prompt"]), "generated_token_ids": [1, 2], "generated_text": "Answer: 2", "terminators": [2], "max_new_tokens": 8}

    prompted = spark.createDataFrame([("m", "gsm8k", "en", i, "1+1?") for i in range(3)], "model string, dataset string, language string, sample_id long, prompt string")
    got = {r.sample_id: (r.error, r.generated_text) for r in generate(prompted, isolated(one)).collect()}
    assert got == {0: (None, "Answer: 2"), 1: ("RuntimeError: out of memory", None), 2: (None, "Answer: 2")}


def test_later_rows_of_a_batch_win(spark, tmp_path):
    U.upsert(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (1, "d")], "sample_id long, v string").coalesce(1), str(tmp_path / "t"), ["sample_id"])
    assert sorted(map(tuple, U.stored(spark, str(tmp_path / "t")).collect())) == [(1, "d"), (2, "c")]


def test_running_accuracy_in_blocks(spark):
    rows = spark.createDataFrame([("m", i, None if i == 3 else i % 3 == 0) for i in range(10)], "model string, sample_idx int, correct boolean")
    whole, parts = ([r.running_accuracy for r in R.running_accuracy(rows, ["model"], block=b).orderBy("sample_idx").collect()] for b in (65536, 2))
    assert whole == parts
    assert whole[4] == pytest.approx(25.0)


def test_command_line(spark, tmp_path):
    (tmp_path / "models" / "m").mkdir(parents=True)
    (tmp_path / "gsm8k.jsonl").write_text('{"question": "1+1?", "answer": "2"}\n{"question": "2+2?", "answer": "4"}\n{"question": "3+3?", "answer": "6"}\n')
    key = ("m", "gsm8k", "en")
    rows = [(*key, 0, 3, [5, 2], "Answer: 2", [2], 8, None), (*key, 1, 3, [5], "Answer: 5", [2], 8, None), (*key, 2, 3, None, None, [2], 8, "out of memory")]
    again = [(*key, 0, 3, [5, 2], "Answer: 99", [2], 8, None), rows[1], (*key, 2, 3, [7], "Answer: 6", [2], 8, None)]
    names = "model string, dataset string, language string, sample_id long"
    for name, data in (("g", rows), ("g2", again), ("all", [*rows[:2], again[2]])):
        spark.createDataFrame(data, GENERATIONS).write.parquet(str(tmp_path / name))
    spark.createDataFrame([(*key, i, s, [0.0, 0.0], 0) for i in range(3) for s in range(2)], f"{names}, step int, logits array<float>, token int").write.parquet(str(tmp_path / "steps"))
    spark.createDataFrame([(*key, i, [[[1.0 * i, 2.0]], [[3.0, 4.0]]], [[[5.0, 6.0]]]) for i in range(3)], f"{names}, step_states array<array<array<float>>>, prompt_states array<array<array<float>>>").write.parquet(str(tmp_path / "states"))
    argv = lambda g, out: ["--data-root", str(tmp_path), "--generations", str(tmp_path / g), "--steps", str(tmp_path / "steps"), "--states", str(tmp_path / "states"), "--output-dir", str(tmp_path / out), "--model-root", str(tmp_path / "models"), "--models", "m", "--datasets", "gsm8k"]
    got = cli.main(argv("g", "out"))
    assert got["models"]["m"]["datasets"]["gsm8k"] == {"n_samples": 3, "n_processed": 2, "n_correct": 1, "n_errors": 1, "accuracy": 0.5}
    # The resumed run starts at the failed sample: what is stored stays, the error goes.
    resumed = cli.main([*argv("g2", "out"), "--resume", "--run-id", got["run_id"]])
    assert resumed["run_id"] == got["run_id"]
    assert resumed["models"]["m"]["datasets"]["gsm8k"] == {"n_samples": 3, "n_processed": 3, "n_correct": 2, "n_errors": 0, "accuracy": 2 / 3}
    whole = cli.main(argv("all", "out2"))
    assert whole["models"] == resumed["models"]
    run = {o: str(tmp_path / o / r["run_id"]) for o, r in (("out", got), ("out2", whole))}
    for table in ("metadata/gsm8k", "outputs/gsm8k"):
        a, b = (sorted(map(str, U.stored(spark, f"{run[o]}/{table}").collect())) for o in ("out", "out2"))
        assert a == b
    assert [tuple(r) for r in U.stored(spark, f"{run['out']}/outputs/gsm8k").select("max_probability", "perplexity", "entropy").distinct().collect()] == [(0.5, 2.0, 1.0)]
    states = [U.StateStore(spark, f"{run[o]}/states/m/gsm8k") for o in ("out", "out2")]
    for name in U.StateStore.TABLES:
        a, b = (sorted(map(str, s.states(name).collect())) for s in states)
        assert a == b
        assert a
    assert [r.ptr for r in states[0].pointers().orderBy("sample_idx").collect()] == [0, 2, 4, 6]
    assert "gsm8k" in R.summary(whole)
    with pytest.raises(ValueError, match="no run to resume"):
        cli.main([*argv("g", "out"), "--resume", "--run-id", "none"])
    for flag, name in (("--models", "n"), ("--datasets", "nothing")):
        with pytest.raises(ValueError, match="unknown"):
            cli.main([*argv("g", "out"), flag, name])


def test_stream(spark, tmp_path):
    schema = "sample_id long, v string, seq int"
    source, target, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    for rows in ([(1, "a", 0)], [(1, "b", 0), (2, "c", 0)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        q = upsert_stream(spark, source, schema, target, marks, ["sample_id"])
        q.awaitTermination(120)
    assert sorted((r.sample_id, r.v) for r in U.stored(spark, target).collect()) == [(1, "b"), (2, "c")]
