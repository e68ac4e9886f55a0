"""Versioned tables, packed tensors and vector sums."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.text import half_round
from millrace.operators import files, tensors
from millrace.operators import report as R
from millrace.operators import states as H
from millrace.operators import store as S
from millrace.operators import upsert as U
from millrace.operators import vectors as V

ROW = "sample_id long, v string, seq int"


def table(spark, tmp_path, **how):
    return S.VersionedTable(spark, str(tmp_path / "t"), ["sample_id"], **{"rows_per_file": 100} | how)


def batch(spark, rows):
    return spark.createDataFrame([(i, v, k) for k, (i, v) in enumerate(rows)], ROW)


def held(t, **how):
    return {r.sample_id: r.v for r in t.read(**how).collect()}


def test_an_upsert_rewrites_the_files_that_it_touches(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(batch(spark, [(i, "a") for i in range(1000)]), ["sample_id"])
    first = {f["name"]: f for f in t.manifest()["files"]}
    assert len(first) >= 8 and sum(f["rows"] for f in first.values()) == 1000
    t.upsert(batch(spark, [(5, "b"), (6, "c"), (5, "d")]), ["sample_id"])
    second = {f["name"] for f in t.manifest()["files"]}
    assert len(set(first) - second) == 1  # one file holds the keys 5 and 6
    assert held(t) == {i: "a" for i in range(1000)} | {5: "d", 6: "c"}
    t.upsert(batch(spark, [(3, "e"), (990, "f"), (2000, "g")]), ["sample_id"])
    third = {f["name"] for f in t.manifest()["files"]}
    assert len(second - third) <= 3
    assert held(t) == {i: "a" for i in range(1000)} | {3: "e", 5: "d", 6: "c", 990: "f", 2000: "g"}
    ranges = sorted((f["lo"][0], f["hi"][0]) for f in t.manifest()["files"])
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_rows_beyond_a_full_last_file_leave_it_alone(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(batch(spark, [(i, "a") for i in range(95)]), ["sample_id"])
    before = {f["name"] for f in t.manifest()["files"]}
    t.upsert(batch(spark, [(i, "b") for i in range(100, 110)]), ["sample_id"])
    assert before < {f["name"] for f in t.manifest()["files"]}


@pytest.mark.parametrize("step", ["_written", "_commit"])
def test_a_crash_leaves_the_version_before(spark, tmp_path, monkeypatch, step):
    t = table(spark, tmp_path)
    t.upsert(batch(spark, [(1, "a"), (2, "b")]), ["sample_id"])
    real = getattr(S.VersionedTable, step)

    def dies(self, *args):
        if step == "_written":
            real(self, *args)  # the files are there, nothing names them
        raise RuntimeError("killed")

    monkeypatch.setattr(S.VersionedTable, step, dies)
    with pytest.raises(RuntimeError, match="killed"):
        t.upsert(batch(spark, [(1, "c")]), ["sample_id"])
    monkeypatch.undo()
    assert held(t) == {1: "a", 2: "b"} and t.version() == 0
    assert len(t.vacuum()) == 1
    t.upsert(batch(spark, [(1, "c")]), ["sample_id"])
    assert held(t) == {1: "c", 2: "b"} and held(t, version=0) == {1: "a", 2: "b"}


def test_the_last_of_a_key_that_only_the_old_batch_has(spark):
    rows = lambda *r: spark.createDataFrame(r, ROW).coalesce(1)
    got = S.keep_last(rows((1, "a", 9), (1, "b", 3), (2, "c", 8), (2, "d", 6)), rows((2, "e", 1), (2, "f", 0)), ["sample_id"], "seq")
    assert got.columns == ["sample_id", "v"]
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "e")]


def test_a_manifest_that_is_half_written_is_not_seen(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(batch(spark, [(1, "a")]), ["sample_id"])
    files.write_text(spark, f"{t.path}/manifest/deadbeef.tmp", '{"version": 1, "sch')
    assert held(t) == {1: "a"}


def test_two_writers(spark, tmp_path, monkeypatch):
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    t.upsert(batch(spark, [(1, "a")]), ["sample_id"])
    real = S.VersionedTable._written

    def slow(self, *args):
        monkeypatch.undo()
        other.upsert(batch(spark, [(2, "b")]), ["sample_id"])
        return real(self, *args)

    monkeypatch.setattr(S.VersionedTable, "_written", slow)
    with pytest.raises(S.ConcurrentChangeError):
        t.upsert(batch(spark, [(3, "c")]), ["sample_id"])
    assert held(t) == {1: "a", 2: "b"}


def test_a_range_opens_its_files(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(batch(spark, [(i, "a") for i in range(1000)]), ["sample_id"])
    part = t.read(lo=150, hi=180)
    assert sorted(r.sample_id for r in part.collect()) == list(range(150, 181))
    assert 1 <= len(part.inputFiles()) <= 2 < len(t.read().inputFiles())
    assert t.read(lo=5000).count() == 0


def test_removal_new_columns_and_null_keys(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read() is None
    t.upsert(batch(spark, [(1, "a"), (None, "n"), (2, "b")]), ["sample_id"])
    t.remove(spark.createDataFrame([(2,), (7,)], "sample_id long"))
    assert held(t) == {1: "a", None: "n"}
    t.upsert(spark.createDataFrame([(9, 4)], "sample_id long, extra int"), ["sample_id"])
    t.upsert(spark.createDataFrame([(None, "m")], "sample_id long, v string"), ["sample_id"])
    assert sorted(map(tuple, t.read().collect()), key=repr) == [(1, "a", None), (9, None, 4), (None, "m", None)]
    t.remove(t.read().select("sample_id"))
    assert [r.sample_id for r in t.read().collect()] == [None]  # a null equals nothing
    u = S.VersionedTable(spark, str(tmp_path / "u"), ["sample_id"])
    u.remove(spark.createDataFrame([(2,)], "sample_id long"))
    u.upsert(batch(spark, [(1, "a"), (2, "b")]), ["sample_id"])
    u.remove(u.read().select("sample_id"))
    assert u.read().columns == ["sample_id", "v"] and u.read().count() == 0 and u.stats().count() == 0
    u.upsert(batch(spark, [(3, "c")]), ["sample_id"])
    assert held(u) == {3: "c"}


def test_statistics_follow_random_upserts(spark, tmp_path):
    t = S.VersionedTable(spark, str(tmp_path / "t"), ["model", "sample_id"], ["model", "dataset"], {"n": "count(*)", "right": "count_if(correct)"}, rows_per_file=40)
    rng, want = random.Random(1), {}
    for _ in range(6):
        rows = [(rng.choice("ab"), rng.choice("xy"), rng.randrange(120), rng.random() < 0.5) for _ in range(rng.choice([5, 60]))]
        t.upsert(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "model string, dataset string, sample_id long, correct boolean, seq int"), ["model", "dataset", "sample_id"])
        want |= {r[:3]: r[3] for r in rows}
        gone = [k for k in want if rng.random() < 0.1]
        t.remove(spark.createDataFrame(gone, "model string, dataset string, sample_id long"))
        want = {k: v for k, v in want.items() if k not in gone}
        full = {}
        for (m, d, _), right in want.items():
            n, c = full.get((m, d), (0, 0))
            full[m, d] = (n + 1, c + right)
        assert {(r.model, r.dataset): (r.n, r.right) for r in t.stats().collect()} == full
        assert {(r.model, r.dataset, r.sample_id): r.correct for r in t.read().collect()} == want


def test_packed_states_come_back_bit_by_bit(spark, tmp_path):
    rng = np.random.default_rng(2)
    cubes = {i: (rng.normal(size=(n, 3, 5)) * 10.0 ** rng.integers(-9, 6)).astype(np.float32) for i, n in enumerate([1, 7, 40, 2])}
    cubes[1][0, 0, :4] = [70000, -70000, 1e-8, -0.0]
    rows = [(i, t, layer, [float(x) for x in c[t, layer]]) for i, c in cubes.items() for t in range(len(c)) for layer in range(3)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, tensors.ROWS).repartition(3)
    for dtype, kind in tensors.DTYPES.items():
        chunks = tensors.pack(df, dtype, chunk_bytes=200).collect()
        assert max(len(c.data) for c in chunks) <= max(200, 15 * kind.itemsize)
        with np.errstate(over="ignore"):
            for i, c in cubes.items():
                assert tensors.cube([x for x in chunks if x.sample_idx == i]).tobytes() == c.astype(kind).tobytes()
    store = U.StateStore(spark, str(tmp_path / "s"))
    status = spark.createDataFrame([(i, i, True) for i in cubes] + [(4, 4, True)], "sample_idx long, sample_id long, valid boolean")
    store.save(status, token_states=df)
    with np.errstate(over="ignore"):
        assert all(store.sample("token_states", i).tobytes() == c.astype(np.float16).tobytes() for i, c in cubes.items())
        want = sorted((i, t, layer, tuple(c[t, layer].astype(np.float16).astype(float))) for i, c in cubes.items() for t in range(len(c)) for layer in range(3))
    assert sorted((r.sample_idx, r.token_idx, r.layer, tuple(r.vec)) for r in store.states("token_states").collect()) == want
    assert store.sample("token_states", 4).size == 0
    assert [r.ptr for r in store.finalize().orderBy("sample_idx").collect()] == [0, 1, 8, 48, 50, 50]


def test_a_range_of_samples_opens_its_chunks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    store = U.StateStore(spark, str(tmp_path / "s"))
    rows = spark.range(200).select(F.col("id").alias("sample_idx"), F.lit(0).alias("layer"), F.array(F.col("id").cast("float")).alias("vec"))
    store.save(spark.range(200).select(F.col("id").alias("sample_idx"), F.col("id").alias("sample_id"), F.lit(True).alias("valid")), mean_states=rows)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    some, every = store.table("mean_states").read(0, 9), store.table("mean_states").read()
    assert len(some.inputFiles()) < len(every.inputFiles())
    assert sorted((r.sample_idx, r.vec[0]) for r in store.states("mean_states", 3, 5).collect()) == [(3, 3.0), (4, 4.0), (5, 5.0)]


def test_pointers_read_no_numbers(spark, tmp_path):
    store = U.StateStore(spark, str(tmp_path / "s"))
    store.save(spark.createDataFrame([(0, 0, True)], "sample_idx long, sample_id long, valid boolean"), token_states=spark.createDataFrame([(0, 0, 0, [1.0])], tensors.ROWS))
    plan = store.chunks("token_states").groupBy("sample_idx").agg(F.sum("n_tokens"))._jdf.queryExecution().executedPlan().toString()
    assert "n_tokens" in plan and "data" not in plan.replace("metadata", "").replace("dataFilters", "").replace("DataFilters", "")


@pytest.mark.parametrize(("bad", "said"), [([(0, 0, 0, [1.0]), (0, 1, 0, [1.0, 2.0])], "length"), ([(0, 0, 0, [1.0]), (0, 0, 0, [2.0])], "two vectors")])
def test_states_that_are_no_tensor(spark, bad, said):
    with pytest.raises(Exception, match=said):
        tensors.pack(spark.createDataFrame(bad, tensors.ROWS)).collect()


def test_half_precision_like_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=3000) * 10.0 ** rng.uniform(-9, 6, 3000), 2.0 ** np.arange(-26, 17), 2.0 ** np.arange(-26, 17) * (1 + 2.0**-11), 2.0 ** np.arange(-26, 17) * (1 - 2.0**-23), [0.0, -0.0, np.inf, -np.inf, np.nan, 65504, 65519.99, 65520, -65520, 2.0**-25, 3 * 2.0**-25]]).astype(np.float32)
    df = spark.createDataFrame([([float(v) for v in x],)], "v array<float>").select(half_round(F.col("v")).alias("v"))
    got = np.array(df.first().v, np.float32)
    with np.errstate(over="ignore"):
        want = x.astype(np.float16).astype(np.float32)
    assert np.array_equal(got, want, equal_nan=True) and np.array_equal(np.signbit(got), np.signbit(want))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert spark.range(1).select(half_round(F.array(F.lit(None), F.lit(1.0)))).first()[0] == [None, 1.0]


def test_vector_sums(spark):
    rng = np.random.default_rng(5)
    rows = [(None if i % 11 == 0 else i % 7, "k" if i % 2 else None, [float(x) for x in rng.normal(size=4)]) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b string, vec array<float>").repartition(6)
    want = {}
    for a, b, v in rows:
        want.setdefault((a, b), []).append(np.asarray(v, np.float32).astype(float))
    for r in V.sum_vectors(df, ["a", "b"]).collect():
        assert r.n == len(want[r.a, r.b]) and np.allclose(r.total, np.sum(want.pop((r.a, r.b)), axis=0))
    assert not want
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (1, None), (1, [3.0, 4.0]), (2, [1.0]), (2, [1.0, 5.0]), (3, None), (4, [None, 1.0]), (5, [])], "a int, vec array<float>")
    got = sorted((r.a, r.n, str(list(r.total))) for r in V.sum_vectors(odd, ["a"]).collect())
    assert got == [(1, 2, "[4.0, 6.0]"), (2, 1, "[1.0, 5.0]"), (2, 1, "[1.0]"), (4, 1, "[nan, 1.0]"), (5, 1, "[]")]
    assert V.sum_vectors(odd.limit(0), ["a"]).count() == 0


def test_means_have_no_row_per_component(spark):
    tokens = spark.range(4000, numPartitions=4).select((F.col("id") % 20).alias("sample_idx"), F.lit(0).alias("layer"), F.array(*(F.lit(float(k)) for k in range(32))).alias("vec"))
    means = H.mean_states(tokens)
    assert "Generate" not in means._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r.vec) for r in means.collect()} == {tuple(float(k) for k in range(32))}
    # What is shuffled: a row per key and task; every sum at once where a task may hold no bytes.
    keys = ["sample_idx", "layer"]
    assert V.partial_sums(tokens, keys).count() == 4 * 20
    assert V.partial_sums(tokens, keys, held=0).agg(F.sum("n")).first()[0] == 4000


def test_running_accuracy_follows_upserts(spark, tmp_path):
    rng = random.Random(7)
    t = S.VersionedTable(spark, str(tmp_path / "t"), ["model", "at"], ["model"], R.RUNNING, rows_per_file=30)
    schema = "model string, at long, correct boolean, seq int"
    for n in (200, 40, 7):
        rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(90)]), rng.choice([True, False, None]), k) for k in range(n)]
        t.upsert(spark.createDataFrame(rows, schema), ["model", "at"])
        want = R.running_accuracy(t.read(), ["model"], "at")
        assert len(t.manifest()["files"]) > 3
        got = R.stored_running_accuracy(t)
        show = lambda df: sorted((repr(r.model), repr(r.at), r.correct, r.running_accuracy) for r in df.collect())
        assert show(got) == show(want)
