"""The shared folder and bounded samples."""

import os
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import lines, shared, simhash


def fake(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: folder), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_has_to_name_the_shared_folder():
    assert shared.shared_dir(fake("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(fake("spark://host:7077"))
    one = fake("local[2]")
    assert shared.shared_dir(one) == shared.shared_dir(one)


def test_samples_are_the_smallest_hashes(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    first = [r.k for r in df.orderBy(F.pmod(F.xxhash64("k"), F.lit(1 << 30)), F.xxhash64("k"), "k").limit(100).collect()]
    assert [r.k for r in shared.hash_sample(df, "k", 2000, 100).collect()] == first
    assert shared.hash_sample(df, "k", 2000, 5000).count() == 2000
    assert shared.hash_sample(df.limit(0), "k", 0, 5).count() == 0


def test_scratch_tables_go(spark):
    scratch = shared.Scratch(spark)
    tables = [scratch.table(spark.range(n), "scratch", "zstd") for n in (0, 5)]
    assert [t.count() for t in tables] == [0, 5]
    paths = list(scratch.paths)
    assert all(os.path.isdir(p) for p in paths)
    scratch.clear()
    assert not any(os.path.exists(p) for p in paths)


def test_rows_go_to_python_in_batches_of_few_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    texts = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    before = {k: spark.conf.get(k, None) for k in shared.Scratch.SETTINGS}
    scratch = shared.Scratch(spark)
    got = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    scratch.clear()
    assert sum(got) > 39_000_000 and max(got) < 5_000_000
    assert before == {k: spark.conf.get(k, None) for k in shared.Scratch.SETTINGS}


@pytest.mark.parametrize("run", [lines.drop_lines, simhash.near_copy_classes])
def test_dedup_hands_texts_over_in_batches_of_few_bytes(docs, monkeypatch, run):
    held, stored = [], shared.Scratch.table
    monkeypatch.setattr(shared.Scratch, "table", lambda self, *a: held.append(self.spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)) or stored(self, *a))
    run(docs((1, "a b c d e f"), (2, "a b c d e f g")))
    assert set(held) == {"2m"}
