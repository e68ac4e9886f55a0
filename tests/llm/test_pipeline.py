"""Each stage of the pipeline against a plain version of it, on what the stage before kept."""

import re

import pytest
from test_decontaminate import WORD, low
from test_scans import slow_lines

import corpus_pipeline
from millrace.llm import packing, quality
from millrace.llm.shared import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """(documents before, documents after) of the stages up to decontamination, by name."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400")
    out, made = spark.createDataFrame(docs.collect(), docs.schema), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, out, SF).collect()
        made[name] = (out.collect(), rows)
        assert not rows or list(rows[0].asDict()) == docs.columns, name
        out = spark.createDataFrame(rows, docs.schema)
    made["packing"] = (out.collect(), corpus_pipeline.STAGES[-1][1](spark, out, SF).collect())
    return made


def test_quality_keeps_what_scores_well(spark, stages):
    before, after = stages["quality"]
    docs = spark.createDataFrame(before, spark.read.parquet(f"{SF}/documents.parquet").schema)
    scores = {r.doc_id: r.score for r in quality.add_scores(docs, quality.fit(docs, table(spark, SF, "labels"))).collect()}
    assert sorted(r.doc_id for r in after) == sorted(i for i, s in scores.items() if s >= quality.KEEP)
    assert {r.doc_id: r for r in after} == {r.doc_id: r for r in before if scores[r.doc_id] >= quality.KEEP}


def test_line_dedup_like_the_plain_version(stages):
    before, after = stages["line_dedup"]
    want = slow_lines([(r.doc_id, r.text) for r in before])
    assert sorted((False, r.doc_id, r.text) for r in after) == sorted(w[:3] for w in want)
    assert sum(w[4] for w in want) > 0
    assert all(r.n_chars == len(r.text) for r in after)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_dedup_keeps_one_of_each_group(stages):
    before, after = stages["near_dedup"]
    rows = sorted(before, key=lambda r: r.doc_id)
    sets, group = [shingles(r.text) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    assert sorted(after, key=lambda r: r.doc_id) == [r for i, r in enumerate(rows) if group.index(group[i]) == i]
    assert len(after) < len(before)


def test_decontamination_drops_what_holds_a_window(spark, stages):
    before, after = stages["decontaminate"]
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = WORD.findall(low(r.text))
        n = min(10, len(w))
        windows |= {tuple(w[s : s + n]) for s in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        w = WORD.findall(low(text))
        return any(tuple(w[s : s + n]) in windows for n in sizes for s in range(len(w) - n + 1))

    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not hit(r.text))
    assert len(after) < len(before)


def test_packing_holds_every_id(stages):
    before, pieces = stages["packing"]
    enc = packing.encoder(packing.byte_bpe_path())
    ids = {r.doc_id: e + (0).to_bytes(4, "little") for r, e in zip(before, enc.encode([r.text or "" for r in before]), strict=True)}
    got = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        got[p.doc_id] = got.get(p.doc_id, b"") + bytes(p.ids)
    assert got == ids


def test_run_and_empty(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows
    assert set(rows[0].asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], spark.read.parquet(f"{sf}/documents.parquet").schema)
    odd.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == 1
    assert re.fullmatch("[a-z_]+", corpus_pipeline.STAGES[0][0])
