import random

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash as S


def slow_print(t, width=3):
    w = (t or "").encode().lower().split()
    grams = [b" ".join(w)] if 0 < len(w) < width else [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(n, linked):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def make(r, n):
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        t = [r.choice(words) for _ in range(r.randint(0, 80))] if i % 2 or not rows else r.choice(rows)[1].split()
        if t and not i % 2 and i % 3:
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize("dense", [10, 1 << 17])
def test_components(spark, docs, clash, monkeypatch, dense):
    monkeypatch.setattr(S, "DENSE", dense)
    monkeypatch.setattr(S, "SHARD", 16)
    monkeypatch.setattr(S, "LEAF", 4)
    rows = [*make(random.Random(4), 150), (500, None), (501, ""), (None, " \t"), (502, "A B\x0bc"), (503, "a b c"), (503, "a b c"), (504, "é " * 4000), (None, "only null id here")]
    got = S.simhash_components(clash(docs(*rows))).collect()
    prints = [slow_print(t) for _, t in rows]
    root = groups(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    least = {}
    for (i, _), g in zip(rows, root, strict=True):
        least[g] = min([x for x in (least.get(g), i) if x is not None], default=None)
    want = [(i, p, least[g]) for (i, _), p, g in zip(rows, prints, root, strict=True)]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.id, r.fp & (2**64 - 1), r.component) for r in got), key=key) == sorted(want, key=key)
    assert S.simhash_components(docs(*rows).limit(0)).collect() == []


def test_shards_lose_no_pair():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 600, dtype=np.uint64)
    near = base.copy()
    for _ in range(2):
        near ^= np.uint64(1) << r.integers(0, 64, 600).astype(np.uint64)
    points = np.unique(np.concatenate([base, near]))
    i, shard, own = S.ShardTree(points[:200], 5).route(points, 2)
    assert own.sum() == len(points)
    got = set()
    for s in np.unique(shard):
        here = i[shard == s]
        mine = here[own[shard == s]]
        for q, p in S.near_pairs(points[mine], points[here], 2):
            got |= {tuple(sorted(x)) for x in zip(here[q].tolist(), mine[p].tolist(), strict=True)}
    a, b = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2, 1))
    assert {(x, y) for x, y in got if x != y} == set(zip(a.tolist(), b.tolist(), strict=True))


def test_forest_spans_what_pairs_span():
    r = np.random.default_rng(5)
    forest, all_pairs = S.Forest(200), []
    for _ in range(6):
        a, b = r.integers(0, 200, 40), r.integers(0, 200, 40)
        all_pairs += zip(a.tolist(), b.tolist(), strict=True)
        forest.join(a, b)
    root = forest._roots()
    both = {*all_pairs, *((b, a) for a, b in all_pairs)}
    want = groups(200, lambda i, j: (i, j) in both)
    assert [want[i] == want[j] for i in range(200) for j in range(i)] == [root[i] == root[j] for i in range(200) for j in range(i)]
    assert len(forest.edges) == 200 - len(set(root.tolist()))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7)]
    got = dict(S.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def test_near_copies_keep_one(spark, docs, clash):
    r = random.Random(9)
    text = lambda n: [f"v{r.randrange(5000)}" for _ in range(n)]
    a, b = text(200), text(300)
    edited = [*a[:100], "other", *a[101:]]
    rows = [(7, " ".join(a)), (3, " ".join(edited)), (9, " ".join(a)), (9, " ".join(a)), (4, " ".join(b)), (5, " ".join(b[:150] + text(150))), (None, " ".join(b)), (11, None), (12, ""), (None, "x y"), (13, " ".join(text(20)))]
    kept = S.drop_near_copies(clash(docs(*rows)))
    assert kept.columns == clash(docs(*rows)).columns
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in kept.collect()) == [(False, 3), (False, 4), (False, 5), (False, 11), (False, 13), (True, 0)]
    assert S.drop_near_copies(docs(*rows).limit(0)).collect() == []


def test_counts_never_rule_out_a_pair_that_is_alike():
    r = np.random.default_rng(8)
    for n in (40, 400, 70000):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: max(1, len(a) * 9 // 10)], r.integers(0, 1 << 63, len(a) // 10, dtype=np.uint64)]))
        like = len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
        other = np.unique(r.integers(0, 1 << 63, len(a), dtype=np.uint64))
        got = S._may_be_alike([S._counts(a), S._counts(a), b""], [S._counts(b), S._counts(other), S._counts(b)], 0.8)
        assert got[0] or not like
        assert got[1] == (n == 70000)
        assert got[2]


def shingle_sets(rows, width=5):
    words = [(t or "").lower().split() for _, t in rows]
    return [{" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in words]


def test_near_copies_across_size_classes(spark, docs, monkeypatch):
    monkeypatch.setattr(S, "SHARD", 1)
    r, rows = random.Random(3), []
    for i in range(300):
        t = [f"v{r.randrange(5000)}" for _ in range(r.randint(30, 70))]
        rows += [(2 * i, " ".join(t)), (2 * i + 1, " ".join(t + [f"n{r.randrange(5000)}" for _ in range(r.randint(1, 7))]))]
    keys, named = S.near_copy_classes(docs(*rows))
    root = {x.id: x.root for x in keys.join(named, "key").collect()}
    sets, prints = shingle_sets(rows), [slow_print(t, 5) for _, t in rows]
    close = [i for i in range(0, 600, 2) if 10 * len(sets[i] & sets[i + 1]) >= 8 * len(sets[i] | sets[i + 1]) and (prints[i] ^ prints[i + 1]).bit_count() <= 18]
    assert len(close) > 200
    assert [i for i in close if root[i] != root[i + 1]] == []


def test_near_copies_are_decided_on_whole_sets(spark, docs):
    r, rows = random.Random(5), []
    for i in range(80):
        t = [f"v{r.randrange(90000)}" for _ in range(r.randint(400, 900))]
        more = len(t) // 4 + r.randint(-25, 25)
        rows += [(2 * i, " ".join(t)), (2 * i + 1, " ".join(t + [f"n{r.randrange(90000)}" for _ in range(more)]))]
    keys, named = S.near_copy_classes(docs(*rows))
    root = {x.id: x.root for x in keys.join(named, "key").collect()}
    sets = shingle_sets(rows)
    want = [10 * len(sets[i] & sets[i + 1]) >= 8 * len(sets[i] | sets[i + 1]) for i in range(0, 160, 2)]
    assert 20 < sum(want) < 60
    assert [root[i] == root[i + 1] for i in range(0, 160, 2)] == want


@pytest.mark.parametrize("asked", [1 << 18, -1])
def test_sets_stay_where_they_are_if_few_are_asked_for(spark, docs, monkeypatch, asked):
    monkeypatch.setattr(S, "ASKED", asked)
    plans, stored = [], S.Scratch.table
    monkeypatch.setattr(S.Scratch, "table", lambda self, df, name, *a: (name == "own" and plans.append(df._jdf.queryExecution().executedPlan().toString())) or stored(self, df, name, *a))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = links_found(docs, [(0, "a b c d e f g h i j"), (1, "a b c d e f g h i j k"), (2, "q w e r t y"), (3, "a b c d e f g h i j k l m n o p")])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans and all(("hashpartitioning" in p) == (asked < 0) for p in plans)
    assert got[0] == got[1] and len(set(got)) == 3


def test_no_near_copy_is_lost(spark, docs, monkeypatch):
    monkeypatch.setattr(S, "MEET", 3)
    r, rows = random.Random(6), []
    for i in range(300):
        t = [f"v{r.randrange(90000)}" for _ in range(9)]
        rows += [(2 * i, " ".join(t[:8])), (2 * i + 1, " ".join(t))]
    base = [f"u{i}" for i in range(120)]
    for i in range(120):
        rows.append((600 + i, " ".join(f"x{i}" if r.random() < 0.02 else w for w in base[: r.randint(80, 120)])))
    keys, named = S.near_copy_classes(docs(*rows))
    root = {x.id: x.root for x in keys.join(named, "key").collect()}
    sets = shingle_sets(rows)
    want = groups(len(rows), lambda i, j: 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]))
    assert len(set(want[600:])) > 5
    assert len({(g, root[i]) for i, g in enumerate(want)}) == len(set(want)) == len(set(root.values()))


def test_near_copies_meet_by_their_fingerprints(spark, docs, monkeypatch):
    none = spark.createDataFrame([], "a long, b long")
    for name in ("_meet", "_meet_one", "_meet_crowd"):
        monkeypatch.setattr(S, name, lambda *a: none)
    r, rows = random.Random(8), []
    for i in range(40):  # a word is added to a long text
        t = [f"v{r.randrange(90000)}" for _ in range(400)]
        rows += [(2 * i, " ".join(t)), (2 * i + 1, " ".join([*t, "more"]))]
    prints = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in own) > len(own)) for own in (S.shingle_hashes(t.encode(), 5) for _, t in rows)]
    close = [(prints[i] ^ prints[i + 1]).bit_count() <= 2 for i in range(0, 80, 2)]
    got = links_found(docs, rows)
    assert sum(close) > 20 and [got[i] == got[i + 1] for i in range(0, 80, 2)] == close
    # Fingerprints that are all alike link nothing by themselves.
    monkeypatch.setattr(S, "_bit_counts", lambda h: np.zeros(64, np.int64))
    assert len(set(links_found(docs, rows[::2]))) == 40


def links_found(docs, rows):
    keys, named = S.near_copy_classes(docs(*rows))
    root = {x.id: x.root for x in keys.join(named, "key").collect()}
    return [root[i] for i, _ in rows]


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_a_passage_in_many_texts_makes_no_pairs_of_them(spark, docs, monkeypatch, sent):
    monkeypatch.setattr(S, "CROWDED", sent)
    r, own = random.Random(11), lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    passage, made = own(5), []
    # A passage whose hash comes before nearly all others.
    for _ in range(3000):
        p = own(5)
        if S.shingle_hashes(" ".join(p).encode(), 5)[0] < S.shingle_hashes(" ".join(passage).encode(), 5)[0]:
            passage = p
    rows = [(i, " ".join([*own(30), *passage, *own(30)])) for i in range(2000)]
    rows += [(5000 + i, rows[i][1] + " more words") for i in range(40)]
    meet, crowd = S._meet, S._meet_crowd
    monkeypatch.setattr(S, "_meet", lambda *a: made.append(meet(*a)) or made[-1])
    monkeypatch.setattr(S, "_meet_crowd", lambda *a: made.append(crowd(*a)) or made[-1])
    counted = []
    alike = S._alike
    monkeypatch.setattr(S, "_alike", lambda pairs, *a: counted.append(sum(m.count() for m in made)) or alike(pairs, *a))
    got = links_found(docs, rows)
    assert max(counted) < 20_000
    assert len(set(got)) == 2000 and all(got[i] == got[2000 + i] for i in range(40))


@pytest.mark.parametrize("star", [0, 5, 1 << 13])
def test_crowds_in_blocks_lose_no_pair(spark, docs, monkeypatch, star):
    for name, value in (("MEET", 3), ("CELL", 7), ("ROUNDS", 2), ("STAR", star)):
        monkeypatch.setattr(S, name, value)
    r = random.Random(12)
    common = [[f"c{k}_{i}" for i in range(40)] for k in range(6)]
    rows = []
    for i in range(150):  # texts made of passages that many share, so hashes stay crowded
        parts = r.sample(range(6), 3)
        t = [w for k in parts for w in common[k]]
        for _ in range(r.randint(0, 2)):
            t[r.randrange(len(t))] = f"x{r.randrange(50)}"
        rows.append((i, " ".join(t)))
    got = links_found(docs, rows)
    sets = shingle_sets(rows)
    want = groups(len(rows), lambda i, j: 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]))
    assert len({(g, x) for g, x in zip(want, got, strict=True)}) == len(set(want)) == len(set(got))


def test_any_order_of_hashes_keeps_a_common_one():
    r = np.random.default_rng(13)
    for _ in range(300):
        base = np.unique(r.integers(0, 1 << 63, r.integers(1, 60), dtype=np.uint64))
        other = np.unique(np.concatenate([base[r.random(len(base)) < 0.9], r.integers(0, 1 << 63, r.integers(0, 6), dtype=np.uint64)]))
        if not len(other) or 10 * len(np.intersect1d(base, other)) < 8 * len(np.union1d(base, other)):
            continue
        last = np.sort(r.choice(base, r.integers(0, len(base) + 1), replace=False))
        at, h, _, place, before = S._heads([base, other], 0.8, last)
        assert (before[1:][place[1:] > 0] == h[:-1][place[1:] > 0]).all()
        assert set(h[at == 0].tolist()) & set(h[at == 1].tolist())
        assert (place[at == 0] == np.arange((at == 0).sum())).all()
