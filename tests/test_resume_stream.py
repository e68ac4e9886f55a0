"""Resume positions as state, over restarts, against the batch query."""

import random

from millrace.operators import upsert as U
from millrace.streaming.resume import EVENTS, Intervals, resume_stream


def test_intervals():
    rng, have = random.Random(1), set()
    own = Intervals([], [])
    for _ in range(4000):
        x = rng.randrange(60)
        if rng.random() < 0.6:
            own.add(x)
            have.add(x)
        else:
            own.discard(x)
            have.discard(x)
        held = [x for a, b in zip(own.lows, own.highs, strict=True) for x in range(a, b)]
        assert held == sorted(have) and len(own) == len(have)
        assert own.first_missing() == next(i for i in range(61) if i not in have)
        assert all(b < a for b, a in zip(own.highs, own.lows[1:], strict=False))


def test_positions_over_restarts(spark, tmp_path):
    source, target, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    rng, status = random.Random(2), {}
    for k in range(3):  # each round is a restart: a new query on the old checkpoint
        rows = [(rng.choice("ab"), "d", rng.randrange(25), rng.random() < 0.7, s) for s in range(80)]
        if k == 1:
            rows += [("c", None, i, True, i) for i in range(40)] + [("c", None, None, True, 99)]
        for m, d, i, ok, _ in rows:
            if i is not None:
                status[m, d, i] = ok
        spark.createDataFrame(rows, EVENTS).repartition(3).write.mode("append").parquet(source)
        q = resume_stream(spark, source, target, marks)
        q.awaitTermination(180)
        assert q.exception() is None
        got = {(r.model, r.dataset): (r.resume_index, r.n_valid, r.n_seen) for r in U.stored(spark, target).collect()}
        for key in {(m, d) for m, d, _ in status}:
            own = {i: ok for (m, d, i), ok in status.items() if (m, d) == key}
            first = next(i for i in range(99) if not own.get(i))
            assert got.pop(key) == (first, sum(own.values()), len(own))
        assert not got
