"""The line source: every split size gives the lines that plain reading gives."""

import json

import pytest

from millrace.sources import jsonl as J
from millrace.sources import lines as L

TEXT = 'a\n\nb\r\n' + "x" * 300 + "\nlast line, no end é\n\n" + json.dumps({"question": "q"})


def plain(path):
    lines = path.read_bytes().split(b"\n")
    return [x.removesuffix(b"\r").decode("utf-8", "replace") for x in (lines[:-1] if lines[-1] == b"" else lines)]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000])
def test_splits_share_every_line_once(tmp_path, size):
    for k, text in enumerate([TEXT, TEXT + "\n", "\n", "one", "\n\n\nx\n"]):
        f = tmp_path / f"{k}.jsonl"
        f.write_text(text)
        got, counts = [], []
        with open(f, "rb") as stream:
            for s in L.splits(str(f), split_bytes=size):
                own = [x for part in L.lines_of(stream, s) for x in part]
                counts.append((L.count_lines(stream, s), len(own)))
                got += own
        assert [x.removesuffix(b"\r").decode() for x in got] == plain(f)
        assert all(a == b for a, b in counts)


def test_scan_like_the_text_reader(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(f"line {i} " + "x" * (i % 60) for i in range(500)) + "\n")
    (tmp_path / "b.jsonl").write_bytes(b"only\nbad \xff\xfe\r\n")
    (tmp_path / "c.txt").write_text("not read\n")
    got = sorted(map(tuple, L.scan_lines(spark, str(tmp_path), split_bytes=1000).collect()))
    assert got == sorted((f"{n}.jsonl", i, x) for n in "ab" for i, x in enumerate(plain(tmp_path / f"{n}.jsonl")))
    one = sorted((r.line_idx, r.raw) for r in L.scan_lines(spark, f"file://{tmp_path}", as_one=True, split_bytes=777).collect())
    assert one == list(enumerate(plain(tmp_path / "a.jsonl") + plain(tmp_path / "b.jsonl")))
    assert L.scan_lines(spark, str(tmp_path), glob="*.none").count() == 0


@pytest.mark.parametrize("head", [0, 1, 7, 499, 500, 501, 10_000])
def test_head(spark, tmp_path, head):
    (tmp_path / "a.jsonl").write_text("".join(f"line {i}\n" for i in range(500)))
    (tmp_path / "b.jsonl").write_text("after\nall")
    want = (plain(tmp_path / "a.jsonl") + plain(tmp_path / "b.jsonl"))[:head]
    assert sorted((r.line_idx, r.raw) for r in L.scan_lines(spark, str(tmp_path), head=head, split_bytes=300).collect()) == list(enumerate(want))


def test_head_stops_reading(spark, tmp_path):
    f = tmp_path / "d.jsonl"
    f.write_text("".join(json.dumps({"question": f"q{i}", "answer": str(i)}) + "\n" for i in range(100)))
    with open(f, "r+b") as out:
        out.truncate(1 << 42)  # four terabytes, of which nothing may be read but the start
    assert [r.question for r in J.load_samples(spark, str(tmp_path), "d", max_samples=5).orderBy("sample_id").collect()] == [f"q{i}" for i in range(5)]
    assert L.scan_lines(spark, str(f), head=20).rdd.getNumPartitions() == 1

    class Counting:
        def __init__(self, stream):
            self.stream, self.bytes = stream, 0

        def seek(self, at):
            self.stream.seek(at)

        def read(self, n):
            self.bytes += n
            return self.stream.read(n)

    with open(f, "rb") as stream:
        own = Counting(stream)
        split = L.splits(str(f))[0]
        split.most = 20
        assert len([x for part in L.lines_of(own, split) for x in part]) == 20
        assert own.bytes <= L.BLOCK


def test_what_cannot_be_opened():
    assert not L.readable("nosuch://x/y") and not L.readable("/no/such/folder")
