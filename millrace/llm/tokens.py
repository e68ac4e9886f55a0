"""Vocabularies as byte tables: lengths and bytes of many token ids at once."""

from __future__ import annotations

import json

import numpy as np

from millrace.llm.packing import byte_ranks


class TokenBytes:
    """The bytes of each id, in one buffer."""

    def __init__(self, entries: list[bytes]):
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def join(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one after another."""
        n = self.lengths[ids]
        total = int(n.sum())
        if not total:
            return np.zeros(0, np.uint8)
        at = np.repeat(self.starts[ids] - (np.cumsum(n) - n), n)
        at += np.arange(total)
        return self.flat[at]


def byte_level_entries(path: str) -> list[bytes]:
    """Bytes of each id of a plain byte-level BPE file, its added tokens as they are spelt."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ranks = byte_ranks(spec)
    if ranks is None:
        raise ValueError(f"{path} is no plain byte-level BPE")
    known = {i: t for t, i in ranks.items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [known.get(i, b"") for i in range(max(known) + 1)]


def code_points(utf8: np.ndarray) -> int:
    """Code points of valid UTF-8: its bytes that continue none."""
    return int(np.count_nonzero((utf8 & 0xC0) != 0x80))
