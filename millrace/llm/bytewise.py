"""Vectorised passes over byte buffers: word boundaries and 64-bit hashes.

Hashes here only choose candidates; whoever uses them compares bytes afterwards.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {"pow": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}
#: A random 64-bit value for each byte.
BYTE_CODE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORD = np.arange(256)
LOWER = np.where((_ORD >= 65) & (_ORD <= 90), _ORD + 32, _ORD).astype(np.uint8)
#: After lower-casing: digits, a-z and every byte of a character beyond ASCII.
IS_WORD = ((_ORD >= 0x30) & (_ORD <= 0x39)) | ((_ORD >= 0x61) & (_ORD <= 0x7A)) | (_ORD >= 0x80)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base ** i, base ** -i) modulo 2 ** 64, for i up to n."""
    if len(_tables["pow"]) <= n:
        size = 1 << int(n + 1).bit_length()
        for name, b in (("pow", _BASE), ("inv", _INVERSE)):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["pow"], _tables["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span of ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, first word of each text and the total).

    A word never crosses from one text to the next.
    """
    low = LOWER[raw]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = IS_WORD[low]
    begin = inside[1:-1] > inside[:-2]
    stop = inside[1:-1] > inside[2:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    begin[edge] = inside[1:-1][edge] == 1
    stop[edge - 1] = inside[1:-1][edge - 1] == 1
    starts, ends = np.nonzero(begin)[0], np.nonzero(stop)[0] + 1
    return low, starts, ends, np.searchsorted(starts, offsets)
