"""Texts of token ids, without a Python worker.

A vocabulary's bytes become one array that Spark looks ids up in by place; the bytes of a sequence
are put together and then read as UTF-8 once, so a character that several tokens share comes out
whole. What is no UTF-8 becomes the replacement character, one for each broken part.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# What cleaning up the blanks of a decoded text replaces, in this order.
BLANKS = [(" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re")]


@dataclass
class Vocabulary:
    """The bytes of each id, and the ids that stand for no text."""

    entries: list[bytes]
    special: list[int] = field(default_factory=list)

    def lookup(self) -> Column:
        """All entries as one array of hexadecimal strings, worked out when the plan is made."""
        return F.split(F.lit(",".join(e.hex() for e in self.entries)), ",")


def byte_level(path: str) -> Vocabulary:
    """The vocabulary of a byte-level tokenizer file; its added tokens are special if they say so."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # Bytes that print stand for themselves in the file, the others for characters from 256 on.
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    known = {i: bytes(byte[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in byte for c in t)}
    known |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return Vocabulary([known.get(i, b"") for i in range(max(known) + 1)], sorted(t["id"] for t in spec["added_tokens"] if t["special"]))


def clean_up(text: Column) -> Column:
    """A decoded text without the blanks before punctuation and contractions."""
    for old, new in BLANKS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def decode(ids: Column, vocabulary: Vocabulary, skip_special: bool = True, clean: bool = False) -> Column:
    """The text of an array of ids. Ids that the vocabulary does not have, and nulls, are nothing; a null
    array has no text."""
    kept = F.filter(ids, lambda i: ~i.isin(vocabulary.special)) if skip_special and vocabulary.special else ids
    table = vocabulary.lookup()
    spelt = F.array_join(F.transform(kept, lambda i: F.get(table, i.cast("int"))), "")
    text = F.make_valid_utf8(F.unhex(spelt).cast("string"))
    return clean_up(text) if clean else text
