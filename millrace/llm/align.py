"""Cross-tokenizer alignment: where the tokens of two vocabularies end together.

Both tokenizers encode the same bytes (a blank and the text). A two-pointer merge of their
cumulative token ends, done inside ``mapInPandas`` for many documents at once, gives the
offsets where a token of each ends: these cut a document into groups, and the two tokens
that end there are linked. Each document keeps its different links with their numbers;
Spark counts them over the corpus (``groupBy``), and joins the counts, and the maxima of
each side, back to the documents.

Of two tokens that end together the bytes of one end with the bytes of the other. So the
number of different links is bounded by the vocabularies, whatever the corpus
(``possible_links``: 0.3 million for the two that the query uses); that is why the
counted links may be broadcast, and why no frequent link gathers rows in one task.

Defined results: a null or empty text, and one whose tokens do not spell it, has no tokens:
zeros and an empty digest; repeated rows are documents each and counted each; a null id stays;
an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.packing import LONG, byte_bpe_path, encoder
from millrace.llm.shared import materialize, table
from millrace.llm.tokens import TokenBytes, byte_level_entries

#: Texts are merged together up to so many characters (a longer one alone).
SLICE = 1 << 19
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
#: What follows an id in a group list: more of its side, the other side, the next group, nothing.
MORE, SIDE, GROUP, LAST = range(4)


def piece_entries(model) -> list[bytes]:  # noqa: ANN001
    """Bytes of each id of a piece model."""
    spelt = ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in spelt]


def possible_links(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of entries there are of which one ends with the other."""
    in_a, in_b = Counter(filter(None, a)), Counter(filter(None, b))
    shorter_b = sum(n * in_b[x[k:]] for x, n in in_a.items() for k in range(len(x)))
    return shorter_b + sum(n * in_a[x[k:]] for x, n in in_b.items() for k in range(1, len(x)))


class Tokenizers:
    """Two tokenizers and the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor

        self.first, self.second = encoder(a_path), SentencePieceProcessor(model_file=b_path)
        self.a, self.b = TokenBytes(byte_level_entries(a_path)), TokenBytes(piece_entries(self.second))
        # Every id with what may follow it, spelt in cells of equal width.
        most = max(len(self.a.lengths), len(self.b.lengths))
        spelt = [f"{i}{c}".encode() for i in range(most) for c in (",", "|", ";", "")]
        self.cell_lengths = np.array([len(s) for s in spelt])
        width = int(self.cell_lengths.max())
        self.cells = np.frombuffer(b"".join(s.ljust(width) for s in spelt), np.uint8).reshape(-1, width)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; strings of special tokens are plain text."""
        tokenizer, fast = self.first.tokenizer, self.first.fast
        tokenizer.encode_special_tokens = True
        a = []
        for t in texts:
            t = f" {t}"
            ids = fast.encode_ordinary(t) if fast is not None and len(t) <= LONG else tokenizer.encode(t, add_special_tokens=False).ids
            a.append(np.array(ids, np.int64))
        tokenizer.encode_special_tokens = False
        return a, [np.array(ids, np.int64) for ids in self.second.encode(texts, num_threads=1)]

    def spells(self, a: np.ndarray, b: np.ndarray, raw: bytes) -> bool:
        return self.a.join(a).tobytes() == raw and self.b.join(b).tobytes() == raw


def merge_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in two ascending lists of ends at which both hold the same end."""
    pointer = np.minimum(np.searchsorted(a, b), len(a) - 1)
    same = np.flatnonzero(a[pointer] == b)
    return pointer[same], same


def aligned_texts(tokenizers: Tokenizers, texts: list[str]) -> Iterator[tuple]:
    """(n_a, n_b, n_groups, digest of the groups, links, their numbers) of each text.

    A link is the first side's id in the upper 32 bits and the second's in the lower.
    """
    nothing = (0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
    all_a, all_b = tokenizers.encode(texts)
    good = [bool(t) and tokenizers.spells(x, y, f" {t}".encode()) for t, x, y in zip(texts, all_a, all_b, strict=True)]
    if not any(good):
        yield from (nothing for _ in texts)
        return
    a, b = (np.concatenate([x for x, g in zip(side, good, strict=True) if g]) for side in (all_a, all_b))
    n_a, n_b = (np.array([len(x) for x, g in zip(side, good, strict=True) if g]) for side in (all_a, all_b))
    # All texts are merged at once: each ends where its tokens of both sides end.
    in_a, in_b = merge_ends(np.cumsum(tokenizers.a.lengths[a]), np.cumsum(tokenizers.b.lengths[b]))
    after_a, after_b = np.full(len(a), MORE), np.full(len(b), MORE)
    after_a[in_a], after_b[in_b] = SIDE, GROUP
    to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
    after_b[to_b - 1] = LAST
    # A group's tokens of the first side and then those of the second, group after group.
    group_a, group_b = (np.cumsum(e) - e for e in ((after_a == SIDE).astype(np.int64), np.isin(after_b, (GROUP, LAST)).astype(np.int64)))
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + np.concatenate([[0], in_b + 1])[group_a]] = a * 4 + after_a
    codes[np.arange(len(b)) + (in_a + 1)[group_b]] = b * 4 + after_b
    size = tokenizers.cell_lengths[codes]
    spelt = tokenizers.cells[codes][np.arange(tokenizers.cells.shape[1]) < size[:, None]].tobytes()
    upto = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], to_a + to_b])]
    links = a[in_a] << 32 | b[in_b]
    groups_to = np.concatenate([[0], np.searchsorted(in_b, to_b - 1, side="right")])
    k = 0
    for g in good:
        if not g:
            yield nothing
            continue
        pairs, times = np.unique(links[groups_to[k] : groups_to[k + 1]], return_counts=True)
        yield int(n_a[k]), int(n_b[k]), int(groups_to[k + 1] - groups_to[k]), hashlib.sha256(spelt[upto[k] : upto[k + 1]]).hexdigest(), pairs, times
        k += 1


_tokenizers: dict[tuple[str, str], Tokenizers] = {}


def links_of(docs: DataFrame, a_path: str, b_path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups_sha256, links, times): each document with its
    different links and how often it has them; ``row`` numbers the rows."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (a_path, b_path) not in _tokenizers:
            _tokenizers[a_path, b_path] = Tokenizers(a_path, b_path)
        tokenizers, row = _tokenizers[a_path, b_path], TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes = batch["text"].str.len().fillna(0).to_numpy(np.int64)
            upto, k = np.cumsum(sizes), 0
            while k < len(batch):
                end = max(k + 1, int(np.searchsorted(upto, upto[k] - sizes[k] + SLICE, side="right")))
                part = batch.iloc[k:end]
                found = list(zip(*aligned_texts(tokenizers, [t or "" for t in part["text"].tolist()]), strict=True))
                out = dict(zip(["n_a", "n_b", "n_groups", "groups_sha256", "links", "times"], found, strict=True))
                yield pd.DataFrame({"row": np.arange(row, row + len(part)), "id": part["id"].array, **out}).assign(n_links=out["n_groups"])
                row, k = row + len(part), end

    own = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    schema = f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>, times array<long>"
    return own.mapInPandas(run, schema)


def counted_links(aligned: DataFrame) -> DataFrame:
    """(link, count, most_a, most_b): how many links of the corpus hold each pair, and the
    highest count that a link of the same first and of the same second id has."""
    each = aligned.select(F.posexplode("links").alias("at", "link"), "times").select("link", F.get("times", F.col("at")).alias("n"))
    counts = each.groupBy("link").agg(F.sum("n").alias("count"))
    sides = counts.withColumns({"a": F.shiftright("link", 32), "b": F.col("link").bitwiseAND(F.lit((1 << 32) - 1))})
    most = {f"most_{side}": F.max("count").over(Window.partitionBy(side)) for side in ("a", "b")}
    return sides.withColumns(most).select("link", "count", "most_a", "most_b")


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(documents, links): of each document its numbers of tokens, groups and links, the digest of
    its groups, n_best and n_best_a (links whose count is the highest of their second or first id)
    and count_sum; and the counted links of the corpus."""
    aligned = materialize(links_of(docs, a_path, b_path, text, id_col), "aligned", "zstd")
    counts = materialize(counted_links(aligned), "links")
    own = ["row", "id", *COUNTS, "groups_sha256"]
    each = aligned.select(*own, F.posexplode_outer("links").alias("at", "link"), "times").select(*own, "link", F.get("times", F.col("at")).alias("n"))
    joined = each.join(F.broadcast(counts), "link", "left")

    def total(value) -> object:  # noqa: ANN001
        return F.coalesce(F.sum(value), F.lit(0))

    best = {name: total(F.when(F.col("count") == F.col(most), F.col("n"))) for name, most in (("n_best", "most_b"), ("n_best_a", "most_a"))}
    sums = joined.groupBy(*own).agg(*(c.alias(k) for k, c in best.items()), total(F.col("n") * F.col("count")).alias("count_sum"))
    return sums.drop("row"), counts


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, aligned between the byte-level and the piece vocabulary."""
    import public_tokenizers

    docs, _ = align(table(spark, sf_dir, "documents"), byte_bpe_path(), public_tokenizers.path("piece_bpe_32k.model"))
    return docs.select(F.col("id").alias("doc_id"), *COUNTS, "n_best", "count_sum", "groups_sha256", "n_best_a")
