"""Encoding of a corpus to token ids by a public byte-level BPE vocabulary.

Texts are split by the vocabulary's public pattern; within a split, adjacent tokens are merged by
rank. A segment tree over the byte positions holds at its root the least rank of all live pairs
and, among equals, the leftmost position, so each merge finds its pair at the root and costs three
logarithmic point updates: the merged pair, its left neighbour, and the vanished right one. A split
of n bytes takes O(n log n), however long it is.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestrata.llm.arrow import lists

#: Fixed value: the public pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Splits whose ids a worker keeps, and their greatest length in bytes; more are encoded anew.
KEPT_SPLITS, KEPT_BYTES = 300_000, 48
NONE = 1 << 60


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks by token from the lines of a rank file (base64 token, rank)."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one split, by merging with a segment tree of pair ranks.

    Leaves are byte positions; the leaf of a live token holds the rank of its pair with the next
    live token times n plus its position, so the minimum is the leftmost of the least rank.
    """
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    ends = list(range(1, n + 1))  # where the live token that starts here ends
    before = list(range(-1, n - 1))  # start of the live token before
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)

    def weight(i: int) -> int:
        middle = ends[i]
        if middle >= n:
            return NONE
        rank = ranks.get(piece[i : ends[middle]])
        return NONE if rank is None else rank * n + i

    def update(i: int, value: int) -> None:
        k = i + size
        tree[k] = value
        k >>= 1
        while k:
            left, right = tree[2 * k], tree[2 * k + 1]
            least = left if left <= right else right
            if tree[k] == least:
                break
            tree[k] = least
            k >>= 1

    for i in range(n - 1):
        tree[size + i] = weight(i)
    for k in range(size - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left <= right else right
    while tree[1] < NONE:
        i = tree[1] % n
        gone = ends[i]
        ends[i] = ends[gone]
        if ends[i] < n:
            before[ends[i]] = i
        update(gone, NONE)
        update(i, weight(i))
        if before[i] >= 0:
            update(before[i], weight(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return ids


class Encoder:
    """Encodes texts; keeps the ids of short splits it has met."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.known, self.pattern = ranks, {}, regex.compile(PATTERN)
        self.split = self.pattern.findall
        self.library_split = library_splitter()

    def splits(self, text: str) -> Iterable[str]:
        """The text's splits. What letters are is the public tokenizer's own table's to say, so texts with characters that this Python doesn't know go by its splitter; on others both agree."""
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self.library_split(text)
        return self.split(text) if len(text) < 1_000_000 else (m[0] for m in self.pattern.finditer(text))

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for s in self.splits(text):
            ids = known.get(s)
            if ids is None:
                ids = merge(s.encode("utf-8", "surrogatepass"), self.ranks)
                if len(s) <= KEPT_BYTES:
                    if len(known) >= KEPT_SPLITS:
                        known.clear()
                    known[s] = ids
            out += ids
        return out


def library_splitter():
    """The public library's splitter for byte-level vocabularies. The library is needed wherever texts are encoded: without it ids could differ between machines, so its absence is an error."""
    from tokenizers import pre_tokenizers

    splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return lambda text: [text[a:b] for _, (a, b) in splitter.pre_tokenize_str(text)]


def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for s in self.splits(text):
            ids = known.get(s)
            if ids is None:
                ids = merge(s.encode("utf-8", "surrogatepass"), self.ranks)
                if len(s) <= KEPT_BYTES:
                    if len(known) >= KEPT_SPLITS:
                        known.clear()
                    known[s] = ids
            out += ids
        return out


def library_splitter():
    """The public library's splitter for byte-level vocabularies, or None where it isn't installed."""
    try:
        from tokenizers import pre_tokenizers
    except ImportError:
        return None
    splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return lambda text: [text[a:b] for _, (a, b) in splitter.pre_tokenize_str(text)]


def encode(df: DataFrame, text: str, keep: list[str], vocabulary: str, ids: str = "ids") -> DataFrame:
    """``keep`` and ``ids``, the token ids (array of int) of ``text`` by the rank file ``vocabulary``.

    No special tokens are added, and their strings are ordinary text. A null text and an empty one
    get an empty array. Blank, repeated and very long texts are encoded like any other; an empty
    table gives none. ``ids`` must not be among ``keep``; columns not in ``keep`` are not read.
    The vocabulary file (under 1 MB) is read by the driver and broadcast; there is no shuffle.
    """
    spark = df.sparkSession
    data = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(read_ranks(data.value))
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                encoded = [np.array(encoder.encode(t) if t else (), dtype=np.int32) for t in part.column("_text").to_pylist()]
                column = lists(np.concatenate(encoded), np.array([len(e) for e in encoded], dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], column], names=[*keep, ids])

    source = df.select(*keep, df[text].cast("string").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), f"`{ids}` array<int>"])
    return source.mapInArrow(run, schema)


def decode(ids: list[int], ranks: dict[bytes, int]) -> str:
    """The text of token ids."""
    tokens = {v: k for k, v in ranks.items()}
    return b"".join(tokens[i] for i in ids).decode("utf-8", "surrogatepass")
