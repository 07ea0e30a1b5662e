"""Evaluation passages that occur, wholly or in part, in a training corpus.

Texts become words: runs of letters or digits, without case, accents, ligatures or width. The
evaluation items' word n-grams are looked for in every document; of each window of an item the
n-gram that is rarest in the corpus is its seed, so common openings join few documents, and a
window of which any n-gram is nowhere in the corpus joins none. For edited copies every n-gram is a
seed, since a copy may lack those that others hold. Documents and items that share a seed are
aligned by Smith-Waterman on words, which also scores edited and paraphrased copies; the longest run
of equal words comes with it. Items are tables like the documents: neither comes to the driver.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.arrow import CHARS_AT_ONCE, code_points, lists, mix, pieces
from lodestrata.storage import cut, cut_counted

#: Words of a seed and of the window that a copy must hold.
SEED, WINDOW = 6, 12
#: Bits a gram of the items takes in the filter that documents are screened with, and bits of the filter at most (16 MB).
GRAM_BITS, FILTER_BITS = 16, 1 << 27
#: Items of one document that are aligned in one row.
ITEMS_AT_ONCE = 64
MATCH, MISMATCH, GAP = 2, -1, -1
#: Letters that decomposition leaves whole.
_SPECIAL = str.maketrans({"æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "ŋ": "n", "ħ": "h"})
_MARKS = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x300, 0x36F), (0x483, 0x487), (0x591, 0x5BD), (0x610, 0x61A), (0x64B, 0x65F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE00, 0xFE0F), (0xFE20, 0xFE2F))) + "]")
_letters: list[np.ndarray] = []


def plain(text: str) -> str:
    """The text without differences of case, accent, ligature and width."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return _MARKS.sub("", text).translate(_SPECIAL)


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([not 0xD800 <= c < 0xE000 and chr(c).isalnum() for c in range(0x110000)]))
    return _letters[0]


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([1], np.full(0xFFFF, base, dtype=np.uint64))), dtype=np.uint64)


#: Powers by which letters are weighted: of the place within 65,536 letters, and of how many such parts lie before it.
_POWERS, _FAR_POWERS = _powers(0x100000001B3), _powers(pow(0x100000001B3, 1 << 16, 1 << 64))


def _segments(text: str) -> list[str]:
    """The text in parts of about ``CHARS_AT_ONCE`` characters that end between words; a longer word stays whole."""
    parts, start = [], 0
    while len(text) - start > CHARS_AT_ONCE:
        end = start + CHARS_AT_ONCE
        while end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
            end += 1
        parts.append(text[start:end])
        start = end
    return [*parts, text[start:]]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and for each text how many are its own. Long texts are worked on in parts."""
    folded = [plain(t) for t in texts]
    if all(len(t) <= CHARS_AT_ONCE for t in folded):
        return _hashes(folded)
    found, counts = [], []
    for t in folded:
        own = [_hashes([part])[0] for part in _segments(t)]
        found += own
        counts.append(sum(map(len, own)))
    return np.concatenate(found), np.array(counts, dtype=np.int64)


def _hashes(folded: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = code_points(folded)
    inside = _is_letter()[points]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    ends = np.cumsum([len(t) + 3 for t in folded])
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(folded), dtype=np.int64)
    at = np.flatnonzero(inside)
    of = np.searchsorted(starts, at, side="right") - 1
    place = at - starts[of]
    weight = _POWERS[place & 0xFFFF]
    if place.max() > 0xFFFF:
        weight = weight * _FAR_POWERS[place >> 16]
    first = np.searchsorted(at, starts)
    hashes = mix(np.add.reduceat((points[at].astype(np.uint64) + np.uint64(1)) * weight, first))
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))
    return hashes, counts


def grams(hashes: np.ndarray, counts: np.ndarray, n: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams that lie within one text, and the place of their first words."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    m = len(hashes) - n + 1
    out = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + m]
    text_of = np.repeat(np.arange(len(counts)), counts)
    whole = np.flatnonzero(text_of[:m] == text_of[n - 1 :])
    return mix(out[whole]), whole


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman of word hashes: best score, end of the best alignment in the document (words before it), longest run of equal words, words of the item in the document."""
    score = np.zeros(len(doc) + 1, dtype=np.int32)
    run = np.zeros(len(doc) + 1, dtype=np.int32)
    steps = np.arange(len(doc) + 1, dtype=np.int32) * GAP
    best, end, longest = 0, 0, 0
    for word in item:
        same = doc == word
        new_run = np.zeros_like(run)
        new_run[1:] = np.where(same, run[:-1] + 1, 0)
        run = new_run
        longest = max(longest, int(run.max()))
        new = np.zeros_like(score)
        new[1:] = np.maximum(score[:-1] + np.where(same, MATCH, MISMATCH), score[1:] + GAP)
        # Gaps in the item: the best start to the left, less a gap for each word since.
        score = np.maximum(np.maximum.accumulate(np.maximum(new, 0) - steps) + steps, 0)
        top = int(score.max())
        if top > best:
            best, end = top, int(score.argmax())
    return best, end, longest, int(np.isin(item, doc).sum())


def _item_table(items: DataFrame, item: str, item_text: str, seed: int) -> DataFrame:
    """``(k, i, n, words, grams)`` of each distinct item with an id and a text: its number, id, words, and hashes of words and n-grams; written."""
    rows = items.select(F.col(item).alias("i"), F.col(item_text).cast("string").alias("t")).where(F.col("i").isNotNull() & F.col("t").isNotNull()).distinct()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "t"):
                hashes, counts = word_hashes(texts)
                found, at = grams(hashes, counts, seed)
                own = np.bincount(np.repeat(np.arange(len(texts)), counts)[at], minlength=len(texts)) if len(at) else np.zeros(len(texts), dtype=np.int64)
                words = [w.tobytes() for w in np.split(hashes, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("i"), pa.array(counts, pa.int32()), pa.array(words, pa.binary()), lists(found.view(np.int64), own)], names=["i", "n", "words", "grams"]
                )

    schema = f"i {rows.schema['i'].dataType.simpleString()}, n int, words binary, grams array<bigint>"
    return cut(rows.mapInArrow(split, schema).select(F.monotonically_increasing_id().alias("k"), "*"), "items")


def _bit_places(found: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of each gram in a filter of ``bits`` bits, a power of two."""
    return [(mix(found + np.uint64(i)) & np.uint64(bits - 1)).astype(np.int64) for i in range(3)]


def _gram_filter(wanted: DataFrame, distinct: int) -> np.ndarray:
    """A Bloom filter, as bytes, of the ``distinct`` grams ``(g)``. Its size is bounded, whatever the items; past that more grams pass it than need to."""
    bits = min(FILTER_BITS, max(1024, 1 << (GRAM_BITS * distinct - 1).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_bit_places(batch.column("g").to_numpy().view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["at", "bits"])

    rows = wanted.mapInArrow(places, "at bigint, bits bigint").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, dtype=np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


def leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, window: int = WINDOW, seed: int = SEED, edited: bool = False) -> DataFrame:
    """Alignments ``(doc, item, score, share, longest_run, item_words, end_word)`` of documents and items that share a seed.

    ``score`` is the Smith-Waterman score on words, ``share`` its part of the item's perfect score,
    ``longest_run`` the greatest number of consecutive words of the item in the document. Every pair
    with ``longest_run >= window`` is there; others are there as far as they share a seed. With ``edited``
    every n-gram of an item is a seed, so each pair with ``longest_run >= seed`` is there, whatever other
    documents hold: that finds copies of which every window was edited, and takes longer.

    Rows with a null id or text give none, nor do items shorter than ``seed`` words; a document id
    or item id that stands in several rows gives the distinct rows of all of them. Documents
    without leaks, empty and blank ones give none; very long ones are read whole. Columns that are
    not named are not read. All documents are read once for the items' n-grams, screened by a filter of
    bounded size, and once for the texts that have a seed.
    """
    spark = docs.sparkSession
    kinds = (docs.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString())
    texts = docs.select(F.col(doc).alias("d"), F.col(text).cast("string").alias("t")).where(F.col("d").isNotNull() & F.col("t").isNotNull())
    table = _item_table(items, item, item_text, seed)
    wanted, distinct = cut_counted(table.select(F.explode("grams").alias("g")).distinct(), "grams")
    held = spark.sparkContext.broadcast(_gram_filter(wanted, distinct))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(held.value) * 8
        for batch in batches:
            for part, own in pieces(batch, "t"):
                hashes, counts = word_hashes(own)
                found, at = grams(hashes, counts, seed)
                ok = np.arange(len(found))
                for place in _bit_places(found, size):
                    ok = ok[held.value[place[ok] >> 3] >> (place[ok] & 7).astype(np.uint8) & 1 == 1]
                text_of = np.repeat(np.arange(len(own)), counts)[at[ok]] if len(ok) else ok
                both = np.unique(np.stack([text_of.astype(np.uint64), found[ok]]), axis=1) if len(ok) else np.zeros((2, 0), dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("d").take(pa.array(both[0].astype(np.int64))), pa.array(both[1].view(np.int64))], names=["d", "g"])

    met = cut(texts.mapInArrow(hits, f"d {kinds[0]}, g bigint"), "hits")
    seeds = table.select("k", F.explode("grams").alias("g")).distinct() if edited else _rarest(table, met, window - seed + 1)
    pairs = met.join(seeds, "g").select("d", "k").distinct()
    # A document's items in rows of bounded size. Written, so that the planner knows their size: texts are shuffled to them only if they are many.
    turn = F.row_number().over(Window.partitionBy("d").orderBy("k"))
    placed = pairs.withColumn("part", F.floor((turn - 1) / ITEMS_AT_ONCE)).join(table.select("k", "i", "words"), "k")
    candidates = cut(placed.groupBy("d", "part").agg(F.collect_list(F.struct("i", "words")).alias("own")).select("d", "own"), "candidates")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("own").type.value_type.field("i").type
            out = []
            for d, t, own in zip(*(batch.column(c).to_pylist() for c in ("d", "t", "own")), strict=True):
                words, _ = word_hashes([t])
                for one in own:
                    item_words = np.frombuffer(one["words"], dtype=np.uint64)
                    best, end, longest, _ = align(words, item_words)
                    out.append((d, one["i"], best, best / (MATCH * len(item_words)), longest, len(item_words), end))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            types = [batch.schema.field("d").type, kind, pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["d", "i", "score", "share", "longest_run", "item_words", "end_word"])

    schema = f"d {kinds[0]}, i {kinds[1]}, score int, share double, longest_run int, item_words int, end_word int"
    return cut(texts.join(candidates, "d").select("d", "t", "own").mapInArrow(score, schema).distinct(), "leaks").withColumnsRenamed({"d": doc, "i": item})


def _rarest(table: DataFrame, met: DataFrame, per: int) -> DataFrame:
    """The seeds ``(k, g)`` of the items' windows of ``per`` n-grams: the n-gram of fewest documents, unless one of them is in no document."""
    spread = met.groupBy("g").agg(F.count("*").alias("docs"))
    placed = table.select("k", F.posexplode("grams").alias("at", "g")).join(spread, "g", "left")
    frame = Window.partitionBy("k").orderBy("at").rowsBetween(0, per - 1)
    windows = placed.select(
        "k", "at", F.count("*").over(frame).alias("n"), F.count("docs").over(frame).alias("there"), F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "g")).over(frame).alias("least")
    )
    # The last windows of an item are cut short; one shorter than a window has only its first.
    whole = (F.col("n") == per) | (F.col("at") == 0)
    return windows.where(whole & (F.col("n") == F.col("there"))).select("k", F.col("least.g").alias("g")).distinct()
