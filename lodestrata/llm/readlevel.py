"""Reading level of documents from the acquisition grades of their words.

Every word has a distribution over the graded texts; its acquisition grade is where that
distribution's mass is half reached. A document is described by quantiles of the grades of its
known words, and a calibrated ordinal scale over those quantiles gives its level.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import langmix
from lodestrata.llm.arrow import pieces

BANDS = ("plain", "middle", "demanding")
#: Graded documents to fit on, chosen by a hash of their ids, and the longest among them.
SAMPLE_DOCS, SAMPLE_CHARS = 4_000, 30_000
#: Documents in which a word must stand to get a grade.
LEAST_DOCS = 3
LEAST_WORDS = 40
QUANTILES = (0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def votes(labels: DataFrame, doc: str, rater: str, band: str) -> DataFrame:
    """``(doc, grade)``: the raters' median band as 0, 1, 2. Case and blanks don't count, nor do null or unknown bands; of a rater's several opinions each counts; repeated rows count once."""
    bare = F.lower(F.trim(band))
    grade = F.when(bare == BANDS[0], 0).when(bare == BANDS[1], 1).when(bare == BANDS[2], 2)
    return (
        labels.select(F.col(doc).alias("d"), F.col(rater).alias("r"), grade.alias("g")).distinct()
        .where(F.col("d").isNotNull() & F.col("g").isNotNull())
        .groupBy("d").agg(F.percentile("g", 0.5).alias("m"))
        .select(F.col("d").alias(doc), F.round("m").cast("int").alias("grade"))
    )


def terms(text: str) -> list[str]:
    """The text's words in lower case."""
    return _WORD.findall(text.lower())


class Grades:
    """Acquisition grades of words and the scale from their quantiles to bands."""

    def __init__(self, texts: list[str], grades: list[int]):
        bags = [terms(t) for t in texts]
        there = Counter(t for bag in bags for t in set(bag))
        size = len(BANDS)
        totals = np.array([sum(len(b) for b, g in zip(bags, grades, strict=True) if g == k) for k in range(size)], dtype=float)
        counts: dict[str, np.ndarray] = {}
        for bag, g in zip(bags, grades, strict=True):
            for t, n in Counter(bag).items():
                if there[t] >= LEAST_DOCS:
                    counts.setdefault(t, np.zeros(size))[g] += n
        self.of = {}
        for t, n in counts.items():
            share = (n + 0.1) / np.maximum(totals, 1)
            reached = np.cumsum(share / share.sum())
            k = int(np.searchsorted(reached, 0.5))
            below = reached[k - 1] if k else 0.0
            self.of[t] = k + (0.5 - below) / (reached[k] - below)
        x = np.array([self.features(b) for b in bags]).reshape(len(bags), -1)
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        z, y = (x - self.mean) / self.spread, np.array(grades)
        # Ordinal scale: one weight a quantile and two thresholds, by gradient descent on the log-loss.
        w, cuts = np.zeros(z.shape[1]), np.array([-1.0, 1.0])
        present = np.bincount(y, minlength=size)
        weight = (len(y) / (size * np.maximum(present, 1)))[y]
        for _ in range(1500):
            s = z @ w
            up = 1 / (1 + np.exp(-(s[:, None] - cuts[None, :])))
            wrong = (up - (y[:, None] > np.arange(size - 1)[None, :])) * weight[:, None]
            w -= 0.5 * (z.T @ wrong.sum(1) / len(y) + 0.01 * w)
            cuts += 0.5 * wrong.mean(0)
        self.w, self.cuts = w, np.sort(cuts)

    def features(self, bag: list[str]) -> np.ndarray:
        known = np.array([g for g in map(self.of.get, bag) if g is not None])
        return np.quantile(known, QUANTILES) if len(known) else np.full(len(QUANTILES), len(BANDS) / 2)

    def level(self, text: str) -> tuple[float, int]:
        """The text's place on the scale and its band."""
        s = float(((self.features(terms(text)) - self.mean) / self.spread) @ self.w)
        return s, int((s > self.cuts).sum())


def fit(docs: DataFrame, doc: str, text: str, graded: DataFrame) -> Grades:
    """Grades from a sample of about ``SAMPLE_DOCS`` of the graded documents; graded: ``votes``."""
    n = graded.count()
    share = int(1_000_003 * min(1.0, SAMPLE_DOCS / max(n, 1))) + 1
    rows = (
        docs.select(doc, F.col(text).alias("_text")).join(graded, doc)
        .where((F.pmod(F.xxhash64(doc), F.lit(1_000_003)) < share) & (F.length("_text") <= SAMPLE_CHARS))
        .select("_text", "grade").toPandas()
    )
    return Grades(rows["_text"].tolist(), rows["grade"].tolist())


def reading_levels(docs: DataFrame, doc: str, text: str, grades: Grades, model: langmix.Model) -> DataFrame:
    """``(doc, band, level, english_words, words)`` of every document.

    ``words`` counts blank-separated words, ``english_words`` those in sentences that the language
    mixture gives to English. ``band`` is null where ``words`` is under ``LEAST_WORDS`` or not more
    than half of them are English; null and blank texts have 0 words. Rows with equal ids are each
    rated; an empty table gives none; very long texts count whole; other columns are not read.
    There is no shuffle; grades and model are bounded by the samples they were fitted on.
    """
    held = docs.sparkSession.sparkContext.broadcast((grades, model.parts()))
    english = model.languages.index("en") if "en" in model.languages else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = held.value
        languages = langmix.Model(*parts)
        for batch in batches:
            for part, texts in pieces(batch, "t"):
                bands, levels, shares, counts = [], [], [], []
                for t, (n, in_english) in zip(texts, langmix.words_in(texts, languages, english), strict=True):
                    band = level = None
                    if n >= LEAST_WORDS and 2 * in_english > n:
                        level, k = own.level(t)
                        band = BANDS[k]
                    bands.append(band)
                    levels.append(level)
                    shares.append(in_english)
                    counts.append(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("d"), pa.array(bands, pa.string()), pa.array(levels, pa.float64()), pa.array(shares, pa.int64()), pa.array(counts, pa.int64())],
                    names=["d", "band", "level", "english_words", "words"],
                )

    source = docs.select(F.col(doc).alias("d"), F.col(text).cast("string").alias("t"))
    schema = f"d {source.schema['d'].dataType.simpleString()}, band string, level double, english_words bigint, words bigint"
    return source.mapInArrow(run, schema).withColumnRenamed("d", doc)
