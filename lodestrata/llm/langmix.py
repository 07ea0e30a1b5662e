"""Languages of documents and of the segments of mixed ones, by mixture inference.

A character n-gram model gives every sentence a likelihood in each language. A document is a
mixture: expectation-maximisation finds the proportions of its languages from the sentences'
likelihoods, and languages are admitted one by one while they raise the penalised likelihood.
Sentences then take the language of greatest posterior, documents the one of most words.

The model is a conditional trigram model over letters with word boundaries. A trigram that a
language hasn't shown falls back to the mean of all languages, so that names tell for none.
It is fitted on a bounded sample of labelled rows, whose wrong labels are replaced by the model's
own between rounds; everything else covers all rows. The languages are those of the sample's labels.

A text is of none of them if its letters or its likelihood lie below what the sample's texts of
its best language reach. A confidence is the share of words in sentences of the language times the
language's posterior over those sentences, with likelihoods tempered so that on held-out sentences
of the sample the posterior is as sure as it is right.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.arrow import CHARS_AT_ONCE, code_points, pieces

#: Codes and names by which the seven languages are declared.
NAMES = {
    "de": "de deu ger german deutsch",
    "en": "en eng english",
    "es": "es spa spanish español espanol castellano castilian",
    "fr": "fr fra fre french français francais",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands flemish vlaams",
    "pt": "pt por portuguese português portugues",
}
#: Nats a trigram by which a text may lie below its language's mean, beside the deviations of its length.
NONE_MARGIN, NONE_DEVIATIONS = 1.0, 4.0
#: Labelled rows a language gives to the fit, on average, and the longest text among them.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 20_000
#: Letters with a class of their own; with the space and all others there are 64 classes.
LETTERS = 62
BACKOFF = 3.0
#: Each language after the first must raise the log-likelihood by this times the log of the words.
PENALTY = 4.0
LEAST_PARAGRAPH = 15
ROUNDS = 3


def declared_language(column, names: dict[str, str] = NAMES):
    """The two-letter code that a declared language names, or null: codes of 2 or 3 letters with or without region, English and native names, in any case."""
    base = F.regexp_extract(F.lower(F.trim(column)), r"^(\p{L}+)(?:[-_ ].*|\s*\(.*)?$", 1)
    found = F.lit(None).cast("string")
    for code in sorted(names):
        found = F.when(base.isin(names[code].split()), code).otherwise(found)
    return found


def declares_another(column, language):
    """Whether the declared language names no language or another one than ``language``."""
    return ~F.coalesce(declared_language(column) == language, F.lit(False))


@cache
def _folded() -> np.ndarray:
    """Lower-case letter of each code point of the basic plane, 32 for what is no letter."""
    table = np.full(0x10000, 32, dtype=np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def fold(points: np.ndarray) -> np.ndarray:
    """Code points with letters in lower case and all else blank."""
    return _folded()[np.where(points < 0x10000, points, 0x10000 - 1)]


_SPACE = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)


def unit_starts(points: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Where sentences and lines start: after a line end, or a full stop, ! or ? before a blank."""
    ends = points == 10
    stop = (points == 46) | (points == 33) | (points == 63) | (points == 0x2026)
    ends[:-1] |= stop[:-1] & space[1:]
    starts = np.flatnonzero(ends) + 1
    return np.concatenate(([0], starts[starts < len(points)])).astype(np.int64)


class Model:
    """Trigram model of ``languages``.

    ``classes``: class of each code point of the basic plane, ``table``: log-probabilities, ``usual``:
    each language's mean and deviation of the log-probability of a trigram of its own texts,
    ``heat``: what likelihoods are divided by for a posterior.
    """

    def __init__(self, languages: list[str], classes: np.ndarray, table: np.ndarray, usual: np.ndarray | None = None, heat: float = 1.0):
        self.languages, self.classes, self.table, self.heat = list(languages), classes, table, heat
        self.usual = np.tile([-1e9, 0.0], (len(languages), 1)) if usual is None else usual

    def parts(self) -> tuple:
        return self.languages, self.classes, self.table, self.usual, self.heat

    def none_of_these(self, score: np.ndarray, trigrams: np.ndarray, strange: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Whether texts of a summed ``score`` over ``trigrams``, ``strange`` of which end in letters that the sample hardly has, are of no language of the model."""
        n = np.maximum(trigrams, 1)
        mean, deviation = self.usual[language].T
        return (score / n < mean - NONE_MARGIN - NONE_DEVIATIONS * deviation / np.sqrt(n)) | (2 * strange > trigrams)

    def posterior(self, scores: np.ndarray, language: int) -> float:
        """The tempered posterior of the language over the units of ``scores``."""
        total = scores.sum(0) / self.heat
        return float(1 / np.exp(np.minimum(total - total[language], 700)).sum())

    def trigrams(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the trigram that ends at each position kept, and those positions.

        Runs of blanks count as one; the mark between texts counts as another, so that every text
        starts after two blanks, whatever stands before it.
        """
        kinds = self.classes[np.where(points < 0x10000, points, 0xFFFF)]
        kept = kinds != 0
        kept[1:] |= kinds[:-1] != 0
        kept |= points == 0
        at = np.flatnonzero(kept)
        k = np.concatenate(([0, 0], kinds[at])).astype(np.int64)
        return (k[:-2] << 12) | (k[1:-1] << 6) | k[2:], at

    def scores(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log-likelihood (units x languages) of the units that start at ``starts``; many characters are worked on in parts."""
        out = np.zeros((len(starts), self.table.shape[1]))
        ends = np.append(starts[1:], len(points))
        first = 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + 2 * CHARS_AT_ONCE, side="right")))
            self._part(points, starts[first:last], int(ends[last - 1]), out[first:last])
            first = last
        return out

    def _part(self, points: np.ndarray, starts: np.ndarray, end: int, out: np.ndarray) -> None:
        before = max(int(starts[0]) - 16, 0)  # the letters that the first trigrams need
        index, at = self.trigrams(points[before:end])
        own = at >= starts[0] - before
        index, at = index[own], at[own]
        where = np.searchsorted(at, starts - before)
        full = np.flatnonzero(np.append(where[1:], len(at)) > where)
        step = 4 * CHARS_AT_ONCE
        if len(index) <= step:
            if len(full):
                out[full] = np.add.reduceat(self.table[index], where[full], axis=0)
            return
        for i, a, b in zip(full, where[full], np.append(where[full][1:], len(index)), strict=True):  # a unit without end
            for k in range(a, b, step):
                out[i] += self.table[index[k : min(k + step, b)]].sum(axis=0, dtype=np.float64)


def fit(texts: list[str], labels: list[str]) -> Model:
    """A model of the labels' languages from labelled texts. Labels may be wrong: sentences are labelled anew between rounds."""
    model, trained = _trained(texts, labels)
    if len(texts) >= 40:
        # The temper is found on sentences that a model of the other half hasn't seen.
        half, _ = _trained(texts[::2], labels[::2], model.languages)
        model.heat = _heat(half, texts[1::2], labels[1::2])
    points, starts, index_of, own = trained
    index, _ = index_of
    of = model.table[index, own]
    model.usual = np.array([(x.mean(), x.std()) if len(x := of[own == k]) else (-1e9, 0.0) for k in range(len(model.languages))])
    return model


def _heat(model: Model, texts: list[str], labels: list[str]) -> float:
    """The divisor of log-likelihoods under which the labels of unseen sentences are likeliest, some of them being wrong whatever the text."""
    points = code_points(texts)
    space = np.isin(points, _SPACE)
    starts = unit_starts(points, space)
    scores = model.scores(points, starts)
    text_of = np.minimum(np.searchsorted(np.cumsum([len(t) + 3 for t in texts]), starts, side="right"), len(texts) - 1)
    own = np.array([model.languages.index(x) for x in labels])[text_of]
    used = scores.any(axis=1)
    scores, own = scores[used], own[used]
    best = (-np.inf, 1.0)
    for heat in np.geomspace(1, 64, 25):
        z = scores / heat
        z -= z.max(1, keepdims=True)
        right = np.exp(z[np.arange(len(z)), own]) / np.exp(z).sum(1)
        for wrong in (0.01, 0.03, 0.1, 0.2, 0.3):
            best = max(best, (float(np.log((1 - wrong) * right + wrong / scores.shape[1]).sum()), float(heat)))
    return best[1]


def _trained(texts: list[str], labels: list[str], languages: list[str] | None = None) -> tuple[Model, tuple]:
    languages = languages or sorted(set(labels))
    points = code_points(texts)
    letters = fold(points)
    found, counts = np.unique(letters[letters != 32], return_counts=True)
    classes = np.where(_folded() == 32, 0, LETTERS + 1).astype(np.uint8)
    for i, letter in enumerate(found[np.argsort(-counts, kind="stable")][:LETTERS]):
        classes[_folded() == letter] = i + 1
    model = Model(languages, classes, np.zeros((1 << 18, len(languages)), dtype=np.float32))
    space = np.isin(points, _SPACE)
    starts = unit_starts(points, space)
    text_of = np.searchsorted(np.cumsum([len(t) + 3 for t in texts]), starts, side="right")
    own = np.array([languages.index(x) for x in labels], dtype=np.int64)[np.minimum(text_of, len(texts) - 1)] if texts else np.zeros(len(starts), dtype=np.int64)
    index, at = model.trigrams(points)
    unit_of = np.searchsorted(starts, at, side="right") - 1
    size = len(languages)
    for _ in range(ROUNDS if texts else 0):
        n3 = np.bincount(index * size + own[unit_of], minlength=size << 18).reshape(-1, size).astype(np.float64)
        n2 = np.repeat(n3.reshape(-1, 64, size).sum(1), 64, axis=0)
        even = (n3 / np.maximum(n3.sum(0), 1)).mean(1) * len(index)
        pair = even.reshape(64, 4096).sum(0)
        two = (pair + 1e-3) / (np.repeat(pair.reshape(64, 64).sum(1), 64) + 64e-3)
        three = (even + np.tile(two, 64)) / (np.repeat(even.reshape(-1, 64).sum(1), 64) + 1)
        model.table = np.log((n3 + BACKOFF * three[:, None]) / (n2 + BACKOFF)).astype(np.float32)
        model.table.reshape(64, 4096, size)[:, 0] = 0  # two blanks in a row tell nothing
        scores = model.scores(points, starts)
        # A text's sentences follow the text unless they speak clearly for another language.
        whole = np.zeros((len(texts), size))
        np.add.at(whole, np.minimum(text_of, len(texts) - 1), scores)
        best = whole.argmax(1)[np.minimum(text_of, len(texts) - 1)]
        clear = scores.max(1) - scores[np.arange(len(scores)), best] > 10
        own = np.where(clear, scores.argmax(1), best)
    return model, (points, starts, (index, at), own[unit_of])


def sample(df: DataFrame, key: str, text: str, label, rows: int = SAMPLE_ROWS) -> tuple[list[str], list[str]]:
    """About ``rows`` texts and labels of each language, chosen by a hash of the key; label: a column of codes."""
    labelled = df.select(F.col(text).alias("t"), label.alias("l"), F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_003)).alias("h")).where(
        F.col("l").isNotNull() & (F.length("t") >= 80) & (F.length("t") <= SAMPLE_CHARS)
    )
    there = {r["l"]: r["count"] for r in labelled.groupBy("l").count().collect()}
    share = F.lit(0)
    for code, n in there.items():
        share = F.when(F.col("l") == code, min(1_000_003, int(1_000_003 * rows / n) + 1)).otherwise(share)
    chosen = labelled.where(F.col("h") < share).select("t", "l").toPandas()
    return chosen["t"].tolist(), chosen["l"].tolist()


def mixture(scores: np.ndarray, words: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Languages of one document's units, and the posterior of each, by EM over growing language sets.

    scores: log-likelihoods (units x languages). The set starts with the language of the greatest
    likelihood; the one that raises the mixture's likelihood most is added while that pays for
    ``penalty`` times the log of the number of words.
    """
    chosen = [int(scores.sum(0).argmax())]
    price = penalty * np.log(max(words.sum(), 2))

    def run(members: list[int]) -> tuple[float, np.ndarray]:
        part = scores[:, members]
        share, before = np.full(len(members), 1 / len(members)), np.zeros(len(members))
        while np.abs(share - before).max() > 1e-4:
            before = share
            joint = part + np.log(np.maximum(share, 1e-9))
            top = joint.max(1, keepdims=True)
            odds = np.exp(joint - top)
            total = odds.sum(1, keepdims=True)
            odds /= total
            share = (odds * words[:, None]).sum(0) + 1e-3
            share /= share.sum()
        return float((top + np.log(total)).sum()), odds

    value, odds = run(chosen)
    while len(chosen) < scores.shape[1]:
        best = scores[:, chosen].max(1)
        gains = np.maximum(scores - best[:, None], 0).sum(0)
        gains[chosen] = -1
        members = [*chosen, int(gains.argmax())]
        if gains.max() < price:
            break
        new, new_odds = run(members)
        if new - value < price:
            break
        chosen, value, odds = members, new, new_odds
    return np.array(chosen)[odds.argmax(1)], odds.max(1)


_BREAK = re.compile(r"\n\s*\n")


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Spans of the parts between blank lines that hold anything."""
    spans, start = [], 0
    for m in _BREAK.finditer(text):
        spans.append((start, m.start()))
        start = m.end()
    spans.append((start, len(text)))
    return [(a, b) for a, b in spans if text[a:b].strip()]


def words_in(texts: list[str], model: Model, language: int) -> list[tuple[int, int]]:
    """For each text its blank-separated words, and how many of them stand in sentences of the language."""
    out = []
    points = code_points(texts)
    space = np.isin(points, _SPACE)
    starts = unit_starts(points, space)
    scores = model.scores(points, starts)
    words = _words(points, space, starts)
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(t) + 3 for t in texts])[:-1])))
    last = np.append(first[1:], len(starts))
    whole = np.add.reduceat(scores, first, axis=0)
    bound = np.add.reduceat(scores.max(1), first) - whole.max(1)
    for i, (a, b) in enumerate(zip(first, last, strict=True)):
        n = int(words[a:b].sum())
        if not n or not whole[i].any():
            out.append((n, 0))
        elif bound[i] < PENALTY * np.log(max(n, 2)):  # no second language can pay
            out.append((n, n if whole[i].argmax() == language else 0))
        else:
            labels, _ = mixture(scores[a:b], words[a:b])
            out.append((n, int(words[a:b][labels == language].sum())))
    return out


def _words(points: np.ndarray, space: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Blank-separated words of each unit."""
    begins = ~space & (points != 0)
    begins[1:] &= space[:-1] | (points[:-1] == 0)
    return np.add.reduceat(begins.astype(np.int64), starts)


def label_texts(texts: list[str], model: Model) -> list[list[tuple[int, str | None, float, int]]]:
    """For each text its ``(segment, language, confidence, words)``; segment 0 is the whole.

    Segments follow only where the paragraphs of at least ``LEAST_PARAGRAPH`` words are not all of
    one language: one for each such paragraph, by its position among all paragraphs. A text
    without words, or of none of the model's languages, has no language and confidence 0.
    """
    names, size = model.languages, len(model.languages)
    points = code_points(texts)
    space = np.isin(points, _SPACE)
    starts = unit_starts(points, space)
    scores = model.scores(points, starts)
    words = _words(points, space, starts)
    first = np.concatenate(([0], np.cumsum([len(t) + 3 for t in texts])[:-1]))
    unit_first = np.searchsorted(starts, first)
    if not size:
        return [[(0, None, 0.0, int(n))] for n in np.add.reduceat(words, unit_first)]
    whole = np.add.reduceat(scores, unit_first, axis=0)
    total = np.add.reduceat(words, unit_first)
    best = whole.argmax(1)
    bound = np.add.reduceat(scores.max(1), unit_first) - whole.max(1)
    kinds = model.classes[np.where(points < 0x10000, points, 0xFFFF)]
    letters, strange = np.add.reduceat((kinds != 0).astype(np.int64), first), np.add.reduceat((kinds == LETTERS + 1).astype(np.int64), first)
    out = []
    unit_last = np.append(unit_first[1:], len(starts))

    def sure(own: np.ndarray, weight: np.ndarray, language: np.ndarray, k: int) -> float:
        """Share of the words in units of language ``k`` times its posterior over them."""
        mine = language == k
        return float(weight[mine].sum() / max(weight.sum(), 1)) * model.posterior(own[mine], k)

    for i, text in enumerate(texts):
        n, a, b = int(total[i]), unit_first[i], unit_last[i]
        if not n or not whole[i].any():
            out.append([(0, None, 0.0, n)])
            continue
        if bound[i] < PENALTY * np.log(max(n, 2)):
            language = np.full(b - a, best[i])
        else:
            language, _ = mixture(scores[a:b], words[a:b])
        if model.none_of_these(scores[a:b].max(1).sum()[None], letters[i : i + 1], strange[i : i + 1], best[i : i + 1])[0]:
            out.append([(0, None, 0.0, n)])
            continue
        main = int(np.bincount(language, words[a:b], minlength=size).argmax())
        rows = [(0, names[main], sure(scores[a:b], words[a:b], language, main), n)]
        if (language != language[0]).any():
            segments = []
            for k, (x, y) in enumerate(paragraphs(text), 1):
                w = len(text[x:y].split())
                if w >= LEAST_PARAGRAPH:
                    lo, hi = np.searchsorted(starts[a:b], (first[i] + x + 1, first[i] + y), side="left")
                    lo = max(lo - 1, 0)
                    part = int(np.bincount(language[lo:hi], words[a:b][lo:hi], minlength=size).argmax())
                    segments.append((k, names[part], sure(scores[a:b][lo:hi], words[a:b][lo:hi], language[lo:hi], part), w))
            if len({s[1] for s in segments}) > 1:
                rows += segments
        out.append(rows)
    return out


def assign_languages(df: DataFrame, model: Model, keep: list[str], text: str) -> DataFrame:
    """``keep, seg, lang, confidence, words`` of each row's text; see ``label_texts``.

    Every row gives a row with seg 0, also a null or blank text (language null, confidence 0).
    Repeated rows are labelled each for itself. An empty table gives no rows; other columns
    are not read. There is no shuffle; the model (about 8 MB, whatever the data) is broadcast.
    """
    held = df.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for batch in batches:
            for part, texts in pieces(batch, "_text"):
                rows = label_texts(texts, own)
                of = pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
                flat = [x for r in rows for x in r]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c).take(of) for c in range(len(keep))],
                        pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.string()),
                        pa.array([x[2] for x in flat], pa.float64()), pa.array([x[3] for x in flat], pa.int64()),
                    ],
                    names=[*keep, "seg", "lang", "confidence", "words"],
                )

    source = df.select(*keep, df[text].cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{schema}, seg int, lang string, confidence double, words bigint")
