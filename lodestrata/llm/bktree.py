"""Mapping of freely typed values to the entries of a reference list.

An entry is the bag of a label's telling words. Bags are compared by a true metric: the cheapest
assignment of the words of one to those of the other, where a pair of words costs its Levenshtein
distance and a word left alone its length. The entries stand in BK-trees under that metric, one for
each shard of the reference; by the triangle inequality only children at edges within the radius of
a value's distance to their parent are visited, so every entry within the radius comes back. Of
those the one is named that fits best word by word; entries that name no valid target compete too,
so that a value nearer to one of them isn't mapped to its neighbour.
"""

from __future__ import annotations

import itertools
import pickle
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.storage import cut, cut_counted

#: Labels of one shard, and typed values that one task looks up in it at a time.
SHARD_LABELS, SLICE_VALUES = 20_000, 4_000
#: Edits in all, as a share of the letters of a value, and at most.
SHARE_OF_LETTERS, MOST_EDITS = 0.25, 4
#: What a plural s counts; three of them are more than any one edit.
PLURAL = 0.4
#: Words around a skill, from the grammar of each language: articles and prepositions,
#: words of degree, of knowledge and use, of need, of duration. A caller may pass other words.
FRAME = {
    "en": "a an the of in on at for with and or to by from as | some very good great strong strongly basic solid sound nice deep thorough advanced excellent proven practical previous ideally level plus "
    "| experience experienced knowledge know knowhow how skill skills skilled able ability capable competence competent understanding familiar familiarity proficient proficiency expert expertise working handson hands use used using have having has demonstrated practice certified certificate "
    "| must be should required preferred desirable you your | yr yrs year years",
    "de": "mit in der die das und oder für | gut gute guter sehr | erfahrung kenntnisse kenntnis haben bereits eingesetzt sicherer umgang | sie",
    "fr": "avec de du des en et ou la le les | bon bonne très | expérience connaissance connaissances avez déjà utilisé maîtrise | vous",
    "es": "con de del en y la el | buen buena muy | experiencia conocimiento conocimientos has utilizado dominio | ya",
    "it": "con di del della in e la il | buon buona molto | esperienza conoscenza hai utilizzato usato già | padronanza",
    "pt": "com de do da em e o | bom boa muito | experiência conhecimento conhecimentos utilizou utilizado domínio | já",
    "nl": "met van in en de het een | goed goede zeer | ervaring kennis hebt gebruikt eerder beheersing | je",
}
_WORD = re.compile(r"[^\W_]+(?:[+#]+(?![^\W_])|\.+(?=$|[\W_]))?")
_NUMBER = re.compile(r"\d+(?:\.\d+)*\+?")


def frame_words(languages: Iterable[str] = FRAME) -> frozenset[str]:
    """The words around a skill of the languages named."""
    return frozenset(w for code in languages for w in FRAME[code].split() if w != "|")


@lru_cache(200_000)
def words_of(text: str) -> tuple[tuple[str, bool], ...]:
    """Words of a label or value, each with whether a full stop cuts it short; numbers are left out."""
    bare = _NUMBER.sub(" ", unicodedata.normalize("NFKC", text).casefold())
    found = [(w.rstrip("."), w.endswith(".")) for w in _WORD.findall(bare)]
    return tuple((w, short) for w, short in found if w)


def allowed(word: str) -> int:
    """Edits that a typed word may be away from the one meant, an exchange of neighbours being one."""
    n = len(word)
    return 0 if n < 3 else 1 if n < 5 else 2


def most_edits(bag: tuple[str, ...]) -> int:
    """Edits that a typed bag of words may be away from the entry meant."""
    return min(MOST_EDITS, int(0.7 + SHARE_OF_LETTERS * sum(map(len, bag))))


def radius(bag: tuple[str, ...]) -> int:
    """Distance within which the entries of a bag are looked up: an exchange, one edit, is two in the metric, and a plural s one more."""
    return min(MOST_EDITS, 2 * most_edits(bag)) + 1


@lru_cache(100_000)
def edits(a: str, b: str) -> float:
    """Insertions, deletions, replacements and exchanges of neighbours from ``a`` to ``b``.

    A replacement by one certain letter is rarer than a letter left out or doubled, so it counts a
    little more: it decides between entries that are equally near. A plural s alone counts less.
    """
    before, row = [], [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [float(i)]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (1.05 if x != y else 0))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    ends = [w.endswith("s") and len(w) > 3 for w in (a, b)]
    if ends[0] != ends[1]:  # row[-2]: without the last letter of b, before[-1]: without that of a
        return min(row[-1], (row[-2] if ends[1] else before[-1]) + PLURAL)
    return row[-1]


def levenshtein(left: Words, a: np.ndarray, right: Words, b: np.ndarray) -> np.ndarray:
    """Distances of the pairs of left words ``a`` and right words ``b``.

    The columns of the edit table are held as bits of their differences, so a letter of the right
    word takes a few operations for all pairs at once; left words of more than 64 letters take the table itself.
    """
    out = np.empty(len(a), dtype=np.int32)
    long = left.sizes[a] > 64
    for i in np.flatnonzero(long):
        out[i] = _table(left.letters[a[i], : left.sizes[a[i]]], right.letters[b[i], : right.sizes[b[i]]])
    short = np.flatnonzero(~long)
    short = short[np.argsort(-right.sizes[b[short]], kind="stable")]
    a, b = a[short], b[short]
    alphabet = np.unique(left.letters)
    masks = np.zeros((len(left.words), len(alphabet) + 1), dtype=np.uint64)
    rows = np.flatnonzero(left.sizes <= 64)
    for i in range(min(left.letters.shape[1], 64)):
        own = rows[left.sizes[rows] > i]
        masks[own, np.searchsorted(alphabet, left.letters[own, i])] |= np.uint64(1 << i)
    place = np.minimum(np.searchsorted(alphabet, right.letters), len(alphabet) - 1)
    codes = np.where(alphabet[place] == right.letters, place, len(alphabet))
    sizes = right.sizes[b]
    score = left.sizes[a].astype(np.int32)
    one = np.uint64(1)
    top = one << (np.maximum(score, 1) - 1).astype(np.uint64)
    plus, minus = np.full(len(a), ~np.uint64(0)), np.zeros(len(a), dtype=np.uint64)
    for t in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(-sizes, -t, side="left"))  # pairs whose right word has more than t letters
        p, m = plus[:n], minus[:n]
        same = masks[a[:n], codes[b[:n], t]]
        diagonal = (((same & p) + p) ^ p) | same | m
        up, down = m | ~(diagonal | p), p & diagonal
        score[:n] += ((up & top[:n]) != 0).astype(np.int32) - ((down & top[:n]) != 0)
        up = (up << one) | one
        plus[:n], minus[:n] = (down << one) | ~(diagonal | up), up & diagonal
    out[short] = np.where(left.sizes[a] > 0, score, sizes)
    return out


def _table(a: np.ndarray, b: np.ndarray) -> int:
    place = np.arange(len(b) + 1)
    row = place
    for i, x in enumerate(a, 1):
        new = np.concatenate(([i], np.minimum(row[:-1] + (b != x), row[1:] + 1)))
        # Insertions along the row: a running minimum of value minus place.
        row = np.minimum.accumulate(new - place) + place
    return int(row[-1])


def _pad(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    out = np.zeros((len(words), max(int(sizes.max(initial=1)), 1)), dtype=np.uint32)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return out, sizes


def assignment(costs: np.ndarray) -> np.ndarray:
    """The least sum of a one-to-one assignment in each of many square tables (tables x n x n)."""
    n = costs.shape[1]
    if n == 1:
        return costs[:, 0, 0]
    if n <= 3:
        return np.min([sum(costs[:, i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(n))], axis=0)
    if n <= 10:  # over the sets of columns taken by the first rows
        best = {0: np.zeros(len(costs), dtype=costs.dtype)}
        for i in range(n):
            grown: dict[int, np.ndarray] = {}
            for taken, value in best.items():
                for j in range(n):
                    if not taken >> j & 1:
                        new, key = value + costs[:, i, j], taken | 1 << j
                        grown[key] = np.minimum(grown[key], new) if key in grown else new
            best = grown
        return best[(1 << n) - 1]
    return np.array([_cheapest(table.tolist()) for table in costs], dtype=costs.dtype)


def _cheapest(costs: list[list[int]]) -> int:
    """The least sum of one square table by shortest augmenting paths with potentials."""
    n = len(costs)
    u, v, owner = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, via, done = [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while owner[at]:
            done[at] = True
            step, following = float("inf"), 0
            for j in range(1, n + 1):
                if not done[j]:
                    slack = costs[owner[at] - 1][j - 1] - u[owner[at]] - v[j]
                    if slack < least[j]:
                        least[j], via[j] = slack, at
                    if least[j] < step:
                        step, following = least[j], j
            for j in range(n + 1):
                if done[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = following
        while at:
            owner[at] = owner[via[at]]
            at = via[at]
    return int(sum(costs[owner[j] - 1][j - 1] for j in range(1, n + 1)))


class Words:
    """Words as padded letters, and bags of them as rows of word numbers; the number after the last is no word."""

    def __init__(self, bags: list[tuple[str, ...]]):
        self.words = sorted({w for bag in bags for w in bag})
        self.number = {w: i for i, w in enumerate(self.words)}
        self.letters, self.sizes = _pad(self.words)
        self.counts = np.array([len(b) for b in bags], dtype=np.int64)
        self.bags = np.full((len(bags), int(self.counts.max(initial=1))), len(self.words), dtype=np.int64)
        for i, bag in enumerate(bags):
            self.bags[i, : len(bag)] = [self.number[w] for w in bag]


class Distances:
    """Distances between the bags of two sets of words; those between words are worked out when first needed."""

    def __init__(self, left: Words, right: Words):
        self.left, self.right = left, right
        n, m = len(left.words), len(right.words)
        self.known = np.full((n + 1, m + 1), -1, dtype=np.int32)
        self.known[n, :m], self.known[:n, m], self.known[n, m] = right.sizes, left.sizes, 0

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of the pairs of left bags ``a`` and right bags ``b``."""
        out = np.zeros(len(a), dtype=np.int32)
        size = np.maximum(self.left.counts[a], self.right.counts[b])
        for n in np.unique(size):
            for which in np.array_split(np.flatnonzero(size == n), (size == n).sum() * n * n // 2_000_000 + 1):
                out[which] = self._of(a[which], b[which], int(n))
        return out

    def _of(self, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        def padded(bags: np.ndarray, rows: np.ndarray, none: int) -> np.ndarray:
            own = bags[rows, :n]
            return own if own.shape[1] == n else np.pad(own, ((0, 0), (0, n - own.shape[1])), constant_values=none)

        x = padded(self.left.bags, a, len(self.left.words))
        y = padded(self.right.bags, b, len(self.right.words))
        at = (x[:, :, None] * self.known.shape[1] + y[:, None, :]).reshape(-1)
        flat = self.known.reshape(-1)
        new = np.unique(at[flat[at] < 0])
        for part in np.array_split(new, len(new) // 50_000 + 1):
            p, q = part // self.known.shape[1], part % self.known.shape[1]
            flat[part] = levenshtein(self.left, p, self.right, q)
        return assignment(flat[at].reshape(-1, n, n))


class Tree:
    """BK-tree of distinct bags of words; children are kept sorted by parent and edge."""

    SPAN = 1 << 31  # more than any distance

    def __init__(self, bags: list[tuple[str, ...]]):
        order = np.random.default_rng(7).permutation(len(bags))
        self.bags = [bags[i] for i in order]
        self.held = Words(self.bags)
        edges = []
        groups = [(0, np.arange(1, len(bags)))] if bags else []
        while groups:
            root, rest = groups.pop()
            if not len(rest):
                continue
            one = Distances(Words([self.bags[root]]), self.held)
            d = one.of(np.zeros(len(rest), dtype=np.int64), rest)
            order = np.argsort(d, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(d[order])) + 1):
                child = int(rest[part[0]])
                edges.append((root * self.SPAN + int(d[part[0]]), child))
                groups.append((child, rest[part[1:]]))
        edges.sort()
        self.keys = np.array([k for k, _ in edges], dtype=np.int64)
        self.children = np.array([c for _, c in edges], dtype=np.int64)

    def within(self, queries: list[tuple[str, ...]], reach: list[int]) -> list[list[tuple[int, int]]]:
        """For each bag all ``(entry, distance)`` within its reach."""
        found: list[list[tuple[int, int]]] = [[] for _ in queries]
        if not self.bags:
            return found
        step = max(50, min(2000, 8_000_000 // (3 * len(self.held.words))))
        for start in range(0, len(queries), step):
            part = queries[start : start + step]
            between = Distances(Words(part), self.held)
            r = np.array(reach[start : start + step], dtype=np.int64)
            q, node = np.arange(len(part)), np.zeros(len(part), dtype=np.int64)
            while len(q):
                d = between.of(q, node).astype(np.int64)
                for i in np.flatnonzero(d <= r[q]):
                    found[start + q[i]].append((int(node[i]), int(d[i])))
                low = np.searchsorted(self.keys, node * self.SPAN + np.maximum(d - r[q], 0))
                high = np.searchsorted(self.keys, node * self.SPAN + d + r[q], side="right")
                n = high - low
                which = np.repeat(np.arange(len(q)), n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]
                q, node = q[which], self.children[at]
        return found


class Reference:
    """A shard of labels with their targets (None: names nothing valid) and the tree of their bags."""

    def __init__(self, entries: list[tuple[str, str | None, int]], free: Iterable[str] = (), frame: Iterable[str] = ()):
        """entries: (label, target, rank); of labels equally near, those of lower rank win, then lower targets. free, frame: words that add nothing to a label."""
        self.free = frozenset(free) | frozenset(frame)
        self.free |= {w[:-1] for w in self.free if len(w) > 2 and w.endswith("s")}
        self.sorted_free = sorted(self.free)
        by_bag = defaultdict(set)
        for label, target, rank in entries:
            words = tuple(sorted(w for w, _ in words_of(label)))
            if words:
                by_bag[self.core(words)].add((words, rank, target))
        bags = sorted(by_bag)
        self.tree = Tree(bags)
        self.labels = [sorted(by_bag[b], key=lambda e: (e[0], e[1], e[2] or "")) for b in self.tree.bags]
        self.exact = {b: i for i, b in enumerate(self.tree.bags)}
        self.vocabulary = self.tree.held.words
        self.holders = defaultdict(list)
        for i, bag in enumerate(self.tree.bags):
            for w in set(bag):
                self.holders[w].append(i)
        self.word_tree = Tree([(w,) for w in self.vocabulary])
        self.free_tree = Tree([(w,) for w in sorted(self.free)])
        self.near: dict[str, tuple[float, float]] = {}
        self.lengths = {len(b) for b in bags}
        self.longest = max((len(w) for w in [*self.vocabulary, *self.free]), default=0) + MOST_EDITS

    def possible(self, bag: tuple[str, ...]) -> bool:
        """Whether any entry has as many words as the bag and a word as long as its longest."""
        return len(bag) in self.lengths and max(map(len, bag)) <= self.longest

    def core(self, words: Iterable[str]) -> tuple[str, ...]:
        """The words that tell, sorted; all words if none does."""
        words = list(words)
        return tuple(sorted([w for w in words if w not in self.free] or words))

    def _look_near(self, words: list[str]) -> None:
        """For each word the least edits to a free word and to a word of the entries, if within what is allowed."""
        new = [w for w in words if w not in self.near and len(w) <= self.longest]
        sides = []
        for tree in (self.free_tree, self.word_tree):
            found = tree.within([(w,) for w in new], [2 * allowed(w) for w in new])
            sides.append([min((c for i, _ in own if (c := edits(w, tree.bags[i][0])) <= allowed(min(w, tree.bags[i][0], key=len)) + 0.2), default=9.0) for w, own in zip(new, found, strict=True)])
        self.near.update(zip(new, zip(*sides, strict=True), strict=True))

    def variants(self, words: tuple[tuple[str, bool], ...]) -> list[tuple[tuple[str, ...], float]]:
        """Bags that a value's words may mean, each with what it costs to read them so.

        A misspelt free word is left out; where it is like a word of the entries too, it is kept if
        that is nearer, else with and without it are tried. A word that a full stop cuts
        short may stand for the words of an entry that it begins.
        """
        kept, doubtful, cost = [], [], 0.0
        for w, short in words:
            if w in self.free:
                continue
            to_free, to_word = self.near.get(w, (9.0, 0.0))
            short = short and len(w) >= 3
            if short and self._begins(self.vocabulary, w):
                to_word = min(to_word, 0.5)
            if to_free < to_word == 9:
                cost += to_free
            elif to_free <= to_word < 9:
                doubtful.append((w, short, to_free))
            elif short and self._begins(self.sorted_free, w):
                doubtful.append((w, short, 0.5))
            else:
                kept.append((w, short))
        if len(kept) > max(self.lengths, default=0):
            return []
        if not kept and not doubtful:
            return [(tuple(sorted(w for w, _ in words)), 0.0)]
        readings = [(kept + [d[:2] for d in doubtful], cost)]
        if doubtful and kept:
            readings.append((kept, cost + sum(d[2] for d in doubtful)))
        out = []
        for own, price in readings:
            out.append((tuple(sorted(w for w, _ in own)), price))
            cuts = [w for w, short in own if short]
            if cuts:
                whole = [w for w, short in own if not short]
                out += [(tuple(sorted([*whole, *x])), price + 0.5 * sum(a != b for a, b in zip(cuts, x, strict=True))) for x in self._completions(cuts)]
        return out

    @staticmethod
    def _begins(words: list[str], start: str) -> list[str]:
        """Those of the sorted ``words`` that begin with ``start``."""
        at = end = bisect_left(words, start)
        while end < len(words) and words[end].startswith(start):
            end += 1
        return words[at:end]

    def _completions(self, cuts: list[str]) -> set[tuple[str, ...]]:
        """For each entry that has words beginning with all the ``cuts``, those words."""
        ranges = [self._begins(self.vocabulary, c) for c in cuts]
        found = set()
        for entry in {e for w in min(ranges, key=len) for e in self.holders[w]}:
            bag = set(self.tree.bags[entry])
            found.update(itertools.product(*[[w for w in own if w in bag] for own in ranges]))
        return found

    def best(self, values: list[str]) -> list[tuple[float, int, str] | None]:
        """For each value ``(cost, rank, target)`` of the label it names, target '' if that names nothing valid; None if it names no label."""
        split = [words_of(v) for v in values]
        known = self.tree.held.number
        self._look_near(sorted({w for own in split for w, _ in own if w not in self.free and w not in known and w not in self.near}))
        readings = [self.variants(own) if own else [] for own in split]
        bags = sorted({bag for own in readings for bag, _ in own if bag not in self.exact and self.possible(bag)})
        hits: dict[tuple[str, ...], list[tuple[int, float]]] = {}
        # One edit is within 2 of the metric; whatever is not found there within one edit takes the whole radius.
        for limit in (2, MOST_EDITS + 1):
            asked = [b for b in bags if b not in hits]
            for bag, near in zip(asked, self.tree.within(asked, [min(limit, radius(b)) for b in asked]), strict=True):
                fits = [(i, c) for i, _ in near if (c := self.fit(bag, self.tree.bags[i])) is not None]
                if limit > MOST_EDITS or radius(bag) <= limit or (fits and min(c for _, c in fits) < 3 * PLURAL):
                    hits[bag] = fits
        out = []
        for own, mine in zip(split, readings, strict=True):
            bare = Counter(w for w, _ in own)
            best = None
            for bag, price in mine:
                for entry, cost in [(self.exact[bag], 0.0)] if bag in self.exact else hits.get(bag, ()):
                    for words, rank, target in self.labels[entry]:
                        label = Counter(words)
                        rated = (round(cost + price + 0.01 * ((bare - label).total() + (label - bare).total()), 6), not target, rank, target or "")
                        if best is None or rated < best:
                            best = rated
            out.append(best and (best[0], best[2], best[3]))
        return out

    @staticmethod
    def fit(bag: tuple[str, ...], entry: tuple[str, ...]) -> float | None:
        """Edits from the bag to the entry if every word has its partner within what is allowed, else None."""
        if len(bag) != len(entry):
            return None
        left, right = Counter(bag), Counter(entry)
        own, other = list((left - right).elements()), list((right - left).elements())
        table = [[edits(a, b) if abs(len(a) - len(b)) <= 3 else 99.0 for b in other] for a in own]
        table = [[c if c <= 1.05 * allowed(min(a, b, key=len)) + PLURAL else 99.0 for b, c in zip(other, row, strict=True)] for a, row in zip(own, table, strict=True)]
        if any(min(row) > 90 for row in table):
            return None
        cost = float(assignment(np.array([table]))[0]) if len(own) <= 10 else _cheapest([[round(20 * c) for c in row] for row in table]) / 20
        return cost if cost <= 1.05 * most_edits(bag) + PLURAL else None


def free_words(labels: DataFrame) -> DataFrame:
    """``(word)``: words that a longer label has more than a shorter one of the same target, and that are no label by themselves.

    labels: ``(target, words)``. Shorter labels meet longer ones of their target on their longest
    word, so only labels that share it are compared.
    """
    rows = labels.where(F.col("target").isNotNull()).select("target", F.array_sort(F.array_distinct("words")).alias("words")).distinct()
    longest = F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    short = rows.select("target", longest.alias("key"), F.col("words").alias("few"))
    long = rows.select("target", F.explode("words").alias("key"), F.col("words").alias("many"))
    more = short.join(long, ["target", "key"]).where((F.size("few") < F.size("many")) & (F.size(F.array_except("few", "many")) == 0))
    alone = labels.where(F.size("words") == 1).select(F.col("words")[0].alias("word")).distinct()
    return more.select(F.explode(F.array_except("many", "few")).alias("word")).distinct().join(alone, "word", "left_anti")


def _split_words(labels: DataFrame) -> DataFrame:
    """``labels`` with their ``words``; those without any are left out."""

    def run(batches):
        for batch in batches:
            words = pa.array([[w for w, _ in words_of(t)] for t in batch.column("label").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, words], names=[*batch.schema.names, "words"])

    return labels.mapInArrow(run, "label string, target string, rank int, words array<string>").where(F.size("words") > 0)


_trees: dict[str, Reference] = {}


def map_values(
    df: DataFrame, keep: list[str], value: str, reference: DataFrame, unmatched: str = "unmatched",
    frame: Iterable[str] | None = None, shard_labels: int = SHARD_LABELS,
) -> DataFrame:
    """``keep`` with ``target`` and ``cost`` for each row whose ``value`` is neither null nor blank.

    reference: ``(label, target, rank)``; a null target marks labels that name nothing valid, a
    label that is null or has no word is none. ``target`` is ``unmatched`` (cost null) if the
    value names no label or one without target. Repeated rows are each mapped; an empty reference
    matches nothing; columns not named are not read. frame: words that add nothing (``FRAME``).

    Neither labels nor values come to the driver. The reference is split by a hash of the label
    into shards of about ``shard_labels``, whose trees are built once, each by a task, and written.
    Distinct values are cut into slices; every slice meets every shard, the shards' winners are
    merged by value, and the rows join them. Words that add nothing are found over the whole
    reference, so results don't depend on the shards.
    """
    frame = frame_words() if frame is None else frozenset(frame)
    labels, count = cut_counted(_split_words(reference.select(F.col("label").cast("string"), F.col("target").cast("string"), F.coalesce(F.col("rank").cast("int"), F.lit(0)).alias("rank")).where("label IS NOT NULL").distinct()), "labels")
    shards = max(1, -(-count // shard_labels))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    rows = labels.select(F.pmod(F.xxhash64("label"), F.lit(shards)).cast("int").alias("shard"), "label", "target", "rank").unionByName(
        free_words(labels).select(every, F.col("word").alias("label"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("int").alias("rank"))
    )

    def build(table: pa.Table) -> pa.Table:
        own = list(zip(*(table.column(c).to_pylist() for c in ("label", "target", "rank")), strict=True))
        tree = Reference([e for e in own if e[2] is not None], [e[0] for e in own if e[2] is None], frame)
        return pa.table({"shard": table.column("shard")[:1].cast(pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    trees = cut(rows.groupBy("shard").applyInArrow(build, "shard int, tree binary"), "trees")

    source = df.select(*keep, df[value].cast("string").alias("_value")).where(~F.col("_value").rlike(r"(?U)^\s*$"))
    # Values that differ in case, digits or signs only come to the same slice and are looked up once.
    alike = F.lower(F.regexp_replace("_value", r"[^\p{L}]+", " "))
    values, distinct = cut_counted(source.select("_value").distinct(), "values")
    slices = max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-distinct // SLICE_VALUES))
    tasks = max(1, min(slices * shards, 4 * df.sparkSession.sparkContext.defaultParallelism))
    asked = values.select("_value", F.pmod(F.xxhash64(alike), F.lit(slices)).cast("int").alias("slice"), every).repartition(tasks, "shard", "slice")
    held = trees.select("shard", "tree", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")).repartition(tasks, "shard", "slice")
    token = trees._cut_path

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.column("_value").to_pylist()
        won: list = []
        if own and right.num_rows:
            name = f"{token}:{key[0].as_py()}"
            if name not in _trees:
                _trees.clear()
                _trees[name] = pickle.loads(right.column("tree")[0].as_py())
            won = _trees[name].best(own)
        won = won or [None] * len(own)
        return pa.table({
            "_value": pa.array(own, pa.string()), "_cost": pa.array([w and w[0] for w in won], pa.float64()),
            "_rank": pa.array([w and w[1] for w in won], pa.int32()), "_target": pa.array([w and w[2] for w in won], pa.string()),
        })

    found = asked.groupBy("shard", "slice").cogroup(held.groupBy("shard", "slice")).applyInArrow(search, "_value string, _cost double, _rank int, _target string")
    order = F.struct(F.col("_cost"), F.col("_target") == "", F.col("_rank"), F.col("_target"))
    won = cut(found.where("_cost IS NOT NULL").groupBy("_value").agg(F.min(order).alias("w")).select("_value", F.col("w._cost").alias("_cost"), F.col("w._target").alias("_target")).where("_target <> ''"), "winners")
    joined = source.join(won, "_value", "left")
    return joined.select(*keep, F.coalesce("_target", F.lit(unmatched)).alias("target"), F.col("_cost").alias("cost"))
