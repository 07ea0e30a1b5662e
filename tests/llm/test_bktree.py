import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import bktree as B

ENTRIES = [
    ("install frozen hybrids", "u1", 0), ("installation of frozen hybrids", "u1", 1), ("install hybrids of the frozen type", "u1", 1), ("repair wooden lenses", "u2", 0), ("mend wooden lenses", "u2", 1),
    ("repair woollen lenses", "u3", 0), ("Visdipron", "u4", 0), ("Visdipron ticketing suite", "u4", 1), ("Visdipron 5.9", "u4", 1), ("Volbesme", None, 0), ("working with lenses", None, 0), ("Volbesma", "u5", 0),
]
FREE = ["of", "the", "type", "ticketing", "suite"]


@pytest.fixture(scope="module")
def reference():
    return B.Reference(ENTRIES, FREE, B.frame_words())


@pytest.mark.parametrize("value,target", [
    ("Install Frozen Hybrids", "u1"), ("  hybrids, frozen - instal;", "u1"), ("must be able to install frozen hybirds (3+ yrs)", "u1"), ("install hybrid of the frozen type", "u1"), ("knowledge of MEND wooden lense", "u2"),
    ("Ｖｉｓｄｉｐｒｏｎ 7.1 a plus", "u4"), ("visdi.", "u4"), ("Visdirpon", "u4"), ("ticketing suite Visdipron", "u4"), ("ticke. suite Visdipron", "u4"), ("repair woollen lenses", "u3"), ("repair woolen lenses", "u3"),
    ("Volbesme", ""), ("working with lenses", ""), ("Volbesma", "u5"),
])
def test_named(reference, value, target):
    assert reference.best([value])[0][2] == target


@pytest.mark.parametrize("value", ["", "n/a", "must have", "polish frozen hybrids", "install frozen", "fluent small talk", "ticketing suite", "install frozen hybrids and repair wooden lenses", "12 34", "x" * 100_000, "word " * 20_000])
def test_unnamed(reference, value):
    assert reference.best([value]) == [None]


@pytest.mark.parametrize("value,target", [
    ("slq", "sql"), ("spa", "sap"), ("xecle spreadsheets", "xl"), ("C++", "cpp"), ("c", "c"), ("R", "r"), ("experience wiht R", "r"), ("jaav", "java"),
    ("no java", None), ("java ee", None), ("java qz", None), ("python c", None), ("C#", None), ("jaba scala", None),
])
def test_short_words(value, target):
    short = B.Reference([("SQL", "sql", 0), ("SAP", "sap", 0), ("Excel spreadsheets", "xl", 0), ("Java", "java", 0), ("Python", "py", 0), ("C", "c", 0), ("C++", "cpp", 0), ("R", "r", 0)], (), B.frame_words())
    found = short.best([value])[0]
    assert (found and found[2]) == target


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def apart(a, b):
    n = max(len(a), len(b))
    a, b = [*a, *[""] * (n - len(a))], [*b, *[""] * (n - len(b))]
    return min(sum(plain(x, y) for x, y in zip(a, p, strict=True)) for p in itertools.permutations(b))


BAGS = st.lists(st.text(alphabet="abcd", min_size=1, max_size=6), min_size=1, max_size=4).map(lambda w: tuple(sorted(w)))


@settings(max_examples=25, deadline=None)
@given(st.lists(BAGS, min_size=1, max_size=40, unique=True), st.lists(BAGS, min_size=1, max_size=6), st.integers(0, 5))
def test_tree_returns_all_within_radius(bags, queries, reach):
    tree = B.Tree(bags)
    for q, near in zip(queries, tree.within(queries, [reach] * len(queries)), strict=True):
        assert sorted(near) == sorted((i, apart(q, b)) for i, b in enumerate(tree.bags) if apart(q, b) <= reach)


@settings(max_examples=40, deadline=None)
@given(BAGS, BAGS, BAGS)
def test_metric(a, b, c):
    assert apart(a, c) <= apart(a, b) + apart(b, c)
    assert apart(a, b) == apart(b, a)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=80), st.text(max_size=80)), min_size=1, max_size=10))
def test_distances_of_any_words(pairs):
    left, right = B.Words([(a,) for a, _ in pairs]), B.Words([(b,) for _, b in pairs])
    a, b = np.array([left.number[x] for x, _ in pairs]), np.array([right.number[y] for _, y in pairs])
    assert B.levenshtein(left, a, right, b).tolist() == [plain(x, y) for x, y in pairs]


def test_assignment_of_many_words():
    rng = np.random.default_rng(1)
    for n in (2, 3, 5, 7):
        tables = rng.integers(0, 20, (20, n, n))
        want = [min(sum(t[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))) for t in tables]
        assert B.assignment(tables).tolist() == want == [B._cheapest(t.tolist()) for t in tables]


def test_free_words(spark):
    labels = spark.createDataFrame([("u", ["x", "kit"]), ("u", ["x"]), ("v", ["y", "kit", "old"]), ("v", ["y", "old"]), ("w", ["old", "z"]), ("w", ["z"]), ("t", ["old"]), (None, ["x", "odd"])], "target string, words array<string>")
    assert {r[0] for r in B.free_words(labels).collect()} == {"kit"}


def test_table_and_shards(spark):
    df = spark.createDataFrame([("a", "instal frozen hybrids", "x"), ("b", None, "x"), ("c", "  ", "x"), ("d", "see above", "x"), ("a", "instal frozen hybrids", "x"), ("e", "word " * 20_000, "x"), (None, "Visdipron", "x"), ("f", "lenses, woollen (repair)", "x")], "id string, v string, target string")
    ref = spark.createDataFrame([*ENTRIES, (None, "u9", 0), ("...", "u9", 0)], "label string, target string, rank int")
    want = [("None", "u4"), ("a", "u1"), ("a", "u1"), ("d", "unmatched"), ("e", "unmatched"), ("f", "u3")]
    for labels in (B.SHARD_LABELS, 4):  # one shard, then several
        assert sorted((str(r["id"]), r["target"]) for r in B.map_values(df, ["id"], "v", ref, shard_labels=labels).collect()) == want
    assert {r["target"] for r in B.map_values(df, ["id"], "v", ref.limit(0)).collect()} == {"unmatched"}
    assert B.map_values(df.limit(0), ["id"], "v", ref).count() == 0


def test_held_out_accuracy(reference):
    rng = random.Random(3)
    hits = 0
    for _ in range(300):
        label, target, _ = rng.choice([e for e in ENTRIES if e[1] in ("u1", "u2", "u4")])
        i = rng.randrange(1, len(label) - 1)
        value = label[:i] + rng.choice("abcdefgh") + label[i + 1 :] if label[i].isalpha() else label
        best = reference.best([value])[0]
        hits += bool(best) and best[2] == target
    assert hits > 285
