import random
import re
import unicodedata
from collections import defaultdict

import numpy as np

from lodestrata.llm import leakage as L

rng = random.Random(9)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]


def words(s):
    s = "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", s).casefold()) if not unicodedata.category(c).startswith("M"))
    return re.findall(r"[^\W_]+", s)


def brute(docs, items, n=12):
    grams = defaultdict(set)
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - n + 1):
            grams[tuple(w[k : k + n])].add(i)
    out = set()
    for d, t in docs:
        w = words(t or "")
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ()) if d is not None and i is not None}
    return out


def phrase(n):
    return " ".join(rng.choices(WORDS, k=n))


def test_leaks_equal_brute_force(spark):
    opening = phrase(8)
    items = [(i, f"{opening} {phrase(30)}") for i in range(12)] + [(90, "too short"), (91, None), (92, ""), (None, phrase(40)), (93, phrase(12))]
    docs = []
    for d in range(120):
        text = phrase(rng.randrange(5, 80))
        if d % 2:
            w = words(rng.choice(items[:12])[1])
            a, n = rng.randrange(0, 20), rng.choice((9, 11, 12, 13, 20))
            part = w[a : a + n]
            text += " " + rng.choice((" ", ", ", "​ - ", "\n")).join(x.upper() if d % 3 else "ﬁ".join(x.split("fi")) for x in part) + " " + phrase(6)
        docs.append((d, text))
    docs += [(1000, None), (1001, ""), (None, items[0][1]), (1002, items[16][1]), (1003, "Ｅｅ " + items[0][1].replace("a", "á")), (7, items[3][1]), (1004, phrase(30_000))]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, score string")
    it = spark.createDataFrame(items, "item_id bigint, item_text string")
    rows = L.leaks(df, "doc_id", "text", it, "item_id", "item_text").collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["longest_run"] >= 12} == brute(docs, items)
    assert L.leaks(df.limit(0), "doc_id", "text", it, "item_id", "item_text").count() == 0
    assert L.leaks(df, "doc_id", "text", it.limit(0), "item_id", "item_text").count() == 0


def test_edited_copies_are_aligned(spark):
    w = words(phrase(40))
    copy = list(w)
    for i in (9, 18, 27, 36):
        copy[i] = "changed"
    df = spark.createDataFrame([(1, "before that " + " ".join(copy))], "doc_id bigint, text string")
    it = spark.createDataFrame([(5, " ".join(w))], "item_id bigint, item_text string")
    assert L.leaks(df, "doc_id", "text", it, "item_id", "item_text").count() == 0
    (r,) = L.leaks(df, "doc_id", "text", it, "item_id", "item_text", edited=True).collect()
    assert r["share"] > 0.8 and r["longest_run"] < 12 and r["end_word"] == 42


def test_edited_copies_are_aligned_beside_exact_ones(spark):
    w = words(phrase(40))
    copy = list(w)
    for i in (9, 18, 27, 36):
        copy[i] = "changed"
    texts = [(1, " ".join(copy))] + [(d, " ".join(w)) for d in (2, 3, 4)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    it = spark.createDataFrame([(5, " ".join(w))], "item_id bigint, item_text string")
    rows = {r["doc_id"]: r for r in L.leaks(df, "doc_id", "text", it, "item_id", "item_text", edited=True).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert 0.8 < rows[1]["share"] < 1 and rows[1]["longest_run"] < 12 and rows[2]["share"] == 1


def test_alignment_equals_plain_dynamic_programme():
    for _ in range(60):
        a, b = (np.array([rng.randrange(4) for _ in range(rng.randrange(1, 12))], dtype=np.uint64) for _ in range(2))
        h = [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
        r = [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
        for i in range(1, len(b) + 1):
            for j in range(1, len(a) + 1):
                same = b[i - 1] == a[j - 1]
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if same else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                r[i][j] = r[i - 1][j - 1] + 1 if same else 0
        score, _, longest, _ = L.align(a, b)
        assert score == max(map(max, h)) and longest == max(map(max, r))


def test_recall_of_edited_copies(spark):
    """Copies with a tenth to a fifth of their words replaced, left out or doubled are found, and other texts aren't."""
    items = [(i, [f"w{rng.randrange(900)}" for _ in range(40)]) for i in range(40)]
    docs, true = [], set()
    for d in range(200):
        text = [f"w{rng.randrange(900)}" for _ in range(60)]
        if d % 2:
            i, own = rng.choice(items)
            copy = []
            for w in own:
                kind = rng.random() if rng.random() < rng.choice((0.1, 0.15, 0.2)) else 1
                copy += [w] if kind == 1 else [] if kind < 0.3 else [w, w] if kind < 0.5 else ["edited"]
            text[20:20] = copy
            true.add((d, i))
        docs.append((d, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, item_text string")
    rows = L.leaks(df, "doc_id", "text", it, "item_id", "item_text", edited=True).where("share >= 0.25").collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    assert len(found & true) >= 0.9 * len(true) and len(found - true) <= 2


def test_long_words_differ():
    a, b = "x" * 70_000 + "a", "x" * 70_000 + "b"
    hashes, _ = L.word_hashes([a, b, a, a[1:]])
    assert hashes[0] == hashes[2] and len(set(hashes.tolist())) == 3


def test_item_with_many_partners(spark):
    """More items in one document than are aligned in a row, and items of string ids."""
    passage = [phrase(14) for _ in range(150)]
    df = spark.createDataFrame([("d", " ".join(passage)), ("e", passage[0])], "doc_id string, text string")
    it = spark.createDataFrame([(f"i{n}", p) for n, p in enumerate(passage)], "item_id string, item_text string")
    rows = L.leaks(df, "doc_id", "text", it, "item_id", "item_text").where("longest_run >= 12").collect()
    assert len(rows) == 151 and {r["item_id"] for r in rows if r["doc_id"] == "e"} == {"i0"}
