import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import setsketch as S

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(4000)]


def text(words):
    return " ".join(words)


def brute(rows, threshold=0.8):
    sets = {}
    for k, t in rows:
        if k is not None:
            sets[k] = S.tokens(t or "")
    keys = sorted(sets)
    out = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            p, q = sets[a], sets[b]
            if (len(p & q) / len(p | q) if p | q else 1.0) >= threshold:
                out.add((a, b))
    return out


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    rng.shuffle(words)
    return words


def test_pairs_equal_brute_force(spark):
    rows = []
    for g in range(40):
        base = rng.sample(WORDS, 60)
        rows += [(f"g{g:02}-{i}", text(edited(base, n))) for i, n in enumerate((0, 0, 1, 3, 5, 8))]
    rows += [(f"u{i}", text(rng.sample(WORDS, 60))) for i in range(100)]
    rows += [("dup", rows[0][1].upper()), ("e1", ""), ("e2", None), ("e3", " .,"), (None, "x y z"), (rows[3][0], rows[3][1])]
    df = spark.createDataFrame([(k, t, 1, "z") for k, t in rows], "posting_id string, t string, cid int, size string")
    members, links = S.near_duplicates(df, "posting_id", "t")
    got = {tuple(r) for r in S.all_pairs(members, links, "posting_id").collect()}
    assert got == brute(rows)
    counted = {r["posting_id"]: r for r in S.link_counts(members, links, "posting_id").collect()}
    assert counted["dup"]["copies"] >= 2 and counted["u0"]["linked_classes"] == 0 and len(counted) == len({k for k, _ in rows if k is not None})


def test_empty_and_hot_group(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 5)  # a hot bucket is split into many blocks
    base = rng.sample(WORDS, 80)
    rows = [(f"h{i}", text(edited(base, 2))) for i in range(40)] + [(f"c{i}", text(base)) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, t string")
    got = {tuple(r) for r in S.all_pairs(*S.near_duplicates(df, "k", "t"), "k").collect()}
    assert got == brute(rows)
    members, links = S.near_duplicates(df.limit(0), "k", "t")
    assert members.count() == links.count() == 0


def test_registers_merge_and_estimate():
    hashes = S.mix(np.arange(1, 900, dtype=np.uint64))
    a, b = hashes[:600], hashes[200:800]
    both = S.sketch([a, b, np.union1d(a, b)])
    assert (np.maximum(both[0], both[1]) == both[2]).all()
    guess = S.estimate(both[:1], both[1:2], np.array([600.0]), np.array([600.0]))[0]
    assert abs(guess - 400 / 800) < 0.08
    assert (S.sketch([np.zeros(0, dtype=np.uint64)]) == 0).all()


@settings(max_examples=30, deadline=None)
@given(st.integers(20, 300), st.floats(0.05, 0.95))
def test_estimates_lie_near(n, share):
    k = int(n * share)
    hashes = S.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(7919))
    a, b = hashes[:n], hashes[n - k : 2 * n - k]
    s = S.sketch([a, b])
    assert abs(S.estimate(s[:1], s[1:], np.array([float(n)]), np.array([float(n)]))[0] - k / (2 * n - k)) < 0.12
