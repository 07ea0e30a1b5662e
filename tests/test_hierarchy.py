from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestrata.operators.hierarchy import descendants, hierarchy, reachable

SCHEMA = "concepturi string, broaderuri string, path string, node string, depth int"


def found(spark, links):
    df = spark.createDataFrame([(a, b, "x", "y", 1) for a, b in links], SCHEMA)
    return {(r["node"], " > ".join(r["path"]) if r["path"] else r["state"]) for r in hierarchy(df).collect()}


def brute(links):
    pairs = {((a or "").strip(), (b or "").strip()) for a, b in links}
    nodes = {x for p in pairs for x in p if x}
    parents, children = defaultdict(set), defaultdict(set)
    for a, b in pairs:
        if a and b:
            parents[a].add(b)
            children[b].add(a)

    def above(n):
        seen, todo = set(), list(parents[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += parents[x]
        return seen

    cyclic = {n for n in nodes if n in above(n)}
    out, reached = {(n, "cycle") for n in cyclic}, set()
    todo = [(n, n) for n in nodes if not parents[n]]
    while todo:
        n, path = todo.pop()
        out.add((n, path))
        reached.add(n)
        todo += [(c, f"{path} > {c}") for c in children[n] - cyclic]
    return out | {(n, "below_cycle") for n in nodes - cyclic - reached}


def test_paths_cycles_and_dirt(spark):
    links = [("b", "a"), (" b", "a\t"), ("c", "b"), ("c", "a"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), ("t", "s"), ("t", "a"), ("lone", None), ("lone2", " "), (None, "up"), (None, None)]
    rows = found(spark, links)
    assert rows == brute(links)
    assert ("c", "a > b > c") in rows and ("z", "below_cycle") in rows and ("s", "cycle") in rows and ("t", "a > t") in rows and ("up", "up") in rows


def test_empty_and_deep(spark):
    assert found(spark, []) == set()
    chain = [(f"n{i + 1:03}", f"n{i:03}") for i in range(30)]
    rows = found(spark, chain)
    assert len(rows) == 31 and max(r[1].count(">") for r in rows) == 30


def test_long_cycle(spark):
    ring = [(str(i), str((i + 1) % 21)) for i in range(21)] + [("tail", "3"), ("3", "head")]
    assert found(spark, ring) == brute(ring)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdefg"), st.sampled_from("abcdefg")), min_size=1, max_size=12))
def test_random_graphs(spark, links):
    assert found(spark, links) == brute(links)


def test_descendants_take_least_distance(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "c")], "concepturi string, broaderuri string")
    rows = {tuple(r) for r in descendants(hierarchy(df)).collect()}
    assert rows == {("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("b", "c", 1), ("b", "d", 2), ("c", "d", 1)}


def brute_distances(links):
    children = defaultdict(set)
    for a, b in {(a.strip(), b.strip()) for a, b in links}:
        children[b].add(a)
    out = set()
    for start in list(children):
        seen, level, n = {}, children[start], 1
        while level:
            seen |= dict.fromkeys(level, n)
            level, n = {c for x in level for c in children.get(x, ())} - seen.keys(), n + 1
        out |= {(start, d, n) for d, n in seen.items()}
    return out


def test_reachable_passes_cycles(spark):
    links = [("x", "top"), ("x", "y"), ("y", "x"), ("z", " y"), ("s", "s"), ("t", "s"), ("t", "top")]
    links += [(f"n{i + 1}", f"n{i}") for i in range(11)] + [("n3", "n9"), ("n0", "z"), ("n7", "top")]
    rows = [tuple(r) for r in reachable(spark.createDataFrame(links, "concepturi string, broaderuri string")).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_distances(links)
    assert {("top", "y", 2), ("top", "z", 3), ("x", "x", 2), ("y", "z", 1), ("s", "t", 1), ("s", "s", 1)} <= set(rows)
    assert reachable(spark.createDataFrame([("a", None)], "concepturi string, broaderuri string")).count() == 0


def test_every_descendant_has_a_query():
    from lodestrata.plans import registry

    assert "p2_reachable" in registry.QUERIES and "p2_reachable" in registry.ORACLE


def test_cycles_of_every_make(spark):
    ladder = [(f"l{i + 1:02}{s}", f"l{i:02}{t}") for i in range(12) for s in "ab" for t in "ab"]
    tangles = [
        ladder + [("l00a", "l12b")],  # one large component without unbranched runs
        [("a", "b"), ("b", "a"), ("c", "a"), ("d", "c"), ("d", "e"), ("e", "f"), ("f", "e"), ("e", "d"), ("g", "b"), ("g", "h")],  # cycles with a way between
        [(f"x{i}", f"x{(i + 1) % 6}") for i in range(6)] + [(f"y{i}", f"y{(i + 1) % 5}") for i in range(5)] + [("y0", "x3"), ("z", "y2"), ("z", "r"), ("zz", "z")],
        [("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("d", "c"), ("e", "d"), ("d", "e")],
    ]
    for links in tangles:
        assert found(spark, links) == brute(links)


def test_dead_ladder_below_a_cycle(spark):
    # Two nodes a level, fully linked: 2^40 ways lead down, and none from a root.
    links = [(f"l{i + 1:02}{s}", f"l{i:02}{t}") for i in range(40) for s in "ab" for t in "ab"] + [("l00a", "c"), ("l00b", "c"), ("c", "c"), ("x", "l40a"), ("x", "top")]
    rows = found(spark, links)
    assert ("x", "top > x") in rows and ("l40a", "below_cycle") in rows and len(rows) == 85


def test_great_ring_and_deep_chain(spark):
    ring = spark.range(100_000).selectExpr("'r' || id AS concepturi", "'r' || ((id + 1) % 100000) AS broaderuri")
    chain = spark.range(3_000).selectExpr("'n' || (id + 1) AS concepturi", "'n' || id AS broaderuri")
    rows = hierarchy(ring.unionByName(chain)).groupBy("state").agg({"depth": "max", "*": "count"}).collect()
    assert {(r["state"], r["count(1)"], r["max(depth)"]) for r in rows} == {("cycle", 100_000, None), ("path", 3_001, 3_000)}
