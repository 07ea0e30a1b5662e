"""Parent-child links of unknown depth: paths, depths, roots, descendants and cycles.

Paths grow by frontier joins from the roots, in strides of links that double. Cycles are found
before, so that no path can run round one: they are what frontiers from the roots and from the
leaves leave unreached. Nodes that no path reaches then lie below cycles only.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodestrata.storage import cut, cut_counted, discard, together

#: Taking away and folding go on alone while a round removes at least this share of the links.
FOLD_SHARE = 0.3


def clean_id(column: str):
    """The id without white space around it; null if nothing is left."""
    bare = F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")
    return F.when(bare != "", bare)


def read_links(df: DataFrame, child: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes ``(node)`` and links ``(child, parent)``; ids are trimmed, blank ones are none."""
    raw = df.select(clean_id(child).alias("child"), clean_id(parent).alias("parent")).distinct()
    nodes = raw.select(F.explode(F.array_compact(F.array("child", "parent"))).alias("node")).distinct()
    return nodes, raw.where(F.col("child").isNotNull() & F.col("parent").isNotNull())


def cycle_nodes(links: DataFrame) -> DataFrame:
    """Distinct ``(node)`` on a cycle of ``(child, parent)`` links; a link to itself is one.

    Frontiers from the roots and from the leaves take away what they reach, and what no frontier
    reaches lies on cycles or between them. So that long chains don't cost a round for each of
    their links, unbranched runs are folded into their heads between rounds: all nodes of a run lie
    on the same cycles. A run that closes on itself, or folds into a link to itself, is a cycle.
    Where taking away and folding remove little, the least labels spread both ways (see
    ``_separate``). No pairs of ancestors are formed: every round holds at most the links.
    """
    links = links if hasattr(links, "_cut_path") else cut(links, "links")
    found = [links.where(F.col("child") == F.col("parent")).select(F.col("child").alias("node"))]
    folded = None  # (node, head) of all nodes folded so far
    rest, count = links.where(F.col("child") != F.col("parent")), None
    while count != 0:
        before = count
        inner, count = cut_counted(_take_away(_take_away(rest)), "inner")
        if not count:
            break
        runs, rings = _runs(inner)
        if folded is not None:
            moved = folded.join(runs.select(F.col("node").alias("head"), F.col("head").alias("far")), "head", "left")
            runs_so_far = moved.select("node", F.coalesce("far", "head").alias("head")).unionByName(runs)
            folded = cut(runs_so_far, "folded")
        else:
            folded = runs
        # A link ends a run at its parent's side where its child isn't inside one; its parent is then seen as the run's head.
        outer = inner.join(runs.select(F.col("node").alias("child")).unionByName(rings.select(F.col("node").alias("child"))), "child", "left_anti")
        seen = outer.join(runs.select(F.col("node").alias("parent"), "head"), "parent", "left").select("child", F.coalesce("head", "parent").alias("parent")).distinct()
        left = Observation()
        closed = cut(seen.observe(left, F.count_if(F.col("child") != F.col("parent")).alias("n")), "closed")
        discard(inner)
        marks = closed.where(F.col("child") == F.col("parent")).select(F.col("child").alias("node")).unionByName(rings.select("node"))
        rest, count = closed.where(F.col("child") != F.col("parent")), left.get["n"]
        if before and count > before * (1 - FOLD_SHARE):
            cyclic, rest, count = _separate(rest)
            marks = marks.unionByName(cyclic)
        found.append(_with_folded(marks, folded))
    return cut(_all(found).distinct(), "cyclic")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def _take_away(links: DataFrame) -> DataFrame:
    """The links whose child has children and whose parent has parents."""
    children = links.select(F.col("child").alias("parent")).distinct()
    parents = links.select(F.col("parent").alias("child")).distinct()
    return links.join(children, "parent", "left_semi").join(parents, "child", "left_semi").select("child", "parent")


def _with_folded(marks: DataFrame, folded: DataFrame) -> DataFrame:
    """``marks`` and the nodes folded into them."""
    members = folded.join(marks.select(F.col("node").alias("head")).distinct(), "head", "left_semi").select("node")
    return marks.unionByName(members)


def _runs(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes inside unbranched runs: ``(node, head)``, and ``(node)`` of runs that close on themselves and have no head.

    A node with one parent that has no other child belongs to the run of that parent. Heads are
    found by doubling. While a run with a head is longer than the steps, some of its nodes come to that
    head in each round; so once as many move as in the round before, they go round.
    """
    single_child = links.groupBy("parent").agg(F.count("*").alias("n")).where("n = 1").select("parent")
    single_parent = links.groupBy("child").agg(F.count("*").alias("n")).where("n = 1").select("child")
    inside = links.join(single_child, "parent", "left_semi").join(single_parent, "child", "left_semi")
    runs, total = cut_counted(inside.select(F.col("child").alias("node"), F.col("parent").alias("head"), F.lit(True).alias("moved")), "runs")
    moved, moving = total + 1, total
    while 0 < moving < moved:
        seen = Observation()
        after = cut(_jump(runs).observe(seen, F.count_if("moved").alias("n")), "runs")
        discard(runs)
        moved, moving, runs = moving, seen.get["n"], after
    return runs.where("NOT moved" if moving else "true").select("node", "head"), runs.where("moved" if moving else "false").select("node")


def _jump(runs: DataFrame) -> DataFrame:
    """Every node's head moved on to that head's head, if it has one."""
    above = runs.select(F.col("node").alias("head"), F.col("head").alias("far"))
    return runs.drop("moved").join(above, "head", "left").select("node", F.coalesce("far", "head").alias("head"), F.col("far").isNotNull().alias("moved"))


def _separate(links: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``(node)`` of cycles that show, and the links that may still lie on others, with their number.

    Every node takes the greatest label of its ancestors and that of its descendants, itself
    included; nodes of one cycle agree in both. Where both are one label, that node is above and
    below all that bear it, so links between those are on cycles. Links between nodes that differ are
    on none. Labels are ordered by a hash; each round passes them on over a link and from a label's
    own node, so long ways are shortened.
    """
    label = lambda c: F.concat(F.lpad(F.hex(F.xxhash64(c)), 16, "0"), F.col(c))
    ends = cut(links.select(label("child").alias("child"), label("parent").alias("parent")), "labelled")
    labels = cut(ends.select(F.explode(F.array("child", "parent")).alias("own")).distinct().select("own", F.col("own").alias("above"), F.col("own").alias("below")), "labels")
    while True:
        up = ends.join(labels.select(F.col("own").alias("parent"), F.col("above").alias("x")), "parent").groupBy(F.col("child").alias("own")).agg(F.max("x").alias("up"))
        down = ends.join(labels.select(F.col("own").alias("child"), F.col("below").alias("x")), "child").groupBy(F.col("parent").alias("own")).agg(F.max("x").alias("down"))
        far_up = labels.select(F.col("own").alias("above"), F.col("above").alias("far_up"))
        far_down = labels.select(F.col("own").alias("below"), F.col("below").alias("far_down"))
        seen = Observation()
        grown = labels.join(far_up, "above").join(far_down, "below").join(up, "own", "left").join(down, "own", "left").select(
            "own", F.greatest("above", "far_up", "up").alias("above"), F.greatest("below", "far_down", "down").alias("below"),
            ((F.greatest("above", "far_up", "up") > F.col("above")) | (F.greatest("below", "far_down", "down") > F.col("below"))).alias("changed"),
        )
        after = cut(grown.observe(seen, F.count_if("changed").alias("n")).drop("changed"), "labels")
        discard(labels)
        labels = after
        if not seen.get["n"]:
            break
    of = lambda side: labels.select(F.col("own").alias(side), F.col("above").alias(f"{side}_above"), F.col("below").alias(f"{side}_below"))
    alike = ends.join(of("child"), "child").join(of("parent"), "parent").where("child_above = parent_above AND child_below = parent_below")
    bare = lambda c: F.substring(c, 17, 1 << 30)
    tried = cut(alike.select(bare("child").alias("child"), bare("parent").alias("parent"), (F.col("child_above") == F.col("child_below")).alias("shown")), "alike")
    rest, count = cut_counted(tried.where("NOT shown").select("child", "parent"), "unsure")
    return tried.where("shown").select(F.explode(F.array("child", "parent")).alias("node")).distinct(), rest, count


def grow_paths(roots: DataFrame, links: DataFrame) -> DataFrame:
    """All paths ``(node, root, depth, path)`` from ``roots`` down cycle-free ``(child, parent)`` links.

    ``path`` is the array of nodes from root to node; a root has depth 0. Each round joins the paths
    that are known with stretches of links below them, and stretches double: after round k all
    paths of fewer than 2^k links are known, so a chain of n links takes log2 n rounds. Below
    reached nodes there are no more stretches than paths that end in them; stretches that no root
    reaches could be more, so where the next ones would outnumber the links and the paths so far,
    doubling ends and the frontier goes on by the stretches there are. What is written is at most
    the result and as many stretches.
    """
    known, rows = cut_counted(roots.select("node", F.col("node").alias("root"), F.array("node").alias("path")), "paths")
    stretches, bound = cut_counted(links.select(F.col("child").alias("node"), F.col("parent").alias("top"), F.array("child").alias("below")), "stretches")
    paths, doubling = [known], True
    with ThreadPoolExecutor(2) as pool:
        while bound:
            base = together(paths) if doubling else paths[-1]
            extend = stretches.join(base.withColumnRenamed("node", "top"), "top").select("node", "root", F.concat("path", "below").alias("path"))
            longer = pool.submit(_twice, stretches, max(bound, rows)) if doubling else None
            grown, count = cut_counted(extend, "paths")
            after = longer.result() if longer else None
            if not count:
                break
            paths.append(grown)
            rows += count
            doubling = after is not None
            stretches = after or stretches
    return together(paths).select("node", "root", (F.size("path") - 1).alias("depth"), "path")


def _twice(stretches: DataFrame, most: int) -> DataFrame | None:
    """Stretches twice as long, or None if there would be more than ``most``."""
    ends = stretches.groupBy("node").agg(F.count("*").alias("n")).join(stretches.groupBy(F.col("top").alias("node")).agg(F.count("*").alias("m")), "node")
    if (ends.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0) > most:
        return None
    upper = stretches.select(F.col("node").alias("top"), F.col("top").alias("far"), F.col("below").alias("between"))
    return cut(stretches.join(upper, "top").select("node", F.col("far").alias("top"), F.concat("between", "below").alias("below")), "stretches")


def hierarchy(df: DataFrame, child: str = "concepturi", parent: str = "broaderuri") -> DataFrame:
    """Every node with each of its paths from a root, or with the reason why it has none.

    Result ``(node, root, depth, path, state)``: state ``path`` - one row for each distinct path
    (an array from root to node) from a node without parents down to it that meets no node on a
    cycle; ``cycle`` - the node lies on a cycle, one row, no path; ``below_cycle`` - no such path
    leads to it, one row, no path. Ids are trimmed of white space; a null or blank id is none, so
    a row with only one id states that its node exists and a row without ids says nothing.
    Repeated links count once; labels and all other columns are not read. An empty table gives no
    rows.
    """
    nodes, links = read_links(df, child, parent)
    nodes, links = cut(nodes, "nodes"), cut(links, "links")
    cyclic = cycle_nodes(links)
    roots = nodes.join(links.select(F.col("child").alias("node")), "node", "left_anti")
    sound = links.join(cyclic.select(F.col("node").alias("child")), "child", "left_anti").join(
        cyclic.select(F.col("node").alias("parent")), "parent", "left_anti"
    )
    paths = grow_paths(roots, sound)
    none = [F.lit(None).cast("string").alias("root"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("array<string>").alias("path")]
    unreached = nodes.join(cyclic, "node", "left_anti").join(paths.select("node").distinct(), "node", "left_anti")
    return (
        paths.withColumn("state", F.lit("path"))
        .unionByName(cyclic.select("node", *none, F.lit("cycle").alias("state")))
        .unionByName(unreached.select("node", *none, F.lit("below_cycle").alias("state")))
    )


def descendants(tree: DataFrame) -> DataFrame:
    """``(ancestor, descendant, distance)`` of ``hierarchy``'s paths; distance is the least number of links.

    Every path holds its node's ancestors, so the pairs come without a join. Nodes without a path
    give none. Pairs are combined before the shuffle.
    """
    return (
        tree.where(F.col("state") == "path")
        .select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
        .where(F.col("at") < F.col("depth"))
        .groupBy("ancestor", "descendant")
        .agg(F.min(F.col("depth") - F.col("at")).cast("int").alias("distance"))
    )


def reachable(df: DataFrame, child: str = "concepturi", parent: str = "broaderuri") -> DataFrame:
    """``(ancestor, descendant, distance)`` over all links, those on and beside cycles too; distance is the least number of links.

    A node on a cycle is its own descendant. Ids are read as in ``hierarchy``. Pairs are formed by
    doubling: after round k those at up to 2^k links are known, and those at exactly 2^k extend
    them, so a chain of n links takes log2 n rounds. It ends when a round brings no new pair.
    """
    _, links = read_links(df, child, parent)
    known, n = cut_counted(links.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("distance")), "pairs")
    reach = 1
    while n:
        before = known.where(F.col("distance") == reach).select("ancestor", F.col("descendant").alias("mid"), F.col("distance").alias("steps"))
        after = known.select(F.col("ancestor").alias("mid"), "descendant", "distance")
        longer = before.join(after, "mid").select("ancestor", "descendant", (F.col("steps") + F.col("distance")).alias("distance"))
        known, now = cut_counted(known.unionByName(longer).groupBy("ancestor", "descendant").agg(F.min("distance").alias("distance")), "pairs")
        if now == n:
            break
        reach, n = 2 * reach, now
    return known
