"""Queries of the two general data problems: hierarchies and snapshot differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import hierarchy as tree
from lodestrata.operators import snapshots
from lodestrata.plans.tables import table

LINKS = "broaderrelationsskillpillar"


def p2_found(spark, folder):
    rows = tree.hierarchy(table(spark, folder, LINKS))
    return rows.select(
        F.col("node").alias("concepturi"),
        F.when(F.col("state") == "path", F.array_join("path", " > ")).otherwise(F.col("state")).alias("path"),
    )


def p2_descendants(spark, folder):
    return tree.descendants(tree.hierarchy(table(spark, folder, LINKS)))


def p2_reachable(spark, folder):
    """All descendants of every concept, over links on cycles too; ``p2_descendants`` has those along paths from a root."""
    return tree.reachable(table(spark, folder, LINKS))


def p2_roots(spark, folder):
    rows = tree.hierarchy(table(spark, folder, LINKS)).where(F.col("state") == "path")
    return rows.groupBy(F.col("node").alias("concepturi")).agg(
        F.min("depth").cast("bigint").alias("least_depth"),
        F.max("depth").cast("bigint").alias("greatest_depth"),
        F.countDistinct("root").alias("roots"),
        F.count("*").alias("paths"),
    )


def p5_found(spark, folder):
    return snapshots.snapshot_changes(table(spark, folder, "postings"))


_GRAPH = r"""
WITH RECURSIVE
raw AS (SELECT DISTINCT nullif(regexp_replace(concepturi, '^\s+|\s+$', '', 'g'), '') AS c,
               nullif(regexp_replace(broaderuri, '^\s+|\s+$', '', 'g'), '') AS p
        FROM broaderrelationsskillpillar),
nodes AS (SELECT c AS node FROM raw WHERE c IS NOT NULL UNION SELECT p FROM raw WHERE p IS NOT NULL),
links AS (SELECT c, p FROM raw WHERE c IS NOT NULL AND p IS NOT NULL),
reach(low, high) AS (SELECT c, p FROM links UNION SELECT r.low, l.p FROM reach r JOIN links l ON l.c = r.high),
cyclic AS (SELECT DISTINCT low AS node FROM reach WHERE low = high),
sound AS (SELECT c, p FROM links WHERE c NOT IN (SELECT node FROM cyclic) AND p NOT IN (SELECT node FROM cyclic)),
roots AS (SELECT node FROM nodes WHERE node NOT IN (SELECT c FROM links)),
walk(node, root, depth, path) AS (
  SELECT node, node, 0, node FROM roots
  UNION ALL SELECT s.c, w.root, w.depth + 1, w.path || ' > ' || s.c FROM walk w JOIN sound s ON s.p = w.node)
"""

ORACLE = {
    "p2_found": _GRAPH + """
SELECT node AS concepturi, path FROM walk
UNION ALL SELECT node, 'cycle' FROM cyclic
UNION ALL SELECT node, 'below_cycle' FROM nodes
  WHERE node NOT IN (SELECT node FROM cyclic) AND node NOT IN (SELECT node FROM walk)""",
    "p2_roots": _GRAPH + """
SELECT node AS concepturi, CAST(min(depth) AS BIGINT) AS least_depth, CAST(max(depth) AS BIGINT) AS greatest_depth,
       CAST(count(DISTINCT root) AS BIGINT) AS roots, CAST(count(*) AS BIGINT) AS paths
FROM walk GROUP BY node""",
    "p2_descendants": _GRAPH + """,
steps(ancestor, descendant, distance, node) AS (
  SELECT w.node, s.c, 1, s.c FROM (SELECT DISTINCT node FROM walk) w JOIN sound s ON s.p = w.node
  UNION SELECT t.ancestor, s.c, t.distance + 1, s.c FROM steps t JOIN sound s ON s.p = t.node)
SELECT ancestor, descendant, CAST(min(distance) AS INTEGER) AS distance FROM steps GROUP BY ALL""",
    "p2_reachable": _GRAPH + """,
span(ancestor, descendant, distance) USING KEY (ancestor, descendant) AS (
  SELECT p, c, CAST(1 AS INTEGER) FROM links
  UNION SELECT s.ancestor, l.c, CAST(s.distance + 1 AS INTEGER) FROM span s JOIN links l ON l.p = s.descendant
    LEFT JOIN recurring.span k ON k.ancestor = s.ancestor AND k.descendant = l.c WHERE k.ancestor IS NULL)
SELECT ancestor, descendant, distance FROM span""",
    "p5_found": """
WITH valid AS (SELECT snapshot_id AS s, posting_id AS k, arg_max(coalesce(text_hash, ''), fetched_at) AS d
               FROM postings WHERE snapshot_id IS NOT NULL AND posting_id IS NOT NULL GROUP BY ALL),
snaps AS (SELECT s, lead(s) OVER (ORDER BY s) AS nxt FROM (SELECT DISTINCT s FROM valid)),
pairs AS (SELECT a.s AS a, a.nxt AS b FROM snaps a WHERE a.nxt IS NOT NULL)
SELECT p.b AS snapshot_id, x.k AS posting_id, 'removed' AS kind FROM pairs p JOIN valid x ON x.s = p.a
  WHERE NOT EXISTS (SELECT 1 FROM valid y WHERE y.s = p.b AND y.k = x.k)
UNION ALL SELECT p.b, y.k, 'added' FROM pairs p JOIN valid y ON y.s = p.b
  WHERE NOT EXISTS (SELECT 1 FROM valid x WHERE x.s = p.a AND x.k = y.k)
UNION ALL SELECT p.b, y.k, 'changed' FROM pairs p JOIN valid x ON x.s = p.a JOIN valid y ON y.s = p.b AND y.k = x.k
  WHERE x.d <> y.d""",
}
QUERIES = {f.__name__: f for f in (p2_found, p2_descendants, p2_reachable, p2_roots, p5_found)}
