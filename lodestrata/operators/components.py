"""Connected components of rows that share keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodestrata.storage import cut, discard


def shared_key_components(entries: DataFrame, key: str, block: str) -> DataFrame:
    """``(key, component)``: rows connected through equal blocks; the component is its smallest key.

    entries: ``(key, block)``. Labels start as the row's own key and are lowered by turns to the
    least of their block and of their rows; a step from a label to that label's own label shortens
    long chains. Both are aggregates that combine before their shuffle, so a block that holds a
    large part of all rows costs no more than others. Every round is written to the shared folder;
    it ends when no label falls. Rows with a null block stand alone; null keys are left out.
    """
    links = entries.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(block).alias("b")).distinct()
    labels = before = cut(links.select("k", F.col("k").alias("c")).distinct(), "labels")
    members = cut(links.where("b IS NOT NULL"), "members")
    while True:
        least = members.join(labels, "k").groupBy("b").agg(F.min("c").alias("c"))
        lowered = members.join(least, "b").groupBy("k").agg(F.min("c").alias("n"))
        new = labels.join(lowered, "k", "left").select("k", F.col("c").alias("old"), F.least("c", F.coalesce("n", "c")).alias("c"))
        jump = labels.select(F.col("k").alias("c"), F.col("c").alias("far"))
        stepped = new.join(jump, "c", "left").select("k", "old", F.least("c", F.coalesce("far", "c")).alias("c"))
        seen = Observation()
        after = cut(stepped.observe(seen, F.count_if(F.col("c") < F.col("old")).alias("n")), "labels")
        discard(before)
        before = after
        if not seen.get["n"]:
            discard(members)
            return after.select(F.col("k").alias(key), F.col("c").alias("component"))
        labels = after.select("k", "c")


def related_groups(df: DataFrame, key: str, bases: dict[str, object], within: str) -> DataFrame:
    """``(key, group_id, basis, group_size)`` of rows of one ``within`` that are connected through any basis.

    bases: name to Column; nulls and '' connect nothing. ``basis`` joins the names through which the
    group's rows are connected, sorted, or is ``singleton``.
    """
    rows = None
    for name, column in sorted(bases.items()):
        one = df.select(F.col(key).alias("k"), F.struct(F.col(within).alias("w"), F.lit(name).alias("n"), F.nullif(column.cast("string"), F.lit("")).alias("v")).alias("s"))
        rows = one if rows is None else rows.unionByName(one)
    entries = rows.select("k", F.when(F.col("s.v").isNotNull(), F.to_json("s")).alias("b"), F.col("s.n").alias("n"))
    parts = shared_key_components(entries, "k", "b")
    shared = entries.where("b IS NOT NULL").groupBy("b", "n").agg(F.countDistinct("k").alias("c"), F.min("k").alias("k")).where("c > 1")
    used = shared.join(parts, "k").groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("n")), "+").alias("basis"))
    sizes = parts.groupBy("component").agg(F.count("*").alias("group_size"))
    return (
        parts.join(sizes, "component").join(used, "component", "left")
        .select(F.col("k").alias(key), F.concat(F.lit("grp:"), "component").alias("group_id"), F.coalesce("basis", F.lit("singleton")).alias("basis"), "group_size")
    )
