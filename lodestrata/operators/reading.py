"""Lazy read views of a corpus: filters, facets, joined details, held-out rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.analytics import facets
from lodestrata.storage import cut


def filtered(df: DataFrame, equal: dict[str, str] | None = None, state: str = "", reason: str = "exclusion_reason", contains: dict[str, str] | None = None) -> DataFrame:
    """Rows that meet all conditions; empty values are no condition.

    ``state``: usable, excluded, or one exact reason. ``contains`` compares without case.
    """
    for column, value in (equal or {}).items():
        if value:
            df = df.where(F.col(column) == value)
    if state == "usable":
        df = df.where(F.col(reason) == "")
    elif state == "excluded":
        df = df.where(F.col(reason) != "")
    elif state:
        df = df.where(F.col(reason) == state)
    for column, value in (contains or {}).items():
        if value:
            df = df.where(F.contains(F.lower(column), F.lit(value.lower())))
    return df


def listing(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    return df.select(*columns).orderBy(*order)


def details(base: DataFrame, key: str, sides: dict[str, DataFrame], counts: dict[str, DataFrame]) -> DataFrame:
    """``base`` with one column from each side ('' where missing) and the number of rows in each of ``counts``, aggregated before the join."""
    for column, side in sides.items():
        base = base.join(side.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit("")))
    for name, rows in counts.items():
        base = base.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    return base


def held_out(manifest: DataFrame, key: str = "posting_id", members: str = "group_members", split: str = "split") -> DataFrame:
    """Keys that must not be shown in development: evaluation rows and all members of their groups that aren't development rows."""
    evaluation = manifest.where(F.col(split) == "evaluation")
    ids = evaluation.select(key).unionByName(evaluation.select(F.explode(F.split(members, ";")).alias(key))).where(F.col(key) != "").distinct()
    return ids.join(manifest.where(F.col(split) == "development"), key, "left_anti")


def visible(df: DataFrame, hidden: DataFrame, key: str = "posting_id") -> DataFrame:
    return df.join(hidden, key, "left_anti")


def refusals(wanted: DataFrame, known: DataFrame, hidden: DataFrame, key: str = "posting_id") -> DataFrame:
    """``(key, reason)`` of wanted ids that can't be given: ``unknown`` or ``held out``; each once. Nulls are unknown."""
    there = known.select(F.col(key), F.lit(True).alias("_there")).distinct()
    held = hidden.select(F.col(key), F.lit(True).alias("_held")).distinct()
    joined = wanted.select(key).distinct().join(there, key, "left").join(held, key, "left")
    return joined.select(key, F.when(F.col("_there").isNull(), "unknown").when(F.col("_held"), "held out").alias("reason")).where("reason IS NOT NULL")


def numbered(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """``df`` with each row's place in a total order, from 1.

    The rows are cut into ranges of the order, numbered in each, and each range is moved on by the
    rows of those before it; no task sees more than a range. ``order``: columns that make it total.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    # As many rows as there are partitions.
    moved = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(moved, "_range").withColumn(name, F.col("_before") + own).drop("_range", "_before")


def first_ids(df: DataFrame, key: str, most: int | None) -> DataFrame:
    """The sorted ids, the first ``most`` of them where that is given; fewer than one is an error."""
    if most is not None and most < 1:
        raise ValueError("at least one row must be asked for")
    rows = df.select(key).orderBy(key)
    return rows if most is None else rows.limit(most)


def sql_rows(statement: str, args: dict, **tables: DataFrame) -> DataFrame:
    """A read-only statement with named parameters over tables by name. Only queries are taken."""
    if not statement.lstrip().lower().startswith(("select", "with")):
        raise ValueError("only queries are read")
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(statement, args=args, **tables)


def overview(df: DataFrame, columns: list[str]) -> DataFrame:
    """The different values that a filter form offers."""
    return facets(df, columns)


def lookup(df: DataFrame, **key) -> DataFrame:
    """The rows of one key; the filters reach the scan."""
    for column, value in key.items():
        df = df.where(F.col(column).eqNullSafe(F.lit(value)))
    return df


def newest_first(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    ordered = df.orderBy(F.desc(column))
    return ordered.limit(most) if most else ordered
