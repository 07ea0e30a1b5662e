"""Checked merges and unions of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.checks import CheckFailed, duplicate_keys, require_empty


def checked_merge(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", one: str = "right") -> DataFrame:
    """The join by ``keys``, after a check that they are unique in ``right``, in ``left`` or in ``both``; columns that both have are an error."""
    clash = set(left.columns) & set(right.columns) - set(keys)
    if clash:
        raise CheckFailed(f"both tables have {sorted(clash)}")
    for side, df in (("left", left), ("right", right)):
        if one in (side, "both"):
            require_empty(duplicate_keys(df, keys), f"repeated keys on the {side}")
    return left.join(right, keys, how)


def union_checked(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables' rows, of which the second's don't have keys of the first."""
    return first.unionByName(second.join(first, keys, "left_anti"))


def concat_distinct(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """The tables' rows one after the other, of equal keys the first table's, ties by the other columns."""
    rows = None
    for i, df in enumerate(tables):
        one = df.withColumn("_turn", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    others = [c for c in tables[0].columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct("_turn", *others)).alias("_w")).select(*keys, *[F.col(f"_w.{c}").alias(c) for c in others])
