"""Valid rows of repeatedly delivered tables, and what changed between full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class EmptySnapshot(ValueError):
    """A snapshot that isn't in the table."""


def valid_rows(df: DataFrame, keys: list[str], version: str, columns: list[str]) -> DataFrame:
    """Of several rows with equal ``keys`` the one with the greatest ``version``.

    Result: ``keys`` and ``columns``. Rows with a null in ``keys`` name no record and are left
    out; a null ``version`` is older than any other. Rows equal in keys and version are taken to
    be equal in all; if they are not, the greatest values in the order of ``columns`` win, so
    that the result is the same on every run. The aggregate is combined before the shuffle, so a
    key that holds a large part of all rows reaches its reducer as one row from each map task.
    """
    there = F.lit(True)
    for k in keys:
        there = there & F.col(k).isNotNull()
    newest = F.max(F.struct(F.col(version).alias("_version"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)]))
    return (
        df.where(there)
        .groupBy(*keys)
        .agg(newest.alias("_newest"))
        .select(*keys, *[F.col(f"_newest._{i}").alias(c) for i, c in enumerate(columns)])
    )


def latest_snapshot(df: DataFrame, snapshot: str = "snapshot_id") -> str | None:
    """The greatest snapshot id (one value; only that column is read); None for an empty table."""
    return df.agg(F.max(snapshot)).first()[0]


def snapshot_rows(df: DataFrame, snapshot_id: str | None, order: str, snapshot: str = "snapshot_id") -> DataFrame:
    """The rows of one snapshot in order. That there are none is an error, not an empty result."""
    rows = df.where(F.col(snapshot) == F.lit(snapshot_id))
    if rows.isEmpty():
        raise EmptySnapshot(f"no rows of snapshot {snapshot_id}")
    return rows.orderBy(order)


def snapshot_changes(
    df: DataFrame,
    snapshot: str = "snapshot_id",
    key: str = "posting_id",
    digest: str = "text_hash",
    version: str = "fetched_at",
) -> DataFrame:
    """Records added, removed or changed from each full snapshot to the next.

    Result: ``snapshot`` (the later one), ``key`` and ``kind``: ``added``, ``removed`` or
    ``changed``. Snapshots are numbered in the order of their ids; every record is windowed over
    those numbers, so that one pass finds, for any number of snapshots, changes (the previous
    row's digest differs), removals (the next row is not of the next snapshot) and additions,
    first or renewed (the previous row is not of the previous snapshot).

    The first snapshot gives no rows. A null digest equals null and differs from any value. Rows
    without a snapshot or key are left out; repeated rows count once (see ``valid_rows``). An
    empty table, or one with a single snapshot, gives no rows. Other columns, whatever their
    names, are not read.
    """
    rows = df.select(
        F.col(snapshot).alias("s"), F.col(key).alias("k"), F.col(digest).alias("d"), F.col(version).alias("v")
    )
    valid = valid_rows(rows, ["s", "k"], "v", ["d"])
    # As many rows as there are snapshots: the only window without a partition.
    order = Window.orderBy("s")
    numbers = (
        rows.where(F.col("s").isNotNull()).select("s").distinct()
        .select("s", F.row_number().over(order).alias("i"), F.lead("s").over(order).alias("following"))
    )
    by_key = Window.partitionBy("k").orderBy("i")
    placed = valid.join(numbers, "s").select(
        "k", "s", "i", "d", "following",
        F.lag("i").over(by_key).alias("i_before"),
        F.lag("d").over(by_key).alias("d_before"),
        F.lead("i").over(by_key).alias("i_after"),
    )
    came = F.when(
        (F.col("i") > 1) & (F.col("i_before").isNull() | (F.col("i_before") < F.col("i") - 1)),
        F.struct(F.col("s").alias("s"), F.lit("added").alias("kind")),
    ).when(
        (F.col("i_before") == F.col("i") - 1) & ~F.col("d").eqNullSafe(F.col("d_before")),
        F.struct(F.col("s").alias("s"), F.lit("changed").alias("kind")),
    )
    went = F.when(
        F.col("following").isNotNull() & (F.col("i_after").isNull() | (F.col("i_after") > F.col("i") + 1)),
        F.struct(F.col("following").alias("s"), F.lit("removed").alias("kind")),
    )
    return placed.select("k", F.explode(F.array_compact(F.array(came, went))).alias("e")).select(
        F.col("e.s").alias(snapshot), F.col("k").alias(key), F.col("e.kind").alias("kind")
    )
