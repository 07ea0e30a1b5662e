"""Tables that appear whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def append(df: DataFrame, path: str, partition: str | None = None) -> int:
    """Add rows to a Parquet table and return their number.

    They are written to a staging folder beside the table and its files moved in one by one after
    all are complete; a failure before that leaves the table as it was and removes the staging
    folder. One writer at a time is assumed, as the storage has no transactions.
    """
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    fs, staged = _fs(spark, staging)
    seen = Observation()
    try:
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write
        (writer.partitionBy(partition) if partition else writer).parquet(staging)
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = fs.listFiles(staged, True)
        root = staged.toUri().getPath()
        moves = []
        while files.hasNext():
            file = files.next().getPath()
            if not file.getName().startswith(("_", ".")):
                moves.append((file, jpath(path + file.toUri().getPath()[len(root):])))
        for file, to in moves:
            fs.mkdirs(to.getParent())
            if not fs.rename(file, to):
                raise OSError(f"could not publish {to}")
        return seen.get["rows"]
    finally:
        fs.delete(staged, True)


def replace(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Put a new table in place of the one at ``path``, which stays readable until the new one is complete."""
    spark = df.sparkSession
    staging, old = (f"{path.rstrip('/')}.{x}-{uuid.uuid4().hex}" for x in ("staging", "old"))
    fs, target = _fs(spark, path)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    (df.write.partitionBy(partition) if partition else df.write).parquet(staging)
    if fs.exists(target):
        fs.rename(target, jpath(old))
    fs.rename(jpath(staging), target)
    fs.delete(jpath(old), True)


def export(tables: dict[str, DataFrame], path: str, stamp: str, protected: tuple[str, ...] = ()) -> str:
    """Tables in a new folder of their time below ``path``; a folder that is there or lies in a protected one is refused."""
    target = f"{path.rstrip('/')}/{stamp}"
    if any(target == p.rstrip("/") or target.startswith(p.rstrip("/") + "/") for p in protected):
        raise ValueError(f"{target} lies in a protected folder")
    first = next(iter(tables.values()))
    if exists(first.sparkSession, target):
        raise ValueError(f"{target} is there")
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{target}/{name}")
    return target


def snapshot(df: DataFrame, path: str, snapshot_id: str) -> None:
    """An immutable snapshot folder; an existing one is never overwritten."""
    df.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/snapshot_id={snapshot_id}")


def append_manifest(rows: DataFrame, path: str, keys: list[str], digest: str) -> int:
    """Add manifest rows whose keys are new; a known key with another digest is an error."""
    from lodestrata.operators.checks import require_empty

    spark = rows.sparkSession
    if not exists(spark, path):
        return append(rows, path)
    stored = spark.read.schema(rows.schema).parquet(path)
    old = stored.select(*keys, F.col(digest).alias("_old"))
    require_empty(rows.join(old, keys).where(~F.col(digest).eqNullSafe(F.col("_old"))), "registered with another digest")
    fresh = rows.join(old, keys, "left_anti")
    return 0 if fresh.isEmpty() else append(fresh, path)
