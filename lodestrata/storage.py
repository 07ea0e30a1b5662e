"""Tables written to the shared folder to cut lineage.

A long plan that is read several times, or grown in a loop, is written once to
``spark.checkpoint.dir`` - a folder every executor can reach - and read again. A lost
executor then costs its running tasks only. The folder is taken from the session; a
machine-local one is set only where the session names none, as in tests.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or a temporary folder where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written to the shared folder and read again, its lineage gone."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut_counted(df: DataFrame, name: str = "cut") -> tuple[DataFrame, int]:
    """``cut``, with the number of rows, which is counted while they are written."""
    seen = Observation()
    table = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return table, seen.get["rows"]


def together(tables: list[DataFrame]) -> DataFrame:
    """Tables of one schema that ``cut`` wrote, read as one, in a single scan."""
    spark = tables[0].sparkSession
    return spark.read.schema(tables[0].schema).parquet(*[table._cut_path for table in tables])


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote, once nothing will read them again."""
    for table in tables:
        entry = (table.sparkSession, table._cut_path)
        _remove(*entry)
        _written.remove(entry)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_all() -> None:
    for entry in _written:
        try:
            _remove(*entry)
        except Exception:  # the session may have ended already
            return
