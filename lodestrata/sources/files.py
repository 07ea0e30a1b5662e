"""Strict readers of JSON, JSON lines, CSV and files with recorded hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.schemas import BOARD_PAYLOAD


class SourceError(ValueError):
    """Input that isn't what it should be."""


def read_jobs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, job)`` of board payloads, one JSON object a file; files without a list of jobs give none (see ``bad_payloads``)."""
    raw = spark.read.schema(BOARD_PAYLOAD).option("multiLine", True).json(paths)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.explode("jobs").alias("job"))


def bad_payloads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path)`` of files that aren't a JSON object with a list ``jobs``."""
    parsed = F.from_json(F.col("content").cast("string"), BOARD_PAYLOAD)
    return spark.read.format("binaryFile").load(paths).where(parsed.isNull() | parsed["jobs"].isNull()).select("path")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines of exactly the schema's fields; a blank or broken line, a missing or an unknown field is an error."""
    lines = spark.read.text(path)
    keys = F.array_sort(F.json_object_keys("value"))
    wanted = F.array(*[F.lit(n) for n in sorted(schema.fieldNames())])
    wrong = lines.where(~F.coalesce(keys == wanted, F.lit(False))).limit(3).collect()
    if wrong:
        raise SourceError(f"{path}: {[r[0][:80] for r in wrong]}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, ragged: bool = False) -> DataFrame:
    """CSV with exactly this header and as many fields in every row; empty fields are ''.

    ``ragged``: short rows are filled up instead. The header is compared on the driver, which reads
    the first line only.
    """
    first = spark.read.text(path).limit(1).collect()
    header = [h.strip().strip('"') for h in first[0][0].lstrip("﻿").split(",")] if first else []
    if header != schema.fieldNames():
        raise SourceError(f"{path}: the header is {header}, not {schema.fieldNames()}")
    full = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    rows = spark.read.schema(full).options(header=True, multiLine=True, quote='"', escape='"', columnNameOfCorruptRecord="_broken", enforceSchema=True, mode="PERMISSIVE", maxCharsPerColumn=-1).csv(path)
    if not ragged:
        broken = rows.select("_broken", *schema.fieldNames()).where("_broken IS NOT NULL").limit(3).collect()
        if broken:
            raise SourceError(f"{path}: rows of another width: {[r[0] for r in broken]}")
    return rows.select(*[F.coalesce(n, F.lit("")).alias(n) for n in schema.fieldNames()])


def profile_csv(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """A CSV's header, without a byte-order mark, and its number of rows."""
    rows = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    return [c.lstrip("﻿") for c in rows.columns], rows.count()


def numbered(df: DataFrame, order: str) -> DataFrame:
    """Rows of a small file with their number from 1, in the order of a column that has one value a row."""
    from pyspark.sql import Window

    return df.withColumn("source_row", F.row_number().over(Window.orderBy(order)))


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, bytes, sha256)`` of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(path, problem)``: registered files that are missing or differ in size or hash."""
    joined = manifest.alias("m").join(found.alias("f"), F.col("m.path") == F.col("f.path"), "left")
    problem = F.when(F.col("f.path").isNull(), "missing").when(F.col("m.bytes").cast("bigint") != F.col("f.bytes"), "size differs").when(F.col("m.sha256") != F.col("f.sha256"), "hash differs")
    return joined.select(F.col("m.path").alias("path"), problem.alias("problem")).where("problem IS NOT NULL")


def newest_verified(manifest: DataFrame, found: DataFrame, key: str = "board_token", version: str = "snapshot_id") -> DataFrame:
    """The newest successful manifest row of each key whose file is as registered."""
    good = manifest.where("http_status = '200'").join(found.select(F.col("path").alias("file_path"), F.col("sha256"), F.col("bytes").cast("string").alias("bytes")), ["file_path", "sha256", "bytes"], "left_semi")
    return good.groupBy(key).agg(F.max_by(F.struct(*manifest.columns), version).alias("r")).select("r.*")


def or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, or no rows if the path isn't there."""
    from lodestrata.sinks.publish import exists

    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)
