"""Event logs: order, idempotence and state, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrata.schemas import EVENTS
from lodestrata.sinks.publish import exists
from lodestrata.storage import scratch


def versions(events: DataFrame, scope: str, order: list[str]) -> DataFrame:
    """Adds ``version``, the event's number within its scope, from 1."""
    return events.withColumn("version", F.row_number().over(Window.partitionBy(scope).orderBy(*order)))


def once(events: DataFrame, request: str, order: str) -> DataFrame:
    """The first event of each request id; null ids are no retries and stay."""
    first = events.where(F.col(request).isNotNull()).groupBy(request).agg(F.min_by(F.struct(*events.columns), order).alias("e")).select("e.*")
    return first.unionByName(events.where(F.col(request).isNull()))


def open_after(events: DataFrame, scope: str, order: str, kind: str, closing: str) -> DataFrame:
    """``(scope, closed)``: whether the scope's last event is a closing one; any later event opens it again."""
    last = events.groupBy(scope).agg(F.max(F.when(F.col(kind) == closing, F.col(order))).alias("c"), F.max(order).alias("m"))
    return last.select(scope, F.coalesce(F.col("c") == F.col("m"), F.lit(False)).alias("closed"))


def read_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """New Parquet files of events as a stream; times are taken as UTC so that watermarks accept them."""
    reader = spark.readStream.schema(EVENTS)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """``(start, event_type, events, value)`` of tumbling windows; rows later than ``late`` are left out."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "events", "value")


def deduplicated(events: DataFrame, request: str, late: str) -> DataFrame:
    """Events without repeats of a request id that arrive within ``late`` of each other."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([request])


def running_versions(events: DataFrame) -> DataFrame:
    """``(user_id, version, total)`` after each micro-batch: how many events a user has and their sum, kept as state."""
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n += len(pdf)
            total += float(pdf["value"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "version": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id bigint, version bigint, total double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)


def collected(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now, as a table in the shared folder, with ``batch``, the micro-batch that gave it.

    Every micro-batch is written to its own folder, so that one that is run again after a failure
    replaces what it had written. The checkpoint lies in the shared folder too.
    """
    spark = stream.sparkSession
    path, checkpoint = scratch(spark, "stream"), scratch(spark, "stream-checkpoint")
    run_once(stream, lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}"), checkpoint, mode)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).option("basePath", path).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def run_once(stream: DataFrame, sink, checkpoint: str, mode: str = "append"):
    """Process what is there now with ``sink(batch, number)`` and stop; the checkpoint lets the next run go on from there."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
