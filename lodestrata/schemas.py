"""Schemas of the sources; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# The fields of the files and tables below are what they are delivered with.
_S, _L = T.StringType(), T.LongType()
_NAMED = T.ArrayType(T.StructType([T.StructField("id", _L), T.StructField("name", _S)]))

JOB = T.StructType([
    T.StructField("id", _L), T.StructField("internal_job_id", _L), T.StructField("title", _S), T.StructField("content", _S),
    T.StructField("location", T.StructType([T.StructField("name", _S)])), T.StructField("departments", _NAMED), T.StructField("offices", _NAMED),
    T.StructField("absolute_url", _S), T.StructField("updated_at", _S), T.StructField("language", _S), T.StructField("company_name", _S),
])
BOARD_PAYLOAD = T.StructType([T.StructField("jobs", T.ArrayType(JOB)), T.StructField("meta", T.StructType([T.StructField("total", _L)]))])


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in names])


RAW_MANIFEST = strings("snapshot_id", "board_token", "file_path", "fetched_at", "http_status", "job_count", "sha256", "bytes")
EVENTS = T.StructType([
    T.StructField("event_id", _L), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", _L),
    T.StructField("event_type", _S), T.StructField("value", T.DoubleType()), T.StructField("props", _S),
])
POSTING = T.StructType([
    *strings("posting_id", "source", "source_job_id", "internal_job_id", "board_token", "company_name", "source_company_name", "title", "location").fields,
    T.StructField("departments", T.ArrayType(_S)), T.StructField("offices", T.ArrayType(_S)),
    *strings("raw_text", "clean_text", "absolute_url", "source_updated_at", "fetched_at", "snapshot_id", "industry", "industry_source", "source_language", "text_hash").fields,
    T.StructField("word_count", _L), T.StructField("is_placeholder", T.BooleanType()),
    *strings("exclusion_reason", "is_duplicate_of", "cleaning_version").fields,
])
