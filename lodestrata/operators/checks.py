"""Constraints as queries: each gives the rows that break it, so an empty result means it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Formats of identifiers.
FORMATS = {
    "snapshot_id": r"^\d{8}T\d{6}Z$", "sha256": r"^[0-9a-f]{64}$", "board_token": r"^[A-Za-z0-9_-]+$",
    "date": r"^\d{4}-\d{2}-\d{2}$", "annotator_id": r"^[a-z][a-z0-9_]*$", "version": r"^v\d+\.\d+(\.\d+)?$",
}


class CheckFailed(ValueError):
    """A constraint that doesn't hold."""


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``rows`` of keys that stand more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def missing_references(df: DataFrame, column: str, targets: DataFrame, target: str) -> DataFrame:
    """Rows whose non-null ``column`` names no ``target``."""
    known = targets.select(F.col(target).alias("_t")).where("_t IS NOT NULL").distinct()
    return df.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_t"), "left_anti")


def violations(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which ``predicate`` is false; null passes, as in SQL."""
    return df.where(~predicate)


def several_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, values)`` of those columns that should hold one value and hold several or none."""
    one = df.agg(*[F.countDistinct(c).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("values")) for c in columns]))
    return one.select(pairs.alias("p")).select("p.*").where("values <> 1")


def row_problems(df: DataFrame) -> Column:
    """Array of what is wrong with a posting row: identifiers, formats, flags and counts that don't agree."""
    c = F.col
    bad = lambda condition, text: F.when(F.coalesce(condition, F.lit(False)), text)
    placeholder = F.coalesce(c("exclusion_reason").contains("placeholder_"), F.lit(False))
    return F.array_compact(F.array(
        *[bad(c(k).isNull() | (F.trim(c(k)) == ""), f"{k} is missing") for k in ("posting_id", "source", "source_job_id", "board_token", "company_name", "fetched_at", "cleaning_version")],
        bad(c("posting_id") != F.concat_ws(":", "source", "board_token", "source_job_id"), "posting_id doesn't follow from its parts"),
        bad(c("snapshot_id").isNull() | ~c("snapshot_id").rlike(FORMATS["snapshot_id"]), "snapshot_id has another form"),
        bad(c("text_hash").isNotNull() & ~c("text_hash").rlike(FORMATS["sha256"]), "text_hash is no SHA-256"),
        bad(c("clean_text").isNull(), "clean_text is null"),
        bad((F.trim(c("clean_text")) == "") != c("text_hash").isNull(), "text_hash and clean_text disagree"),
        bad(c("word_count") < 0, "word_count is negative"),
        bad((c("word_count") > 0) & c("text_hash").isNull(), "words without text"),
        bad(c("is_placeholder") != placeholder, "is_placeholder and exclusion_reason disagree"),
        bad(c("is_duplicate_of").isNotNull() != F.array_contains(F.split("exclusion_reason", ";"), "exact_duplicate"), "is_duplicate_of and exclusion_reason disagree"),
        bad(c("is_duplicate_of") == c("posting_id"), "a duplicate of itself"),
        bad(c("exclusion_reason").isNull(), "exclusion_reason is null"),
        bad(c("departments").isNull() | c("offices").isNull(), "lists are null"),
    ))


def problem_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode(row_problems(df)).alias("problem")).groupBy("problem").agg(F.count("*").alias("rows"))


def require_empty(df: DataFrame, what: str, show: int = 3) -> None:
    """Raise ``CheckFailed`` with some of the rows if there are any."""
    rows = df.limit(show).collect()
    if rows:
        raise CheckFailed(f"{what}: {[r.asDict() for r in rows]}")


def unsettled(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``(keys, column, values)`` of those columns that should hold one value for each key and hold several, or none."""
    one = df.groupBy(*keys).agg(*[F.countDistinct(c).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("values")) for c in columns]))
    return one.select(*keys, pairs.alias("p")).select(*keys, "p.*").where("values <> 1")
