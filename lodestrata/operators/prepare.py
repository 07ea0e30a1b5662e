"""From raw nested records to clean, flagged, de-duplicated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.functions.rules import placeholder_reason
from lodestrata.functions.udfs import html_to_text, norm_key


def names(column: str) -> Column:
    """Names of an array of structs, without null entries and names; a null array is empty."""
    kept = F.filter(F.col(column), lambda x: x.isNotNull() & x["name"].isNotNull())
    return F.coalesce(F.transform(kept, lambda x: x["name"]), F.array().cast("array<string>"))


def build_rows(jobs: DataFrame, boards: DataFrame, version: str) -> DataFrame:
    """The clean rows of raw jobs: columns ``board_token, snapshot_id, fetched_at, job`` (a struct as in ``schemas.JOB``).

    boards: ``board_token, board_order, company_name, industry, industry_source`` - a list kept by
    hand, which the planner broadcasts by its size. Jobs of unknown boards are left out; see
    ``unmatched_boards``. The order for duplicates is the boards' own, then the numeric job id.
    """
    rows = jobs.join(boards.withColumnRenamed("company_name", "board_company"), "board_token").select(
        *boards.drop("company_name").columns, "board_company", "snapshot_id", "fetched_at", "job.*"
    )
    clean = rows.withColumn("clean_text", html_to_text("content"))
    reason = placeholder_reason(F.col("title"), F.col("clean_text"))
    built = clean.select(
        F.concat_ws(":", F.lit("board"), "board_token", F.col("id").cast("string")).alias("posting_id"),
        F.lit("board").alias("source"), F.col("id").cast("string").alias("source_job_id"),
        F.col("internal_job_id").cast("string").alias("internal_job_id"), "board_token", F.col("board_company").alias("company_name"),
        F.col("company_name").alias("source_company_name"), "title", F.col("location.name").alias("location"),
        names("departments").alias("departments"), names("offices").alias("offices"),
        F.col("content").alias("raw_text"), "clean_text", "absolute_url", F.col("updated_at").alias("source_updated_at"),
        "fetched_at", "snapshot_id", "industry", "industry_source", F.col("language").alias("source_language"),
        F.sha2(F.nullif(norm_key("clean_text"), F.lit("")), 256).alias("text_hash"),
        X.word_count(F.col("clean_text")).alias("word_count"), reason.isNotNull().alias("is_placeholder"),
        X.reasons(
            (F.col("content").isNull(), "missing_description"),
            (F.col("content").isNotNull() & (F.col("clean_text") == ""), "empty_description"),
            (reason.isNotNull(), reason),
        ).alias("exclusion_reason"),
        F.lit(version).alias("cleaning_version"), "board_order", F.col("id").cast("bigint").alias("job_number"),
    )
    return mark_duplicates(built, ["board_order", "job_number"]).drop("board_order", "job_number")


def unmatched_boards(jobs: DataFrame, boards: DataFrame) -> DataFrame:
    """Boards of the data that the list doesn't have: an error for the caller."""
    return jobs.select("board_token").distinct().join(boards, "board_token", "left_anti")


def mark_duplicates(df: DataFrame, order: list[str], key: str = "posting_id", digest: str = "text_hash", reason: str = "exclusion_reason") -> DataFrame:
    """Adds ``is_duplicate_of``, the first row in ``order`` with equal ``digest``, and the reason ``exact_duplicate``.

    Rows with a null digest are no duplicates. The first of each digest is found by an aggregate
    that is combined before its shuffle and joined back, so a digest that very many rows share
    isn't sorted in one task; ties in ``order`` go to the smaller key.
    """
    first = df.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(F.struct(*order, key)).alias("_first"), F.count("*").alias("_n"))
    first = first.where("_n > 1").select(digest, F.col("_first")[key].alias("_first_key"))
    copy = F.col("_first_key").isNotNull() & (F.col("_first_key") != F.col(key))
    joined = df.join(first, digest, "left")
    return joined.select(
        *[c for c in df.columns if c not in (reason, "is_duplicate_of")],
        F.concat_ws(";", F.nullif(reason, F.lit("")), F.when(copy, "exact_duplicate")).alias(reason),
        F.when(copy, F.col("_first_key")).alias("is_duplicate_of"),
    )


def usable(df: DataFrame) -> DataFrame:
    """Rows without a reason to leave them out."""
    return df.where(F.col("exclusion_reason") == "")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``; for bounded groups (``snapshots.valid_rows`` takes any)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
