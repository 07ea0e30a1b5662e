"""Pairs of similar rows within blocks that share a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.functions.jvm import seq_ratio

PART = 500


def blocked_pairs(df: DataFrame, key: str, blocks: dict[str, list], within: str, carried: list[str] = (), made: dict[str, Column] | None = None) -> DataFrame:
    """``(key_a, key_b, basis, group_key)`` of rows of one ``within`` that share a block.

    blocks: basis to its Column, whose null and '' make no block. A pair found by several bases is
    one row: bases joined by '+', group keys by ' | ', in the order of the basis names. The pairs
    of a block are wanted by definition (it is a review list); a large block's are made by a task
    for each ``PART`` rows, which meet the whole of it.

    df: a row for each key. carried: columns to add for both sides, as ``c_a`` and ``c_b``; rows
    bring them to their blocks, so that what is shuffled grows with the rows, not with the pairs.
    made: further ones, made of the carried ones once they are there.
    """
    names = sorted(blocks)
    values = {n: f"_block_{i}" for i, n in enumerate(names)}
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(within).alias("_w"), *[F.nullif(blocks[n].cast("string"), F.lit("")).alias(v) for n, v in values.items()], *carried)
    entries = rows.select("_k", "_w", F.posexplode(F.array(*values.values())).alias("_basis", "_block")).where("_block IS NOT NULL")
    sizes = entries.groupBy("_w", "_basis", "_block").agg(F.count("*").alias("_n")).where("_n > 1")
    placed = entries.join(sizes, ["_w", "_basis", "_block"]).select("_k", "_basis", "_block", F.ceil(F.col("_n") / PART).cast("int").alias("_parts"))
    rows = rows.join(placed, "_k")
    at = ["_w", "_basis", "_block", "_part"]

    def side(s: str, part: Column) -> DataFrame:
        there = rows.withColumn("_part", part).repartition(*at).withColumns(made or {})
        return there.select(*at, *[F.col(c).alias(f"{c}_{s}") for c in ("_k", *values.values(), *carried, *(made or {}))])

    left = side("a", F.pmod(F.xxhash64("_k"), "_parts").cast("int"))
    right = side("b", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    shared = {n: F.coalesce(F.col(f"{v}_a") == F.col(f"{v}_b"), F.lit(False)) for n, v in values.items()}
    first = F.coalesce(*[F.when(shared[n], i) for i, n in enumerate(names)])
    pairs = left.join(right, at).where((F.col("_k_a") < F.col("_k_b")) & (F.col("_basis") == first))
    return pairs.select(
        F.col("_k_a").alias(f"{key}_a"), F.col("_k_b").alias(f"{key}_b"),
        F.concat_ws("+", *[F.when(shared[n], F.lit(n)) for n in names]).alias("basis"),
        F.concat_ws(" | ", *[F.when(shared[n], F.concat(F.lit(f"{n}="), f"{v}_a")) for n, v in values.items()]).alias("group_key"),
        *[f"{c}_{s}" for c in (*carried, *(made or {})) for s in "ab"],
    )


def near_duplicate_candidates(df: DataFrame, ratio: bool = True) -> DataFrame:
    """The review list of postings of one board that share the internal job id or the title.

    With ``token_jaccard``, ``exact_text_match`` and, by ``ratio``, ``text_similarity``
    (Ratcliff-Obershelp, which is computed once a pair).
    """
    rows = df.withColumn("_t", F.coalesce("clean_text", F.lit("")))
    blocks = {"internal_job_id": F.col("internal_job_id"), "title": X.title_key(F.col("title"))}
    carried = ["board_token", "title", "location", "internal_job_id", "exclusion_reason", "text_hash", "_t"]
    found = blocked_pairs(rows, "posting_id", blocks, "board_token", carried, {"_s": X.token_set(F.col("_t"))})
    shared = F.size(F.array_intersect("_s_a", "_s_b"))
    found = found.withColumn("shared_tokens", shared).withColumn("all_tokens", F.size("_s_a") + F.size("_s_b") - F.col("shared_tokens"))
    return found.select(
        F.lit("candidate").alias("status"), F.col("board_token_a").alias("board_token"), "basis", "group_key", "posting_id_a", "posting_id_b",
        *[f"{c}_{s}" for c in ("title", "location", "internal_job_id") for s in "ab"],
        *([F.round(seq_ratio(df.sparkSession, "_t_a", "_t_b"), 4).alias("text_similarity")] if ratio else []),
        "shared_tokens", "all_tokens",
        F.round(F.when(F.col("all_tokens") == 0, 1.0).otherwise(F.col("shared_tokens") / F.col("all_tokens")), 4).alias("token_jaccard"),
        F.coalesce(F.col("text_hash_a") == F.col("text_hash_b"), F.lit(False)).alias("exact_text_match"),
        "exclusion_reason_a", "exclusion_reason_b",
    )
