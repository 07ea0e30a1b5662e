"""Cached, resumable calls of a pluggable completion backend, and judging of what it returns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import cache_key
from lodestrata.functions.udfs import schema_errors_udf
from lodestrata.operators.checks import CheckFailed
from lodestrata.sinks import publish


def with_keys(postings: DataFrame, **fixed: str) -> DataFrame:
    """Adds ``cache_key`` over the text's hash and fixed fields (model, prompt and schema versions)."""
    return postings.withColumn("cache_key", cache_key(text=F.sha2(F.coalesce("clean_text", F.lit("")), 256), **{k: F.lit(v) for k, v in fixed.items()}))


def call_plan(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """``(posting_id, cache_key, action)``: ``cached (valid)``, ``cached (invalid, would re-call)`` or ``would call``.

    cache: ``(cache_key, valid, received_at)``, of which the newest of each key counts.
    """
    newest = cache.groupBy("cache_key").agg(F.max_by("valid", "received_at").alias("_valid"))
    action = F.when(F.col("_valid").isNull(), "would call").when(F.col("_valid"), "cached (valid)").otherwise("cached (invalid, would re-call)")
    return requests.join(newest, "cache_key", "left").select("posting_id", "cache_key", action.alias("action"))


def remaining(requests: DataFrame, done: DataFrame) -> DataFrame:
    """Requests whose posting isn't completed (status ``ok`` or ``zero_skills``)."""
    return requests.join(done.where(F.col("status").isin("ok", "zero_skills")), "posting_id", "left_anti")


def complete(requests: DataFrame, backend: Callable[[str], dict]) -> DataFrame:
    """``(posting_id, cache_key, body, stop_reason, input_tokens, output_tokens)`` of a backend called for each ``prompt``.

    The backend is any picklable function of a prompt; one that raises gives stop_reason ``error``.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for pid, key, prompt in zip(pdf["posting_id"], pdf["cache_key"], pdf["prompt"], strict=True):
                try:
                    r = backend(prompt)
                except Exception as e:
                    r = {"body": str(e), "stop_reason": "error"}
                rows.append((pid, key, r.get("body"), r.get("stop_reason"), r.get("input_tokens", 0), r.get("output_tokens", 0)))
            yield pd.DataFrame(rows, columns=["posting_id", "cache_key", "body", "stop_reason", "input_tokens", "output_tokens"])

    return requests.select("posting_id", "cache_key", "prompt").mapInPandas(run, "posting_id string, cache_key string, body string, stop_reason string, input_tokens bigint, output_tokens bigint")


#: How a call may stop, and what that means for its result; other stops are unexpected.
STOPS = {"end_turn": None, "refusal": "refusal", "max_tokens": "truncated"}


def judge(responses: DataFrame, schema: dict) -> DataFrame:
    """Adds ``status`` (``ok``, ``zero_skills`` or ``failed``) and ``problem``: refusal, truncation, unexpected stop, no text, invalid JSON, schema errors, or an empty list without a reason.

    Stops and blank bodies are told in the JVM; only finished bodies are parsed against the schema, in Arrow batches.
    """
    errors = schema_errors_udf(schema)
    stop, body = F.col("stop_reason"), F.col("body")
    known = F.coalesce(*[F.when(stop == k, F.lit(v)) for k, v in STOPS.items() if v], F.when(F.coalesce(stop != "end_turn", F.lit(True)), F.concat(F.lit("unexpected stop: "), F.coalesce(stop, F.lit("None")))))
    told = responses.withColumn("_stop", F.coalesce(known, F.when(F.trim(F.coalesce(body, F.lit(""))) == "", "no text")))
    parsed = told.withColumn("_errors", errors(F.when(F.col("_stop").isNull(), body)))
    items = F.coalesce(F.json_array_length(F.get_json_object("body", "$.skills")), F.lit(0))
    why = F.trim(F.coalesce(F.get_json_object("body", "$.no_skills_reason"), F.lit("")))
    broken = F.when(F.col("_stop").isNull() & (F.size("_errors") > 0), F.regexp_replace(F.array_join(F.slice("_errors", 1, 3), "; "), r"^\$: invalid JSON$", "invalid JSON"))
    problem = F.coalesce("_stop", broken, F.when((items == 0) & (why == ""), "no skills and no reason"))
    return parsed.withColumn("problem", problem).withColumn("status", F.when(F.col("problem").isNotNull(), "failed").when(items == 0, "zero_skills").otherwise("ok")).drop("_stop", "_errors")


def run_totals(judged: DataFrame) -> DataFrame:
    """One row: postings by status, attempts and cache hits where the rows have them, and tokens, missing ones as 0."""
    extra = [F.sum(F.coalesce(F.size("attempts"), F.lit(0))).alias("attempts")] if "attempts" in judged.columns else []
    extra += [F.count_if("cache_hit").alias("cache_hits")] if "cache_hit" in judged.columns else []
    return judged.agg(
        *extra,
        *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "zero_skills", "failed")],
        *[F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")],
    )


def request_params(model: str, most_tokens: int, system: str, prompt: str = "prompt"):
    """The request of a prompt column as JSON: fields in a fixed order, so that equal requests are equal texts."""
    return F.to_json(F.struct(
        F.lit(most_tokens).alias("max_tokens"), F.array(F.struct(F.col(prompt).alias("content"), F.lit("user").alias("role"))).alias("messages"), F.lit(model).alias("model"), F.lit(system).alias("system"),
    ))


def store_responses(responses: DataFrame, path: str) -> int:
    """Add responses to the history at ``path``; nothing is ever overwritten. Returns their number."""
    return publish.append(responses, path)


def latest_responses(history: DataFrame) -> DataFrame:
    """The cache that a history of responses stands for: the newest of each ``cache_key`` by ``received_at``, ties by ``posting_id``."""
    order = F.struct("received_at", "posting_id")
    return history.groupBy("cache_key").agg(F.max_by(F.struct(*history.columns), order).alias("r")).select("r.*")


def store_run(path: str, statements: DataFrame, postings: DataFrame) -> None:
    """Append a part of a run: its statements first, its posting rows last, so that a posting row marks what is complete."""
    publish.append(statements, f"{path}/statements")
    publish.append(postings, f"{path}/postings")


def resume(requests: DataFrame, path: str, meta: dict[str, str]) -> tuple[DataFrame, DataFrame | None]:
    """``(requests still to make, statements that count)`` of the run at ``path``.

    The run's postings carry ``meta`` (model, prompt and schema versions); another value is an error,
    as such rows can't be added to. Statements of postings that weren't completed don't count.
    """
    spark = requests.sparkSession
    if not publish.exists(spark, f"{path}/postings"):
        return requests, None
    done = spark.read.parquet(f"{path}/postings")
    other = done.where(" OR ".join(f"NOT (`{k}` <=> '{v}')" for k, v in meta.items())).limit(1).collect()
    if other:
        raise CheckFailed(f"the run was made with {({k: other[0][k] for k in meta})}, not {meta}")
    complete_ones = done.where(F.col("status").isin("ok", "zero_skills")).select("posting_id").distinct()
    kept = spark.read.parquet(f"{path}/statements").join(complete_ones, "posting_id", "left_semi") if publish.exists(spark, f"{path}/statements") else None
    return remaining(requests, done), kept
