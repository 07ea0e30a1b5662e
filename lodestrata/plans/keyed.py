"""Queries over keyed state, orders, groups and refusals."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.functions.udfs import register, schema_errors_udf
from lodestrata.operators import analytics as A
from lodestrata.operators import checks, prepare, reading, replay, selection, snapshots, taxonomy
from lodestrata.plans.corpus import _LATEST, _SPANS, _VALID, _all, _cur
from lodestrata.plans.records import _folder_of
from lodestrata.plans.tables import table
from lodestrata.streaming import events as log

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


# ---- event logs as state
_SAW = "CASE WHEN k < 40 THEN k % 12 END"


def _fold(again: str) -> str:
    """SQL of the ordered fold: a recursive walk over every user's events."""
    return f"""WITH RECURSIVE b AS (SELECT user_id, event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
e AS (SELECT user_id, event_id, event_type, value, {_SAW} AS saw, {again} AS again, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM b),
w(user_id, rn, event_id, outcome, version) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', CAST(0 AS BIGINT) FROM e
  UNION ALL SELECT e.user_id, e.rn, e.event_id, CASE WHEN e.again THEN 'repeated' WHEN e.saw <> w.version THEN 'stale' ELSE 'applied' END,
    CASE WHEN e.again OR e.saw <> w.version THEN w.version ELSE w.version + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
"""


_AGAIN = "row_number() OVER (PARTITION BY user_id, event_type, k ORDER BY event_id) > 1"


def _events(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    rows = table(spark, d, "events").withColumn("k", k)
    return rows.select("user_id", "event_id", "event_type", "value", F.expr(_SAW).alias("saw"), F.concat_ws("|", "event_type", F.col("k").cast("string")).alias("request"))


def _replayed(spark, d):
    return replay.replay(_events(spark, d), "user_id", "event_id", "saw", "request")


@query(_fold(_AGAIN) + "SELECT event_id, outcome, version FROM w WHERE rn > 0")
def replayed_events(spark, d):
    """Every event's outcome when each user's log is applied in order; some writers state the version they saw."""
    return _replayed(spark, d).select("event_id", "outcome", "version")


@query(_fold(_AGAIN) + "SELECT e.user_id, e.event_type, arg_max(e.event_id, e.event_id) AS event_id, arg_max(e.value, e.event_id) AS value, CAST(count(*) AS BIGINT) AS decisions FROM w JOIN e ON e.event_id = w.event_id WHERE outcome = 'applied' GROUP BY 1, 2")
def last_decisions(spark, d):
    return replay.last_decisions(_replayed(spark, d), ["user_id", "event_type"], "event_id", ["event_id", "value"])


@query(_fold(_AGAIN) + "SELECT user_id, CAST(count(*) AS BIGINT) AS stale FROM w WHERE outcome = 'stale' GROUP BY 1")
def stale_writers(spark, d):
    return replay.stale_events(_replayed(spark, d)).groupBy("user_id").agg(F.count("*").alias("stale"))


@query(_fold("false") + "SELECT user_id, event_id, outcome, version FROM w WHERE rn > 0")
def streamed_replay(spark, d):
    """The same fold as a stream with state."""
    stream = log.read_stream(spark, _folder_of(spark, d, "events")).withColumn("k", F.from_json("props", "k bigint")["k"]).select("user_id", "event_id", F.expr(_SAW).alias("saw"))
    return log.collected(replay.replay_stream(stream, "user_id", "event_id", "saw")).drop("batch")


# ---- orders
@query("WITH " + _LATEST + " SELECT posting_id, row_number() OVER (ORDER BY company_name NULLS FIRST, title NULLS FIRST, posting_id) AS position FROM cur")
def listing_order(spark, d):
    """Every posting's place in the listing by company and title."""
    return reading.numbered(_cur(spark, d, "company_name", "title"), ["company_name", "title", "posting_id"]).select("posting_id", F.col("position").cast("bigint").alias("position"))


@query("SELECT posting_id_a, posting_id_b, row_number() OVER (ORDER BY text_similarity DESC NULLS LAST, posting_id_a, posting_id_b) AS position FROM (SELECT posting_id_a, posting_id_b, max(text_similarity) AS text_similarity FROM near_duplicate_candidates GROUP BY 1, 2)")
def pair_order(spark, d):
    """The review list's order: most alike first, ties by ids."""
    rows = table(spark, d, "near_duplicate_candidates").groupBy("posting_id_a", "posting_id_b").agg(F.max("text_similarity").alias("text_similarity"))
    found = reading.numbered(rows, [F.desc("text_similarity"), F.col("posting_id_a"), F.col("posting_id_b")])
    return found.select("posting_id_a", "posting_id_b", F.col("position").cast("bigint").alias("position"))


@query("WITH r AS (SELECT DISTINCT split, posting_id FROM (SELECT CASE WHEN substr(sha256(posting_id), 1, 1) < '6' THEN 'development' ELSE 'evaluation' END AS split, posting_id FROM postings WHERE posting_id IS NOT NULL)) SELECT split, posting_id, row_number() OVER (ORDER BY split, posting_id) AS position FROM r")
def export_numbers(spark, d):
    """Rows of an export numbered across postings, by split and id."""
    split = F.when(F.substring(F.sha2("posting_id", 256), 1, 1) < "6", "development").otherwise("evaluation")
    rows = table(spark, d, "postings").where("posting_id IS NOT NULL").select(split.alias("split"), "posting_id").distinct()
    return reading.numbered(rows, ["split", "posting_id"]).withColumn("position", F.col("position").cast("bigint"))


@query("SELECT snapshot_id, posting_id FROM postings WHERE snapshot_id = (SELECT max(snapshot_id) FROM postings)")
def snapshot_listing(spark, d):
    """The delivered rows of the latest snapshot in order; a snapshot without rows would be an error."""
    rows = table(spark, d, "postings")
    return snapshots.snapshot_rows(rows, snapshots.latest_snapshot(rows), "posting_id").select("snapshot_id", "posting_id")


# ---- groups, rates, refusals
@query("WITH " + _LATEST + " SELECT industry, CAST(count(word_count) AS BIGINT) AS n, CAST(quantile_cont(word_count, 0.5) AS DOUBLE) AS median FROM cur WHERE exclusion_reason = '' GROUP BY 1")
def median_words(spark, d):
    return A.medians(prepare.usable(_cur(spark, d, "industry", "exclusion_reason", "word_count")), ["industry"], "word_count")


@query("WITH " + _LATEST + " SELECT board_token, CAST(count(*) AS BIGINT) AS rows, round(avg(CASE WHEN exclusion_reason <> '' THEN 1.0 ELSE 0.0 END), 6) AS excluded, round(avg(CASE WHEN contains(lower(coalesce(location, '')), 'remote') THEN 1.0 ELSE 0.0 END), 6) AS remote FROM cur GROUP BY 1")
def board_rates(spark, d):
    found = A.rates(_cur(spark, d, "board_token", "exclusion_reason", "location"), {"excluded": F.col("exclusion_reason") != "", "remote": X.is_remote(F.col("location"))}, ["board_token"])
    return found.select("board_token", "rows", F.round("excluded", 6).alias("excluded"), F.round("remote", 6).alias("remote"))


@query("SELECT posting_id, 'text_hash' AS \"column\", CAST(count(DISTINCT text_hash) AS BIGINT) AS \"values\" FROM postings GROUP BY 1 HAVING count(DISTINCT text_hash) <> 1 UNION ALL SELECT posting_id, 'company_name', CAST(count(DISTINCT company_name) AS BIGINT) FROM postings GROUP BY 1 HAVING count(DISTINCT company_name) <> 1")
def unsettled_postings(spark, d):
    """Postings whose text or company isn't the same in all deliveries."""
    return checks.unsettled(table(spark, d, "postings"), ["posting_id"], ["text_hash", "company_name"])


@query("WITH m AS (SELECT posting_id, min(text_hash) AS g FROM postings WHERE posting_id IS NOT NULL AND snapshot_id = (SELECT min(snapshot_id) FROM postings) GROUP BY 1) SELECT DISTINCT posting_id_a, posting_id_b FROM near_duplicate_candidates LEFT JOIN m a ON a.posting_id = posting_id_a LEFT JOIN m b ON b.posting_id = posting_id_b WHERE a.g IS DISTINCT FROM b.g")
def pairs_across_groups(spark, d):
    """Review pairs whose postings have different texts in the first snapshot."""
    rows = table(spark, d, "postings").where("posting_id IS NOT NULL")
    first = rows.agg(F.min("snapshot_id")).first()[0]
    members = rows.where(F.col("snapshot_id") == F.lit(first)).groupBy("posting_id").agg(F.min("text_hash").alias("g"))
    pairs = table(spark, d, "near_duplicate_candidates").select("posting_id_a", "posting_id_b").distinct()
    return selection.pairs_across_groups(pairs, members, "posting_id", "g").select("posting_id_a", "posting_id_b")


@query("WITH w AS (SELECT DISTINCT o_custkey * 2 AS id FROM orders) SELECT id, CASE WHEN id NOT IN (SELECT c_custkey FROM customer) THEN 'unknown' ELSE 'held out' END AS reason FROM w WHERE id NOT IN (SELECT c_custkey FROM customer) OR id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def refusals(spark, d):
    """Wanted ids that aren't known or are held out, one by one."""
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    wanted = table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("id"))
    return reading.refusals(wanted, customers, customers.where("c_nationkey < 5"), "id")


@query("WITH w AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), m AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY c_nationkey) * 7 <= 40 THEN 7 ELSE 0 END AS least FROM w), x AS (SELECT *, sum(n) OVER (PARTITION BY c_nationkey) AS s, 40 - sum(least) OVER (PARTITION BY c_nationkey) AS lft FROM m), f AS (SELECT *, (n * lft) // s AS fl, n * lft - ((n * lft) // s) * s AS rest FROM x), o AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY rest DESC, c_mktsegment) AS k, lft - sum(fl) OVER (PARTITION BY c_nationkey) AS odd FROM f) SELECT c_nationkey, c_mktsegment, CAST(least + fl + CASE WHEN k <= odd THEN 1 ELSE 0 END AS BIGINT) AS seats FROM o")
def least_seats(spark, d):
    """Seats in proportion, with seven for each segment beforehand."""
    weights = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return selection.largest_remainder(weights, "c_mktsegment", "n", 40, ["c_nationkey"], least=7)


# ---- occurrences and schemas
@query("WITH " + _VALID + f""", j AS (SELECT DISTINCT s.annotation_id, s.evidence_text AS e, v.clean_text AS t FROM {_SPANS} s JOIN valid v USING (snapshot_id, posting_id) WHERE s.evidence_text <> '' AND v.clean_text IS NOT NULL AND annotation_id IS NOT NULL)
SELECT annotation_id, list_filter(range(1, greatest(length(t) - length(e) + 2, 1)), lambda i: substr(t, i, length(e)) = e)[2] - 1 AS second, CAST((length(t) - length(replace(t, e, ''))) // length(e) AS BIGINT) AS apart FROM j""")
def repeated_evidence(spark, d):
    """The second place of each evidence passage, and how often it occurs without overlap (by the table function)."""
    register(spark)
    spans = table(spark, d, "skills").select("snapshot_id", "posting_id", "annotation_id", "evidence_text").where("evidence_text <> '' AND annotation_id IS NOT NULL").distinct()
    joined = spans.join(_all(spark, d, "clean_text"), ["snapshot_id", "posting_id"]).where("clean_text IS NOT NULL")
    placed = reading.sql_rows(
        "SELECT j.annotation_id, j.clean_text, j.evidence_text, o.position FROM {j} AS j LEFT JOIN LATERAL occurrences(j.clean_text, j.evidence_text, false) AS o", {}, j=joined
    )
    second = X.nth_occurrence(F.col("clean_text"), F.col("evidence_text"), 2).cast("bigint")
    return placed.groupBy("annotation_id", "clean_text", "evidence_text").agg(F.count("position").alias("apart")).select("annotation_id", second.alias("second"), "apart")


_ITEM = {"type": "object", "required": ["id", "kind"], "properties": {"id": {"type": "string"}, "kind": {"enum": ["required", "preferred"]}, "from": {"type": "integer"}}, "additionalProperties": False}


@query("SELECT annotation_id, coalesce(array_to_string(list_filter([CASE WHEN required_or_preferred IS NULL THEN '$: missing kind' END, CASE WHEN required_or_preferred NOT IN ('required', 'preferred') THEN '$.kind: \"' || required_or_preferred || '\" is not allowed' END], lambda x: x IS NOT NULL), ';'), '') AS problems FROM (SELECT DISTINCT annotation_id, required_or_preferred, evidence_start FROM skills WHERE annotation_id IS NOT NULL)")
def schema_problems(spark, d):
    """Annotations as JSON documents against a schema."""
    rows = table(spark, d, "skills").where("annotation_id IS NOT NULL").select("annotation_id", "required_or_preferred", "evidence_start").distinct()
    document = F.to_json(F.struct(F.col("annotation_id").alias("id"), F.col("required_or_preferred").alias("kind"), F.col("evidence_start").alias("from")))
    return rows.select("annotation_id", F.array_join(schema_errors_udf(_ITEM)(document), ";").alias("problems"))


@query("SELECT concept_uri, 'unknown type' AS problem FROM esco_concepts WHERE concept_type IS DISTINCT FROM 'KnowledgeSkillCompetence' UNION ALL SELECT concept_uri, 'no URI' FROM esco_concepts WHERE NOT coalesce(regexp_matches(concept_uri, '^https?://\\S+$'), false) UNION ALL SELECT concept_uri, 'no label' FROM esco_concepts WHERE coalesce(trim(preferred_label), '') = ''")
def concept_problems(spark, d):
    """Concepts that a list of skills only wouldn't take."""
    return taxonomy.concept_problems(table(spark, d, "esco_concepts"), kinds=("KnowledgeSkillCompetence",))
