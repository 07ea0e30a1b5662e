"""Queries over the taxonomy, event logs, cached calls and read views."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestrata.operators import combine, extraction, hierarchy, reading, selection, taxonomy
from lodestrata.operators.snapshots import latest_snapshot, valid_rows
from lodestrata.plans.general import _GRAPH
from lodestrata.plans.tables import table
from lodestrata.streaming import events as log

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- taxonomy
@query("SELECT concept_uri, max_by(coalesce(preferred_label, ''), (coalesce(modified_date, ''), -source_row_count)) AS preferred_label FROM esco_concepts GROUP BY 1")
def newest_concepts(spark, d):
    rows = table(spark, d, "esco_concepts").select("concept_uri", F.coalesce("preferred_label", F.lit("")).alias("preferred_label"), "modified_date", "source_row_count")
    return taxonomy.keep_newest(rows, "concept_uri", "modified_date", "source_row_count").select("concept_uri", "preferred_label")


@query("""WITH g AS (SELECT trim(concepturi) AS uri, count(*) AS rows, count(DISTINCT coalesce(concepttype, '')) AS t, count(DISTINCT coalesce(conceptlabel, '')) AS l FROM broaderrelationsskillpillar GROUP BY 1)
SELECT uri, CAST(rows AS BIGINT) AS rows, concat_ws(';', CASE WHEN t > 1 THEN 'concepttype' END, CASE WHEN l > 1 THEN 'conceptlabel' END) AS fields FROM g WHERE rows > 1""")
def differing_labels(spark, d):
    rows = table(spark, d, "broaderrelationsskillpillar").select(F.trim("concepturi").alias("uri"), "concepttype", "conceptlabel")
    return taxonomy.differing_columns(rows, "uri").select("uri", "rows", F.array_join("fields", ";").alias("fields"))


_CLEAN = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


_LINKS = f"""WITH c AS (SELECT {_CLEAN.format('concepturi')} AS u, max(concepttype) AS t FROM broaderrelationsskillpillar WHERE concepttype IS NOT NULL GROUP BY 1),
l AS (SELECT {_CLEAN.format('concepturi')} AS child, {_CLEAN.format('broaderuri')} AS parent, broadertype FROM broaderrelationsskillpillar WHERE {_CLEAN.format('broaderuri')} <> '' AND {_CLEAN.format('concepturi')} <> ''),
k AS (SELECT l.*, x.t AS child_kind, y.t AS parent_kind FROM l LEFT JOIN c x ON x.u = child LEFT JOIN c y ON y.u = parent)"""


@query(_LINKS + """, p AS (SELECT child, parent, count(*) AS n, bool_or(child_kind IS NULL OR parent_kind IS NULL) AS lost, count_if(parent_kind <> broadertype) AS bad FROM k GROUP BY 1, 2)
SELECT CAST(coalesce(sum(n) FILTER (WHERE lost), 0) AS BIGINT) AS unresolved, CAST(sum(bad) AS BIGINT) AS type_mismatches, CAST(coalesce(sum(n) FILTER (WHERE child = parent), 0) AS BIGINT) AS self_loops, CAST(count_if(n > 1) AS BIGINT) AS repeated_pairs FROM p""")
def pillar_link_problems(spark, d):
    """What is wrong with the pillar's links as delivered: types are those that concepts declare for themselves."""
    raw = table(spark, d, "broaderrelationsskillpillar").select(hierarchy.clean_id("concepturi").alias("child"), hierarchy.clean_id("broaderuri").alias("parent"), "concepttype", "broadertype")
    kinds = raw.where("concepttype IS NOT NULL").groupBy(F.col("child").alias("uri")).agg(F.max("concepttype").alias("kind"))
    links = taxonomy.resolve_links(raw.where("child IS NOT NULL AND parent IS NOT NULL"), ["child", "parent"], kinds, "uri", "kind")
    return taxonomy.link_problems(links, "child", "parent", {"parent": "broadertype"})


@query(f"""WITH c AS (SELECT {_CLEAN.format('concepturi')} AS u, max(concepttype) AS t FROM broaderrelationsskillpillar WHERE concepttype IS NOT NULL GROUP BY 1),
l AS (SELECT {_CLEAN.format('concepturi')} AS child, {_CLEAN.format('broaderuri')} AS parent FROM broaderrelationsskillpillar WHERE {_CLEAN.format('broaderuri')} <> '')
SELECT child, parent, x.t AS child_kind, y.t AS parent_kind FROM (SELECT DISTINCT * FROM l) LEFT JOIN c x ON x.u = child LEFT JOIN c y ON y.u = parent""")
def resolved_links(spark, d):
    raw = table(spark, d, "broaderrelationsskillpillar").select(hierarchy.clean_id("concepturi").alias("child"), hierarchy.clean_id("broaderuri").alias("parent"), "concepttype")
    kinds = raw.where("concepttype IS NOT NULL").groupBy("child").agg(F.max("concepttype").alias("kind"))
    links = raw.where("child IS NOT NULL AND parent IS NOT NULL").select("child", "parent").distinct()
    return taxonomy.resolve_links(links, ["child", "parent"], kinds.withColumnRenamed("child", "uri"), "uri", "kind")


@query("SELECT o_custkey AS c, CAST(count(*) AS BIGINT) AS narrower FROM orders GROUP BY 1")
def inverse_counts(spark, d):
    return taxonomy.inverse(table(spark, d, "orders"), "o_orderkey", "o_custkey").groupBy(F.col("broader").alias("c")).agg(F.count("narrower").alias("narrower"))


@query("SELECT DISTINCT child, parent FROM (SELECT p_brand AS child, p_type AS parent FROM part UNION ALL SELECT p_name, p_brand FROM part)")
def path_links(spark, d):
    return taxonomy.path_links(table(spark, d, "part").withColumn("blank", F.lit(" ")), ["p_type", "blank", "p_brand", "p_name"])


@query("""WITH l AS (SELECT concept_uri AS u, preferred_label AS l, 'preferred' AS kind FROM esco_concepts UNION ALL SELECT concept_uri, unnest(alt_labels), 'alternative' FROM esco_concepts UNION ALL SELECT concept_uri, unnest(hidden_labels), 'hidden' FROM esco_concepts)
SELECT DISTINCT u AS concept_uri, trim(regexp_replace(l, '\\s+', ' ', 'g')) AS label, kind FROM l WHERE trim(regexp_replace(l, '\\s+', ' ', 'g')) <> ''""")
def concept_labels(spark, d):
    return taxonomy.label_table(table(spark, d, "esco_concepts"))


@query("WITH m AS (SELECT DISTINCT p_partkey, trim(unnest(string_split(p_type || ',' || p_brand, ','))) AS scheme FROM part) SELECT scheme, CAST(count(*) AS BIGINT) AS rows FROM m WHERE scheme NOT IN (SELECT DISTINCT trim(p_brand) FROM part WHERE p_size > 25) GROUP BY 1")
def unknown_schemes(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.concat_ws(",", "p_type", "p_brand").alias("s"), "p_brand", "p_size")
    known = parts.where("p_size > 25").select(F.trim("p_brand").alias("p_brand")).distinct()
    return taxonomy.unknown_schemes(taxonomy.memberships(parts, "p_partkey", "s"), known, "p_brand")


@query("SELECT concept_type, status, CAST(count(*) AS BIGINT) AS concepts, CAST(sum(len(alt_labels)) AS BIGINT) AS alt_labels, CAST(count_if(coalesce(trim(preferred_label), '') = '') AS BIGINT) AS without_labels FROM esco_concepts GROUP BY 1, 2")
def import_counts(spark, d):
    return taxonomy.import_summary(table(spark, d, "esco_concepts"), ["concept_type", "status"], ["alt_labels"])


@query(_GRAPH + "SELECT node FROM cyclic")
def cycle_nodes(spark, d):
    _, links = hierarchy.read_links(table(spark, d, "broaderrelationsskillpillar"), "concepturi", "broaderuri")
    return hierarchy.cycle_nodes(links)


# ---- event logs
@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events")
def event_versions(spark, d):
    return log.versions(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", F.col("version").cast("bigint").alias("version"))


@query("SELECT min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def events_once(spark, d):
    rows = table(spark, d, "events").withColumn("request", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    return log.once(rows, "request", "event_id").select("event_id")


@query("SELECT user_id, coalesce(max(event_id) FILTER (WHERE event_type = 'purchase') = max(event_id), false) AS closed FROM events GROUP BY 1")
def closed_scopes(spark, d):
    return log.open_after(table(spark, d, "events"), "user_id", "event_id", "event_type", "purchase")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS version, round(sum(coalesce(value, 0)), 4) AS total FROM events GROUP BY 1")
def streamed_versions(spark, d):
    """The log as a stream with state: the last version of every user."""
    held = log.collected(log.running_versions(log.read_stream(spark, _folder_of(spark, d, "events"))), "update")
    last = held.groupBy("user_id").agg(F.max(F.struct("version", "total")).alias("s"))
    return last.select("user_id", "s.version", F.round("s.total", 4).alias("total"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def streamed_windows(spark, d):
    """Hourly windows of the log as a stream; each window's last state counts."""
    held = log.collected(log.windowed_counts(log.read_stream(spark, _folder_of(spark, d, "events")), "1 hour", "1 day"), "update")
    last = held.groupBy("start", "event_type").agg(F.max(F.struct("events", "value")).alias("s"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "s.events", F.round("s.value", 4).alias("value"))


def _folder_of(spark, d: str, name: str) -> str:
    """A pattern that a file stream takes for the table's files, be it one file or a folder of files."""
    from lodestrata.sinks.publish import _fs

    fs, target = _fs(spark, f"{d}/{name}.parquet")
    return f"{d}/{name}.parquet" if fs.getFileStatus(target).isDirectory() else f"{d}/{name}.parque[t]"


# ---- cached calls
_REQUEST = "model-1"


def _requests(spark, d):
    rows = table(spark, d, "postings")
    current = valid_rows(rows.where(F.col("snapshot_id") == latest_snapshot(rows)), ["posting_id"], "fetched_at", ["clean_text", "exclusion_reason", "is_placeholder"])
    return extraction.with_keys(current.where("exclusion_reason = ''"), model=_REQUEST)


_CURRENT = """cur AS (SELECT unnest(r) FROM (SELECT max_by(p, fetched_at) AS r FROM postings p WHERE snapshot_id = (SELECT max(snapshot_id) FROM postings) AND posting_id IS NOT NULL GROUP BY posting_id)),
q AS (SELECT posting_id, sha256('{"model":"model-1","text":"' || sha256(coalesce(clean_text, '')) || '"}') AS cache_key FROM cur WHERE exclusion_reason = '')"""


@query("WITH " + _CURRENT + """, c AS (SELECT DISTINCT cache_key, substr(cache_key, 1, 1) < '4' AS valid FROM q WHERE substr(cache_key, 1, 1) < '8')
SELECT posting_id, cache_key, CASE WHEN c.valid IS NULL THEN 'would call' WHEN c.valid THEN 'cached (valid)' ELSE 'cached (invalid, would re-call)' END AS action FROM q LEFT JOIN c USING (cache_key)""")
def call_plan(spark, d):
    requests = _requests(spark, d)
    first = F.substring("cache_key", 1, 1)
    cache = requests.where(first < "8").select("cache_key", (first < "4").alias("valid"), F.lit(1).alias("received_at"))
    return extraction.call_plan(requests, cache)


@query("WITH " + _CURRENT + " SELECT posting_id FROM q WHERE NOT (substr(cache_key, 1, 1) < '8')")
def remaining_calls(spark, d):
    requests = _requests(spark, d)
    done = requests.where(F.substring("cache_key", 1, 1) < "8").select("posting_id", F.lit("ok").alias("status"))
    return extraction.remaining(requests, done).select("posting_id")


OUTPUT_SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["skills", "no_skills_reason"],
    "properties": {
        "skills": {"type": "array", "items": {"type": "object", "additionalProperties": False, "required": ["skill_statement", "evidence_text"], "properties": {"skill_statement": {"type": "string"}, "evidence_text": {"type": "string"}}}},
        "no_skills_reason": {"anyOf": [{"type": "string"}, {"type": "null"}]},
    },
}


def echo_backend(prompt: str) -> dict:
    """A backend without a model: it names a text's first capitalised line, or refuses an empty one."""
    if not prompt.strip():
        return {"body": None, "stop_reason": "refusal", "input_tokens": 0}
    line = prompt.strip().splitlines()[0][:60]
    body = {"skills": [{"skill_statement": line, "evidence_text": line}] if line[0].isupper() else [], "no_skills_reason": None if line[0].isupper() else "nothing capitalised"}
    return {"body": json.dumps(body), "stop_reason": "end_turn", "input_tokens": len(prompt.split()), "output_tokens": len(line.split())}


@query("WITH " + _CURRENT + r""", t AS (SELECT coalesce(clean_text, '') AS t FROM cur WHERE exclusion_reason = ''),
l AS (SELECT t, regexp_extract(regexp_replace(t, '^\s+', ''), '^[^\n\r\v\f]*') AS line, CAST(len(list_filter(regexp_split_to_array(t, '[\s\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+'), lambda w: w <> '')) AS BIGINT) AS n FROM t)
SELECT CASE WHEN line = '' THEN 'failed' WHEN regexp_matches(line, '^\p{Lu}') THEN 'ok' ELSE 'zero_skills' END AS status, CASE WHEN line = '' THEN 'refusal' END AS problem,
  CAST(count(*) AS BIGINT) AS rows, CAST(sum(CASE WHEN line = '' THEN 0 ELSE n END) AS BIGINT) AS tokens FROM l GROUP BY 1, 2""")
def judged_calls(spark, d):
    requests = _requests(spark, d).withColumn("prompt", F.coalesce("clean_text", F.lit("")))
    return extraction.judge(extraction.complete(requests, echo_backend), OUTPUT_SCHEMA).groupBy("status", "problem").agg(F.count("*").alias("rows"), F.sum("input_tokens").alias("tokens"))


# ---- read views
@query("WITH " + _CURRENT + """, s AS (SELECT posting_id, count(*) AS n FROM skills GROUP BY 1), a AS (SELECT posting_id, min(required_or_preferred) AS requirement FROM skills GROUP BY 1), t AS (SELECT posting_id, CASE WHEN substr(sha256(posting_id), 1, 1) < '4' THEN 'evaluation' END AS split FROM q)
SELECT q.posting_id, coalesce(a.requirement, '') AS requirement, coalesce(t.split, '') AS split, coalesce(n, 0) AS skills FROM q LEFT JOIN s USING (posting_id) LEFT JOIN a USING (posting_id) LEFT JOIN t USING (posting_id)""")
def posting_details(spark, d):
    base, skills = _requests(spark, d).select("posting_id"), table(spark, d, "skills")
    sides = {
        "requirement": skills.groupBy("posting_id").agg(F.min("required_or_preferred").alias("requirement")),
        "split": base.where(F.substring(F.sha2("posting_id", 256), 1, 1) < "4").withColumn("split", F.lit("evaluation")),
    }
    return reading.details(base, "posting_id", sides, {"skills": skills})


@query("WITH m AS (SELECT c_custkey, c_nationkey, CASE WHEN substr(sha256('3:' || c_custkey), 1, 1) < '8' THEN 'development' ELSE 'evaluation' END AS split FROM customer), g AS (SELECT *, list(c_custkey) OVER (PARTITION BY c_nationkey, c_custkey % 50) AS mem FROM m), h AS (SELECT CAST(c_custkey AS VARCHAR) AS posting_id FROM g WHERE split = 'evaluation' UNION SELECT CAST(unnest(mem) AS VARCHAR) FROM g WHERE split = 'evaluation') SELECT posting_id FROM h WHERE posting_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM m WHERE split = 'development')")
def held_out(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("posting_id"), F.struct("c_nationkey", F.col("c_custkey") % 50).alias("g"), F.when(F.substring(selection.seeded(3, "c_custkey"), 1, 1) < "8", "development").otherwise("evaluation").alias("split"))
    groups = rows.groupBy("g").agg(F.array_join(F.collect_list("posting_id"), ";").alias("group_members"))
    return reading.held_out(rows.join(groups, "g"))


@query("WITH m AS (SELECT c_mktsegment, c_nationkey, CASE WHEN sha256('9:' || c_custkey) < '8' THEN 'a' ELSE 'b' END AS split FROM customer) SELECT c_nationkey, CAST(count(DISTINCT split) AS BIGINT) AS splits FROM m GROUP BY 1 HAVING count(DISTINCT split) > 1")
def leaking_groups(spark, d):
    rows = table(spark, d, "customer").withColumn("split", F.when(selection.seeded(9, "c_custkey") < "8", "a").otherwise("b"))
    return selection.leaking_groups(rows, "c_nationkey", "split")


@query("WITH " + _CURRENT + " SELECT posting_id, company_name, title FROM cur ORDER BY company_name, title")
def corpus_listing(spark, d):
    rows = table(spark, d, "postings")
    current = valid_rows(rows.where(F.col("snapshot_id") == latest_snapshot(rows)), ["posting_id"], "fetched_at", ["company_name", "title"])
    return reading.listing(current, ["posting_id", "company_name", "title"], ["company_name", "title"])


# ---- further checks and sums
@query("WITH c AS (SELECT regexp_replace(concepturi, '^\\s+|\\s+$', '', 'g') AS u, max(conceptlabel) AS l FROM broaderrelationsskillpillar GROUP BY 1), r AS (SELECT DISTINCT regexp_replace(broaderuri, '^\\s+|\\s+$', '', 'g') AS u, broaderlabel AS b FROM broaderrelationsskillpillar WHERE broaderlabel IS NOT NULL) SELECT CAST(count(*) AS BIGINT) AS labels, CAST(sum(CASE WHEN r.b <> c.l THEN 1 ELSE 0 END) AS BIGINT) AS mismatches FROM r JOIN c USING (u)")
def label_mismatches(spark, d):
    """How many labels that links give to broader concepts differ from the concepts' own."""
    raw = table(spark, d, "broaderrelationsskillpillar").select(hierarchy.clean_id("concepturi").alias("u"), hierarchy.clean_id("broaderuri").alias("b"), "conceptlabel", "broaderlabel")
    return taxonomy.label_mismatches(raw, "b", "broaderlabel", raw.where("u IS NOT NULL"), "u", "conceptlabel")


@query("SELECT posting_id, title FROM (SELECT DISTINCT posting_id, title FROM postings WHERE snapshot_id = (SELECT max(snapshot_id) FROM postings) AND word_count >= 200)")
def parameterised_sql(spark, d):
    """A statement with named parameters over a view of the table."""
    rows = table(spark, d, "postings")
    return reading.sql_rows("SELECT DISTINCT posting_id, title FROM {rows} WHERE snapshot_id = :snapshot AND word_count >= :words", {"snapshot": latest_snapshot(rows), "words": 200}, rows=rows)


@query("WITH " + _CURRENT + """, r AS (SELECT *, substr(cache_key, 1, 1) AS h, (SELECT c.word_count FROM cur c WHERE c.posting_id = q.posting_id) AS w FROM q)
SELECT CAST(sum(CASE WHEN h < '2' THEN 0 WHEN h < '8' THEN 1 ELSE 2 END) AS BIGINT) AS attempts, CAST(count_if(h < '5') AS BIGINT) AS cache_hits, CAST(count_if(h < 'a') AS BIGINT) AS ok, CAST(count_if(h >= 'a' AND h < 'd') AS BIGINT) AS zero_skills, CAST(count_if(h >= 'd') AS BIGINT) AS failed,
  CAST(coalesce(sum(CASE WHEN h < '8' THEN w END), 0) AS BIGINT) AS input_tokens, CAST(0 AS BIGINT) AS output_tokens FROM r""")
def run_totals(spark, d):
    """The totals of a run whose outcomes follow from its keys; some have no token counts."""
    h = F.substring("cache_key", 1, 1)
    rows = table(spark, d, "postings")
    words = valid_rows(rows.where(F.col("snapshot_id") == latest_snapshot(rows)), ["posting_id"], "fetched_at", ["word_count"])
    judged = _requests(spark, d).join(words, "posting_id").select(
        F.when(h < "a", "ok").when(h < "d", "zero_skills").otherwise("failed").alias("status"), F.when(h < "8", F.col("word_count")).alias("input_tokens"), F.lit(None).cast("bigint").alias("output_tokens"),
        F.when(h < "2", F.lit(None).cast("array<string>")).when(h < "8", F.array(F.lit("end_turn"))).otherwise(F.array(F.lit("error"), F.lit("end_turn"))).alias("attempts"), (h < "5").alias("cache_hit"),
    )
    return extraction.run_totals(judged)


@query("SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def checked_union(spark, d):
    """Two tables as one, the second without the keys of the first."""
    return combine.union_checked(*_parties(spark, d), ["id"])


def _parties(spark, d):
    return [table(spark, d, t).select(F.col(k).alias("id"), F.lit(t).alias("kind")) for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"))]


@query("SELECT id, arg_min(nation, turn) AS nation FROM (SELECT s_suppkey AS id, s_nationkey AS nation, 0 AS turn FROM supplier UNION ALL SELECT c_custkey, c_nationkey, 1 FROM customer) GROUP BY 1")
def concatenated_parties(spark, d):
    """Suppliers and customers one after the other; of equal ids the supplier's nation counts."""
    tables = [table(spark, d, t).select(F.col(k).alias("id"), F.col(n).alias("nation")) for t, k, n in (("supplier", "s_suppkey", "s_nationkey"), ("customer", "c_custkey", "c_nationkey"))]
    return combine.concat_distinct(tables, ["id"])


@query("SELECT c_custkey, c_mktsegment, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def merged_customers(spark, d):
    """Customers with their nation and region, whose keys are checked to be unique."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    regions = table(spark, d, "region").select("r_regionkey", "r_name")
    merged = combine.checked_merge(combine.checked_merge(table(spark, d, "customer"), nations, ["c_nationkey"]), regions, ["r_regionkey"])
    return merged.select("c_custkey", "c_mktsegment", "n_name", "r_name")
