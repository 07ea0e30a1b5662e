"""Queries that write tables by the sinks, read them back by the sources, and give what came through."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata import schemas
from lodestrata.functions import text as X
from lodestrata.operators import extraction, loading, prepare, taxonomy
from lodestrata.operators.snapshots import latest_snapshot, valid_rows
from lodestrata.plans.corpus import _LATEST, _VALID, _html_sql
from lodestrata.plans.records import _CURRENT, _requests
from lodestrata.plans.tables import table
from lodestrata.sinks import files as out
from lodestrata.sinks import publish
from lodestrata.sources import files
from lodestrata.storage import scratch

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@query("SELECT doc_id, lang, source, title, sha256(text) AS sha FROM documents")
def jsonl_round_trip(spark, d):
    """All documents as JSON lines and back."""
    path, fields = scratch(spark, "jsonl"), ["doc_id", "text", "lang", "source", "title"]
    rows = table(spark, d, "documents").select(*fields)
    out.write_jsonl(rows, path, fields)
    return files.read_jsonl(spark, path, rows.schema).select("doc_id", "lang", "source", "title", F.sha2("text", 256).alias("sha"))


@query("WITH " + _LATEST + """ SELECT posting_id, coalesce(title, '') AS title, CASE WHEN departments IS NULL THEN '' ELSE '[' || array_to_string(list_transform(departments, lambda x: '"' || x || '"'), ',') || ']' END AS departments,
CASE WHEN is_placeholder THEN 'true' WHEN NOT is_placeholder THEN 'false' ELSE '' END AS is_placeholder, coalesce(CAST(word_count AS VARCHAR), '') AS word_count, sha256(replace(coalesce(clean_text, ''), chr(13), '')) AS sha FROM cur""")
def csv_round_trip(spark, d):
    """The latest postings as CSV, with lists as JSON, and back by the strict reader."""
    rows = table(spark, d, "postings")
    current = valid_rows(rows.where(F.col("snapshot_id") == latest_snapshot(rows)), ["posting_id"], "fetched_at", ["title", "departments", "is_placeholder", "word_count", "clean_text"])
    path = scratch(spark, "csv")
    out.write_csv(current, path)
    back = files.read_csv(spark, path, schemas.strings(*current.columns))
    return back.select("posting_id", "title", "departments", "is_placeholder", "word_count", F.sha2(F.replace("clean_text", F.lit("\r"), F.lit("")), 256).alias("sha"))


@query("SELECT replace(CAST(doc_id AS VARCHAR), ':', '__') AS name, coalesce(source, '') AS split, length(text) AS chars FROM documents")
def texts_by_split(spark, d):
    """The documents' texts in folders by source."""
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.coalesce("source", F.lit("")).alias("split"))
    path = scratch(spark, "texts")
    out.write_texts(rows, path, "doc_id", "text", "split")
    back = spark.read.schema("name string, text string, split string").json(path)
    return back.select("name", F.coalesce("split", F.lit("")).alias("split"), F.length("text").cast("bigint").alias("chars"))


@query("""SELECT 1 AS step, CAST(count_if(o_orderkey % 3 <> 0) AS BIGINT) AS inserted, CAST(0 AS BIGINT) AS unchanged, CAST(count_if(o_orderkey % 3 <> 0) AS BIGINT) AS there FROM orders
UNION ALL SELECT 2, CAST(count_if(o_orderkey % 3 = 0) AS BIGINT), CAST(count_if(o_orderkey % 3 <> 0) AS BIGINT), CAST(count(*) AS BIGINT) FROM orders UNION ALL SELECT 3, 0, CAST(count(*) AS BIGINT), CAST(count(*) AS BIGINT) FROM orders""")
def loaded_orders(spark, d):
    """A part of the orders is loaded, then all of them, then all again: what each step inserts, and what is there after it."""
    orders, path = table(spark, d, "orders"), scratch(spark, "orders")
    steps = []
    for n, rows in enumerate((orders.where("o_orderkey % 3 <> 0"), orders, orders), 1):
        done = loading.load(rows, path, ["o_orderkey"], "o_orderstatus")
        steps.append((n, done["inserted"], done["unchanged"], spark.read.schema(orders.schema).parquet(path).count()))
    return spark.createDataFrame(steps, "step int, inserted bigint, unchanged bigint, there bigint")


@query("""WITH l AS (SELECT concept_uri AS u, preferred_label AS l FROM esco_concepts UNION ALL SELECT concept_uri, unnest(alt_labels) FROM esco_concepts UNION ALL SELECT concept_uri, unnest(hidden_labels) FROM esco_concepts),
k AS (SELECT concept_uri AS u, preferred_label AS l, 'preferred' AS kind FROM esco_concepts UNION ALL SELECT concept_uri, unnest(alt_labels), 'alternative' FROM esco_concepts UNION ALL SELECT concept_uri, unnest(hidden_labels), 'hidden' FROM esco_concepts),
n AS (SELECT count(*) AS n, count(DISTINCT concept_type) AS t FROM esco_concepts)
SELECT 'concepts' AS name, CAST(n AS BIGINT) AS rows FROM n UNION ALL SELECT 'links', CAST(n - t AS BIGINT) FROM n UNION ALL SELECT 'imports', 1 UNION ALL SELECT 'imports again', 0
UNION ALL SELECT 'labels', CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT u, trim(regexp_replace(l, '\\s+', ' ', 'g')) AS l, kind FROM k WHERE trim(regexp_replace(l, '\\s+', ' ', 'g')) <> '')""")
def imported_taxonomy(spark, d):
    """The concepts, each under the first of its type, imported twice as one all-or-nothing delivery: what readers then see."""
    concepts = table(spark, d, "esco_concepts").drop("import_id")
    heads = concepts.groupBy("concept_type").agg(F.min("concept_uri").alias("parent"))
    links = concepts.join(heads, "concept_type").select(F.col("concept_uri").alias("child"), "parent").where("child <> parent")
    path = scratch(spark, "taxonomy")
    first = taxonomy.import_taxonomy(concepts, links, path, "v1", "en", "digest-1")
    second = taxonomy.import_taxonomy(concepts, links, path, "v1", "en", "digest-1")
    rows = [(name, loading.imported(spark, path, name).count()) for name in ("concepts", "links", "labels")]
    rows += [("imports", int(first is not None)), ("imports again", int(second is not None))]
    return spark.createDataFrame(rows, "name string, rows bigint")


@query("WITH " + _VALID + f""", t AS (SELECT *, coalesce({_html_sql('raw_text')}, '') AS x FROM valid WHERE source_job_id IS NOT NULL)
SELECT snapshot_id, board_token, source_job_id, internal_job_id, title, location, array_to_string(departments, '|') AS departments, source_company_name, sha256(nullif(replace(lower(x), 'ß', 'ss'), '')) AS text_hash,
  CAST(len(list_filter(string_split(x, ' '), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))) AS BIGINT) AS word_count, sha256(x) AS sha FROM t""")
def built_rows(spark, d):
    """The postings as raw board payloads, read as such and built anew."""
    rows = valid_rows(
        table(spark, d, "postings"), ["snapshot_id", "posting_id"], "fetched_at",
        ["board_token", "source_job_id", "internal_job_id", "title", "location", "departments", "offices", "raw_text", "source_company_name", "source_language", "absolute_url", "source_updated_at", "fetched_at"],
    ).where("source_job_id IS NOT NULL")
    named = lambda c: F.transform(c, lambda x: F.struct(F.lit(None).cast("bigint").alias("id"), x.alias("name")))
    job = F.struct(
        F.col("source_job_id").cast("bigint").alias("id"), F.col("internal_job_id").cast("bigint").alias("internal_job_id"), "title", F.col("raw_text").alias("content"), F.struct(F.col("location").alias("name")).alias("location"),
        named("departments").alias("departments"), named("offices").alias("offices"), "absolute_url", F.col("source_updated_at").alias("updated_at"), F.col("source_language").alias("language"), F.col("source_company_name").alias("company_name"),
    )
    # One object of one job a line: the reader takes a list of jobs wherever it stands.
    path = scratch(spark, "payloads")
    rows.select("snapshot_id", "board_token", "fetched_at", F.to_json(F.struct(F.array(job).alias("jobs"))).alias("value")).write.partitionBy("snapshot_id", "board_token", "fetched_at").text(path)
    payload = F.from_json("value", schemas.BOARD_PAYLOAD)
    raw = spark.read.schema("value string, snapshot_id string, board_token string, fetched_at string").text(path)
    jobs = raw.select("snapshot_id", "board_token", "fetched_at", F.explode(payload["jobs"]).alias("job"))
    boards = rows.select("board_token").distinct().select("board_token", F.lit(1).alias("board_order"), F.lit("x").alias("company_name"), F.lit("y").alias("industry"), F.lit("z").alias("industry_source"))
    built = prepare.build_rows(jobs, boards, "v1.0.0")
    return built.select("snapshot_id", "board_token", "source_job_id", "internal_job_id", "title", "location", F.array_join("departments", "|").alias("departments"), "source_company_name", "text_hash", "word_count", F.sha2(F.coalesce(X.collapse(F.col("clean_text")), F.lit("")), 256).alias("sha"))


@query("WITH v AS (SELECT posting_id, snapshot_id, fetched_at, text_hash FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, posting_id ORDER BY fetched_at DESC) AS k FROM postings WHERE snapshot_id IS NOT NULL AND posting_id IS NOT NULL) WHERE k = 1) SELECT posting_id, max(snapshot_id) AS received_at, arg_max(coalesce(text_hash, ''), snapshot_id) AS body FROM v GROUP BY 1")
def latest_responses(spark, d):
    """A history of responses, stored snapshot after snapshot, and the cache it stands for."""
    rows = valid_rows(table(spark, d, "postings"), ["snapshot_id", "posting_id"], "fetched_at", ["text_hash"]).select(
        F.col("posting_id").alias("cache_key"), "posting_id", F.col("snapshot_id").alias("received_at"), F.coalesce("text_hash", F.lit("")).alias("body"),
    )
    path = scratch(spark, "responses")
    cuts = [r[0] for r in rows.select("received_at").distinct().orderBy("received_at").collect()]  # as many as there are snapshots
    for one in cuts:
        extraction.store_responses(rows.where(F.col("received_at") == one), path)
    return extraction.latest_responses(spark.read.schema(rows.schema).parquet(path)).select("posting_id", "received_at", "body")


@query("WITH " + _CURRENT + """, s AS (SELECT *, substr(cache_key, 1, 1) AS h FROM q)
SELECT posting_id, 'to do' AS state FROM s WHERE NOT (h < '6') UNION ALL SELECT posting_id, 'kept' FROM s WHERE h < '6' UNION ALL SELECT posting_id, 'refused' FROM s WHERE false""")
def resumed_run(spark, d):
    """A run that was broken off: which requests are still to be made, and whose statements count."""
    requests = _requests(spark, d).select("posting_id", "cache_key")
    h, path = F.substring("cache_key", 1, 1), scratch(spark, "run")
    done = requests.where(h < "9").select("posting_id", F.when(h < "3", "ok").when(h < "6", "zero_skills").otherwise("failed").alias("status"), F.lit("model-1").alias("model"), F.lit("p1").alias("prompt"))
    extraction.store_run(path, requests.where(h < "9").select("posting_id", F.lit("statement").alias("statement")), done)
    todo, kept = extraction.resume(requests, path, {"model": "model-1", "prompt": "p1"})
    return todo.select("posting_id", F.lit("to do").alias("state")).unionByName(kept.select("posting_id", F.lit("kept").alias("state")))


@query("WITH " + _LATEST + """ SELECT posting_id, '{"max_tokens":2000,"messages":[{"content":' || CAST(to_json(coalesce(title, '')) AS VARCHAR) || ',"role":"user"}],"model":"model-1","system":"Name the skills."}' AS request FROM cur""")
def request_texts(spark, d):
    rows = table(spark, d, "postings")
    current = valid_rows(rows.where(F.col("snapshot_id") == latest_snapshot(rows)), ["posting_id"], "fetched_at", ["title"])
    return current.withColumn("prompt", F.coalesce("title", F.lit(""))).select("posting_id", extraction.request_params("model-1", 2000, "Name the skills.").alias("request"))


@query("SELECT snapshot_id, CAST(count(*) AS BIGINT) AS rows FROM (SELECT DISTINCT snapshot_id, posting_id FROM postings WHERE snapshot_id IS NOT NULL AND posting_id IS NOT NULL) GROUP BY 1")
def published_snapshots(spark, d):
    """Every snapshot as an immutable folder of its own; a second publication of one is refused."""
    rows = valid_rows(table(spark, d, "postings"), ["snapshot_id", "posting_id"], "fetched_at", ["text_hash"])
    path = scratch(spark, "snapshots")
    for (one,) in rows.select("snapshot_id").distinct().collect():  # as many as there are snapshots
        publish.snapshot(rows.where(F.col("snapshot_id") == one).drop("snapshot_id"), path, one)
    back = spark.read.option("basePath", path).schema("posting_id string, text_hash string, snapshot_id string").parquet(path)
    return back.groupBy("snapshot_id").agg(F.count("*").alias("rows"))


@query("WITH " + _LATEST + " SELECT replace(posting_id, ':', '__') AS name, replace(coalesce(title, ''), '|', '\\|') AS title FROM cur")
def escaped_titles(spark, d):
    rows = table(spark, d, "postings")
    current = valid_rows(rows.where(F.col("snapshot_id") == latest_snapshot(rows)), ["posting_id"], "fetched_at", ["title"])
    return current.select(X.safe_name(F.col("posting_id")).alias("name"), X.escape_pipes(F.coalesce("title", F.lit(""))).alias("title"))
