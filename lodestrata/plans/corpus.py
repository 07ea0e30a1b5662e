"""Queries over postings, documents and skills: text functions, flags, duplicates, aggregates."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from lodestrata.functions import rules
from lodestrata.functions import text as X
from lodestrata.functions.udfs import html_to_text, norm_key
from lodestrata.operators import analytics as A
from lodestrata.operators import annotation as N
from lodestrata.operators import checks, components, language, loading, pairs, prepare, reading, selection
from lodestrata.operators.snapshots import latest_snapshot, valid_rows
from lodestrata.plans.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
RULES = Path(__file__).parent.parent / "config" / "seniority.yaml"
_WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _key(c: str) -> str:
    return f"nullif(trim(regexp_replace(lower({c}), '{_WS}+', ' ', 'g')), '')"


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '{_WS}+'), lambda x: x <> '')"


def _tokens(c: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_]+'))"


_VALID = """valid AS (SELECT unnest(r) FROM (SELECT max_by(p, fetched_at) AS r FROM postings p
                WHERE snapshot_id IS NOT NULL AND posting_id IS NOT NULL GROUP BY snapshot_id, posting_id))"""
_LATEST = _VALID + ", cur AS (SELECT * FROM valid WHERE snapshot_id = (SELECT max(snapshot_id) FROM postings))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _all(spark, d, *columns):
    rows = table(spark, d, "postings")
    return valid_rows(rows, ["snapshot_id", "posting_id"], "fetched_at", list(columns))


def _cur(spark, d, *columns):
    rows = table(spark, d, "postings")
    return valid_rows(rows.where(F.col("snapshot_id") == latest_snapshot(rows)), ["posting_id"], "fetched_at", list(columns))


# ---- text functions
@query(f"SELECT doc_id, sha256({_key('text')}) AS text_hash FROM documents")
def text_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", X.text_hash(F.col("text")).alias("text_hash"))


@query(rf"SELECT doc_id, CAST(len(list_filter({_words('text')}, lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]'))) AS BIGINT) AS words, CAST(len({_words('text')}) AS BIGINT) AS pieces FROM documents")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.word_count(F.col("text")).alias("words"), X.plain_length(F.col("text")).alias("pieces"))


@query(f"SELECT doc_id, CAST(len({_tokens('text')}) AS BIGINT) AS tokens FROM documents")
def token_set_size(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.token_set(F.col("text"))).cast("bigint").alias("tokens"))


@query(r"SELECT DISTINCT title, trim(regexp_replace(lower(coalesce(title, '')), '\s+', ' ', 'g')) AS title_key, trim(regexp_replace(lower(regexp_replace(coalesce(title, ''), '(\s*\([^()]*\)\s*)+$', '')), '\s+', ' ', 'g')) AS base FROM postings")
def title_keys(spark, d):
    t = F.col("title")
    return table(spark, d, "postings").select("title").distinct().select("title", X.title_key(t).alias("title_key"), X.base_title(t).alias("base"))


@query(r"SELECT doc_id, CAST(i AS INTEGER) AS paragraph, CAST(len(p[i]) AS BIGINT) AS chars FROM (SELECT doc_id, regexp_split_to_array(text, '\n\s*\n') AS p FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)")
def paragraph_rows(spark, d):
    parts = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(X.paragraphs(F.col("text"))).alias("i", "p"))
    return parts.select("doc_id", (F.col("i") + 1).alias("paragraph"), F.length("p").cast("bigint").alias("chars"))


@query("SELECT concept_uri, CAST(len(list_filter(list_transform(alt_labels, lambda x: trim(x)), lambda x: x <> '')) AS BIGINT) AS kept, CAST(len(alt_labels) - len(list_filter(list_transform(alt_labels, lambda x: trim(x)), lambda x: x <> '')) AS BIGINT) AS dropped FROM esco_concepts")
def split_label_lists(spark, d):
    joined = F.array_join("alt_labels", "\n")
    rows = table(spark, d, "esco_concepts").select("concept_uri", joined.alias("j"))
    return rows.select("concept_uri", F.size(X.split_labels(F.col("j"))).cast("bigint").alias("kept"), X.dropped_labels(F.col("j")).cast("bigint").alias("dropped"))


@query("SELECT posting_id, snapshot_id, replace(posting_id, ':', '__') AS safe, sha256(concat_ws('|', snapshot_id, posting_id)) AS composite FROM (SELECT DISTINCT posting_id, snapshot_id FROM postings)")
def safe_names(spark, d):
    return table(spark, d, "postings").select("posting_id", "snapshot_id").distinct().select("posting_id", "snapshot_id", X.safe_name(F.col("posting_id")).alias("safe"), F.sha2(F.concat_ws("|", "snapshot_id", "posting_id"), 256).alias("composite"))


# ---- cleaning, flags, duplicates
def _html_sql(column: str) -> str:
    """SQL of a raw posting's readable text, for the tags and entities that occur; white space collapsed."""
    def unescaped(c: str, *more: tuple[str, str]) -> str:
        for name, sign in (("&lt;", "<"), ("&gt;", ">"), *more, ("&amp;", "&")):
            c = f"replace({c}, '{name}', '{sign}')"
        return c

    bare = f"regexp_replace(replace({unescaped(column)}, '<li>', chr(10) || '- '), '</?(p|h3|ul|li|br)[^<>]*>', chr(10), 'g')"
    return f"trim(regexp_replace({unescaped(bare, ('&#x27;', chr(39) * 2))}, '{_WS}+', ' ', 'g'))"


@query("WITH " + _VALID + f" SELECT snapshot_id, posting_id, {_html_sql('raw_text')} AS text FROM valid WHERE raw_text IS NOT NULL")
def html_texts(spark, d):
    """Readable text of every raw posting, but for how its lines are broken."""
    return _all(spark, d, "raw_text").where("raw_text IS NOT NULL").select("snapshot_id", "posting_id", X.collapse(html_to_text("raw_text")).alias("text"))


@query("WITH " + _VALID + " SELECT snapshot_id, posting_id, text_hash AS found FROM valid")
def exact_text_hash(spark, d):
    """The hash with full Unicode folding, which must be the delivered one."""
    rows = _all(spark, d, "clean_text")
    return rows.select("snapshot_id", "posting_id", F.sha2(F.nullif(norm_key("clean_text"), F.lit("")), 256).alias("found"))


def _placeholder_sql() -> str:
    plain = "replace(coalesce({}, ''), '’', '''')"
    q = lambda p: p.replace("'", "''")
    tests = [f"WHEN regexp_matches({plain.format('title')}, '{q(p)}', 'i') THEN 'placeholder_title:{k}'" for k, p in rules.PLACEHOLDER_TITLES]
    tests += [f"WHEN regexp_matches({plain.format('clean_text')}, '{q(p)}', 'i') THEN 'placeholder_text:{k}'" for k, p in rules.PLACEHOLDER_TEXTS]
    return "CASE " + " ".join(tests) + " END"


@query("WITH " + _VALID + f" SELECT snapshot_id, posting_id, {_placeholder_sql()} AS reason FROM valid")
def placeholder_reasons(spark, d):
    return _all(spark, d, "title", "clean_text").select("snapshot_id", "posting_id", rules.placeholder_reason(F.col("title"), F.col("clean_text")).alias("reason"))


@query("WITH " + _LATEST + f""", h AS (SELECT posting_id, board_token, {_placeholder_sql()} AS ph, clean_text, text_hash, raw_text FROM cur),
f AS (SELECT *, first_value(posting_id) OVER (PARTITION BY text_hash ORDER BY board_token, posting_id) AS f FROM h)
SELECT posting_id, concat_ws(';', CASE WHEN raw_text IS NULL THEN 'missing_description' WHEN coalesce(clean_text, '') = '' THEN 'empty_description' END, ph,
  CASE WHEN text_hash IS NOT NULL AND f <> posting_id THEN 'exact_duplicate' END) AS exclusion_reason,
  CASE WHEN text_hash IS NOT NULL AND f <> posting_id THEN f END AS is_duplicate_of FROM f""")
def exclusion_reasons(spark, d):
    rows = _cur(spark, d, "board_token", "title", "clean_text", "raw_text", "text_hash")
    reason = rules.placeholder_reason(F.col("title"), F.col("clean_text"))
    flagged = rows.withColumn("exclusion_reason", X.reasons((F.col("raw_text").isNull(), "missing_description"), (F.col("raw_text").isNotNull() & (F.coalesce("clean_text", F.lit("")) == ""), "empty_description"), (reason.isNotNull(), reason)))
    return prepare.mark_duplicates(flagged, ["board_token"]).select("posting_id", "exclusion_reason", "is_duplicate_of")


@query("WITH " + _VALID + " SELECT snapshot_id, posting_id FROM valid WHERE exclusion_reason = ''")
def usable_postings(spark, d):
    return prepare.usable(_all(spark, d, "exclusion_reason")).select("snapshot_id", "posting_id")


@query("""WITH h AS (SELECT doc_id, source, """ + f"sha256({_key('text')})" + """ AS h FROM documents), f AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY source, doc_id) AS f FROM h)
SELECT doc_id, CASE WHEN h IS NOT NULL AND f <> doc_id THEN f END AS is_duplicate_of FROM f""")
def exact_duplicates(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", X.text_hash(F.col("text")).alias("h"), F.lit("").alias("exclusion_reason"))
    return prepare.mark_duplicates(rows, ["source"], "doc_id", "h").select("doc_id", "is_duplicate_of")


def _rules_sql(column: str, rule_set) -> str:
    q = lambda p: p.replace("'", "''")
    match = lambda ps: "(" + " OR ".join(f"regexp_matches({column}, '{q(p)}', 'i')" for p in ps) + ")"
    rows = []
    for r in rule_set.rules:
        test = match(r.patterns) + (f" AND NOT {match(r.exclude)}" if r.exclude else "")
        rows.append(f"CASE WHEN {test} THEN {{'l': '{r.label}', 'i': '{r.id}'}} END")
    return f"list_filter([{', '.join(rows)}], lambda x: x IS NOT NULL)"


_RULE_SET = rules.load_rules(RULES)


@query(f"WITH t AS (SELECT DISTINCT title FROM postings), h AS (SELECT title, {_rules_sql("trim(coalesce(title, ''))", _RULE_SET)} AS h FROM t) SELECT title, coalesce(h[1].l, 'unknown') AS label, coalesce(h[1].i, '') AS rule_id, coalesce(array_to_string(list_transform(h[2:], lambda x: x.i || ':' || x.l), ';'), '') AS other_matches FROM h")
def title_rules(spark, d):
    titles = table(spark, d, "postings").select("title").distinct()
    return titles.select("title", rules.classify(F.col("title"), _RULE_SET).alias("r")).select("title", "r.label", "r.rule_id", "r.other_matches")


# ---- aggregates
@query("WITH " + _LATEST + """, r AS (SELECT unnest(string_split(CASE WHEN exclusion_reason = '' THEN 'usable' ELSE exclusion_reason END, ';')) AS r FROM cur)
SELECT CASE WHEN starts_with(r, 'placeholder_') THEN 'placeholder' ELSE r END AS reason, CAST(count(*) AS BIGINT) AS rows FROM r GROUP BY 1""")
def corpus_summary(spark, d):
    return A.reason_counts(_cur(spark, d, "exclusion_reason"))


@query("WITH " + _LATEST + """ SELECT board_token, CAST(count(*) AS BIGINT) AS rows, CAST(count_if(exclusion_reason = '') AS BIGINT) AS usable, CAST(count_if(is_placeholder) AS BIGINT) AS placeholders,
CAST(count_if(is_duplicate_of IS NOT NULL) AS BIGINT) AS duplicates, CAST(count_if(text_hash IS NULL) AS BIGINT) AS without_text, CAST(sum(word_count) AS BIGINT) AS words, bool_or(source_company_name IS DISTINCT FROM company_name) AS names_differ FROM cur GROUP BY 1""")
def board_quality(spark, d):
    rows = _cur(spark, d, "board_token", "exclusion_reason", "is_placeholder", "is_duplicate_of", "text_hash", "word_count", "source_company_name", "company_name")
    return rows.groupBy("board_token").agg(
        F.count("*").alias("rows"), A.conditional("usable", F.col("exclusion_reason") == ""), A.conditional("placeholders", F.col("is_placeholder")),
        A.conditional("duplicates", F.col("is_duplicate_of").isNotNull()), A.conditional("without_text", F.col("text_hash").isNull()), F.sum("word_count").alias("words"),
        F.bool_or(~F.col("source_company_name").eqNullSafe(F.col("company_name"))).alias("names_differ"),
    )


@query("WITH " + _LATEST + " SELECT board_token, source_company_name, CAST(count(*) AS BIGINT) AS rows FROM cur GROUP BY 1, 2")
def company_names(spark, d):
    return _cur(spark, d, "board_token", "source_company_name").groupBy("board_token", "source_company_name").agg(F.count("*").alias("rows"))


@query("WITH " + _LATEST + " SELECT board_token, CAST(count(word_count) AS BIGINT) AS n, list_sort(list(word_count))[count(word_count) // 2 + 1] AS upper_median FROM cur WHERE exclusion_reason = '' GROUP BY 1")
def upper_median_words(spark, d):
    return A.upper_median(prepare.usable(_cur(spark, d, "board_token", "exclusion_reason", "word_count")), "board_token", "word_count")


@query("WITH " + _LATEST + " SELECT CAST(count(word_count) AS BIGINT) AS n, round(avg(word_count), 6) AS mean, round(stddev_samp(word_count), 6) AS std, min(word_count) AS min, " + ", ".join(f"round(quantile_cont(word_count, {p / 100}), 4) AS p{p}" for p in (10, 25, 50, 75, 90)) + ", max(word_count) AS max FROM cur WHERE exclusion_reason = ''")
def word_statistics(spark, d):
    found = A.describe(prepare.usable(_cur(spark, d, "exclusion_reason", "word_count")), "word_count")
    return found.select(*[F.round(c, 6).alias(c) if c in ("mean", "std") else F.round(c, 4).alias(c) if c.startswith("p") else F.col(c) for c in found.columns])


@query("WITH " + _LATEST + ", s AS (SELECT company_name, count(*) AS n FROM cur WHERE exclusion_reason = '' GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n * n) AS BIGINT) AS squares, CAST(count(*) AS BIGINT) AS groups, CAST((SELECT sum(n) FROM (SELECT n FROM s ORDER BY n DESC, company_name LIMIT 2)) AS BIGINT) AS top_rows FROM s")
def concentration(spark, d):
    return A.concentration(prepare.usable(_cur(spark, d, "exclusion_reason", "company_name")), "company_name")


@query("WITH " + _LATEST + """, g AS (SELECT board_token, title, count(*) AS rows, count(DISTINCT text_hash) AS texts, string_agg(coalesce(location, ''), ' | ' ORDER BY posting_id) AS locations FROM cur GROUP BY 1, 2)
SELECT board_token, title, CAST(rows AS BIGINT) AS rows, CAST(texts AS BIGINT) AS texts, locations FROM g WHERE texts > 1""")
def repeated_titles(spark, d):
    return A.repeated_groups(_cur(spark, d, "board_token", "title", "text_hash", "location"), ["board_token", "title"], "text_hash", "posting_id", "location")


_RATED = ("posting_id", "internal_job_id", "title", "location", "departments", "offices", "clean_text", "source_updated_at", "industry", "source_language", "text_hash")


@query("WITH " + _VALID + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count_if({c} IS NULL OR {'len(' + c + ') = 0' if c in ('departments', 'offices') else 'trim(' + c + ') = ' + chr(39) * 2}) AS BIGINT) AS missing, CAST(count(*) AS BIGINT) AS rows FROM valid" for c in _RATED))
def missing_values(spark, d):
    return A.missing_rates(_all(spark, d, *[c for c in _RATED if c != "posting_id"]).select(*_RATED))


@query("WITH " + _LATEST + ", e AS (SELECT unnest(departments) AS value FROM cur) SELECT value, CAST(count(*) AS BIGINT) AS rows FROM e WHERE value IS NOT NULL GROUP BY 1 ORDER BY rows DESC, value LIMIT 15")
def top_departments(spark, d):
    return A.value_counts(_cur(spark, d, "departments"), "departments", 15)


@query("WITH " + _LATEST + ", e AS (SELECT board_token, unnest(CASE WHEN len(offices) > 0 THEN offices ELSE [NULL] END) AS o FROM cur) SELECT board_token, CAST(count(DISTINCT o) AS BIGINT) AS elements FROM e GROUP BY 1")
def offices_by_board(spark, d):
    return A.distinct_elements(_cur(spark, d, "board_token", "offices"), "board_token", "offices")


@query("WITH " + _LATEST + ", n AS (SELECT coalesce(industry, '(null)') AS industry, coalesce(exclusion_reason, '(null)') AS exclusion_reason FROM cur) SELECT CASE WHEN grouping(industry) = 1 THEN 'All' ELSE industry END AS industry, CASE WHEN grouping(exclusion_reason) = 1 THEN 'All' ELSE exclusion_reason END AS exclusion_reason, CAST(count(*) AS BIGINT) AS rows FROM n GROUP BY CUBE (industry, exclusion_reason)")
def industry_crosstab(spark, d):
    return A.crosstab(_cur(spark, d, "industry", "exclusion_reason"), "industry", "exclusion_reason")


_EDGES = [0, 50, 100, 150, 200, 300, 500, 1000]


@query("WITH " + _LATEST + ", b AS (SELECT CASE " + " ".join(f"WHEN word_count {'>=' if i == 0 else '>'} {a} AND word_count <= {b} THEN {i}" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:], strict=False))) + f" END AS bin FROM cur) SELECT CAST(i AS INTEGER) AS bin, CAST(count(b.bin) AS BIGINT) AS rows FROM range({len(_EDGES) - 1}) r(i) LEFT JOIN b ON b.bin = i GROUP BY i")
def word_histogram(spark, d):
    return A.histogram(_cur(spark, d, "word_count"), "word_count", _EDGES)


@query("SELECT basis, board_token, CAST(count(*) AS BIGINT) AS pairs, CAST(count_if(token_jaccard >= 0.9) AS BIGINT) AS alike, round(min(text_similarity), 4) AS least FROM near_duplicate_candidates GROUP BY 1, 2")
def reviewed_pairs(spark, d):
    return A.pair_counts(table(spark, d, "near_duplicate_candidates"), ["basis", "board_token"], F.col("token_jaccard") >= 0.9, "text_similarity").withColumn("least", F.round("least", 4))


_LABELS = ["required", "preferred", "optional", "unclear"]


@query("SELECT l AS required_or_preferred, CAST(i AS INTEGER) AS position, CAST(count(s.annotation_id) AS BIGINT) AS rows FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(_LABELS)) + ") v(i, l) LEFT JOIN (SELECT DISTINCT annotation_id, required_or_preferred FROM skills) s ON s.required_or_preferred = l GROUP BY 1, 2")
def requirement_counts(spark, d):
    counts = table(spark, d, "skills").select("annotation_id", "required_or_preferred").distinct().groupBy("required_or_preferred").agg(F.count("*").alias("rows"))
    return A.zero_filled(counts, _LABELS, "required_or_preferred", "rows")


@query("WITH " + _LATEST + " SELECT posting_id, regexp_matches(coalesce(location, ''), ';|•') AS several_places, contains(lower(coalesce(location, '')), 'remote') AS remote, NOT regexp_matches(coalesce(location, ''), '" + X.IN_US + "') AS outside_us FROM cur")
def location_flags(spark, d):
    place = F.col("location")
    return _cur(spark, d, "location").select("posting_id", X.several_places(place).alias("several_places"), X.is_remote(place).alias("remote"), X.outside_us(place).alias("outside_us"))


@query("WITH " + _LATEST + ", c AS (SELECT company_name, industry, count(*) AS n FROM cur GROUP BY 1, 2) SELECT company_name, industry, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER () AS BIGINT) AS total FROM c")
def company_shares(spark, d):
    counts = _cur(spark, d, "company_name", "industry").groupBy("company_name", "industry").agg(F.count("*").alias("n"))
    return A.share_of_total(counts, "n").select("company_name", "industry", "n", F.round(F.col("n") / F.col("share")).cast("bigint").alias("total"))


@query("WITH " + _LATEST + ", s AS (SELECT company_name, count(*) AS n FROM cur GROUP BY 1) SELECT '{\"rows\":' || sum(n) || ',\"squares\":' || CAST(sum(n * n) AS BIGINT) || ',\"groups\":' || count(*) || ',\"top_rows\":' || (SELECT sum(n) FROM (SELECT n FROM s ORDER BY n DESC, company_name LIMIT 2)) || '}' AS metrics FROM s")
def metrics_json(spark, d):
    return A.as_metrics(A.concentration(_cur(spark, d, "company_name"), "company_name"))


@query("WITH " + _LATEST + " SELECT facet, value FROM (SELECT 'company_name' AS facet, company_name AS value FROM cur UNION SELECT 'industry', industry FROM cur UNION SELECT 'exclusion_reason', exclusion_reason FROM cur) WHERE value IS NOT NULL AND value <> ''")
def corpus_facets(spark, d):
    return A.facets(_cur(spark, d, "company_name", "industry", "exclusion_reason"), ["company_name", "industry", "exclusion_reason"])


@query("WITH " + _LATEST + " SELECT posting_id, title, company_name FROM cur WHERE exclusion_reason = '' AND contains(lower(title), 'engineer') AND industry = 'Health care'")
def corpus_filter(spark, d):
    rows = _cur(spark, d, "title", "company_name", "industry", "exclusion_reason")
    return reading.filtered(rows, {"industry": "Health care", "company_name": ""}, "usable", contains={"title": "Engineer"}).select("posting_id", "title", "company_name")


@query("SELECT sha256(string_agg(concept_uri || chr(9) || sha256(preferred_label), chr(10) ORDER BY concept_uri || chr(9) || sha256(preferred_label))) AS digest FROM esco_concepts")
def files_digest(spark, d):
    return A.digest_of(table(spark, d, "esco_concepts").select("concept_uri", F.sha2("preferred_label", 256).alias("sha")), "concept_uri", "sha")


# ---- pairs, groups and sampling
@query("WITH " + _LATEST + r""", t AS (SELECT *, trim(regexp_replace(lower(coalesce(title, '')), '\s+', ' ', 'g')) AS tk FROM cur),
b AS (SELECT posting_id, board_token, 'internal_job_id' AS basis, internal_job_id AS v FROM t UNION ALL SELECT posting_id, board_token, 'title', tk FROM t),
p AS (SELECT x.posting_id AS a, y.posting_id AS b, x.basis FROM b x JOIN b y ON x.board_token = y.board_token AND x.basis = y.basis AND x.v = y.v AND x.posting_id < y.posting_id WHERE x.v <> ''),
m AS (SELECT a, b, string_agg(basis, '+' ORDER BY basis) AS basis FROM p GROUP BY a, b),
s AS (SELECT posting_id, text_hash, """ + _tokens("clean_text") + """ AS s FROM t)
SELECT m.a AS posting_id_a, m.b AS posting_id_b, m.basis, round(len(list_intersect(x.s, y.s)) / greatest(len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)), 1), 4) AS token_jaccard, CAST(len(list_intersect(x.s, y.s)) AS INTEGER) AS shared_tokens, CAST(len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)) AS INTEGER) AS all_tokens,
  coalesce(x.text_hash = y.text_hash, false) AS exact_text_match FROM m JOIN s x ON x.posting_id = m.a JOIN s y ON y.posting_id = m.b""")
def review_pairs(spark, d):
    rows = _cur(spark, d, "board_token", "title", "location", "internal_job_id", "clean_text", "text_hash", "exclusion_reason")
    return pairs.near_duplicate_candidates(rows, ratio=False).select("posting_id_a", "posting_id_b", "basis", "token_jaccard", "shared_tokens", "all_tokens", "exact_text_match")


@query()
def review_pairs_scored(spark, d):
    """The review list with its text similarity."""
    rows = _cur(spark, d, "board_token", "title", "location", "internal_job_id", "clean_text", "text_hash", "exclusion_reason")
    return pairs.near_duplicate_candidates(rows)


@query("WITH RECURSIVE " + _LATEST + r""", k AS (SELECT posting_id AS p, board_token || ' i ' || internal_job_id AS b, 'internal_job_id' AS n FROM cur WHERE internal_job_id <> ''
  UNION ALL SELECT posting_id, board_token || ' t ' || trim(regexp_replace(lower(regexp_replace(title, '(\s*\([^()]*\)\s*)+$', '')), '\s+', ' ', 'g')), 'base_title' FROM cur WHERE trim(regexp_replace(coalesce(title, ''), '(\s*\([^()]*\)\s*)+$', '')) <> ''),
e AS (SELECT DISTINCT x.p AS a, y.p AS b FROM k x JOIN k y USING (b)),
r(a, b) AS (SELECT posting_id, posting_id FROM cur UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS posting_id, min(b) AS m FROM r GROUP BY a),
u AS (SELECT m, string_agg(DISTINCT n, '+' ORDER BY n) AS basis FROM (SELECT b, n, min(p) AS p FROM k GROUP BY b, n HAVING count(DISTINCT p) > 1) JOIN c ON c.posting_id = p GROUP BY m)
SELECT posting_id, 'grp:' || m AS group_id, coalesce(u.basis, 'singleton') AS basis, CAST(count(*) OVER (PARTITION BY m) AS BIGINT) AS group_size FROM c LEFT JOIN u USING (m)""")
def related_groups(spark, d):
    rows = _cur(spark, d, "board_token", "internal_job_id", "title")
    found = components.related_groups(rows, "posting_id", {"internal_job_id": F.col("internal_job_id"), "base_title": X.base_title(F.col("title"))}, "board_token")
    return found.select("posting_id", "group_id", "basis", "group_size")


@query("WITH w AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), x AS (SELECT *, sum(n) OVER (PARTITION BY c_nationkey) AS s, n * 100 AS e FROM w), f AS (SELECT *, e // s AS fl, e - (e // s) * s AS rest FROM x), o AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY rest DESC, c_mktsegment) AS k, 100 - sum(fl) OVER (PARTITION BY c_nationkey) AS lft FROM f) SELECT c_nationkey, c_mktsegment, CAST(fl + CASE WHEN k <= lft THEN 1 ELSE 0 END AS BIGINT) AS seats FROM o")
def largest_remainder(spark, d):
    weights = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return selection.largest_remainder(weights, "c_mktsegment", "n", 100, ["c_nationkey"])


@query("WITH h AS (SELECT o_orderkey, o_orderpriority, sha256('7:' || o_orderkey) AS h FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS k FROM h) SELECT o_orderkey, o_orderpriority FROM n WHERE k <= 25")
def seeded_draw(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    seats = orders.select("o_orderpriority").distinct().withColumn("seats", F.lit(25))
    return selection.draw(orders, "o_orderpriority", "o_orderkey", seats, 7)


@query("SELECT c_mktsegment, arg_min(c_custkey, sha256('11:' || c_custkey)) AS c_custkey FROM customer GROUP BY 1")
def seeded_representatives(spark, d):
    return selection.representatives(table(spark, d, "customer"), "c_mktsegment", "c_custkey", 11)


@query()
def annotation_set(spark, d):
    """A balanced, group-safe selection with its split."""
    rows = _cur(spark, d, "industry", "board_token", "internal_job_id", "title").where("industry IS NOT NULL")
    groups = components.related_groups(rows, "posting_id", {"internal_job_id": F.col("internal_job_id"), "base_title": X.base_title(F.col("title"))}, "board_token")
    return selection.select_set(rows.join(groups, "posting_id"), "posting_id", "industry", "group_id", 100, 20, 20)


# ---- language
@query()
def language_votes(spark, d):
    return language.detect(_cur(spark, d, "clean_text"), "posting_id", "clean_text").drop("primary_share", "confidence", "second_confidence")


@query("WITH t AS (SELECT source, coalesce(lang, '?') AS lang, sum(n_chars) AS w FROM documents GROUP BY 1, 2) SELECT source, arg_min(lang, (-w, lang)) AS lang, CAST(max(w) AS BIGINT) AS words, CAST(sum(w) AS BIGINT) AS total FROM t GROUP BY 1")
def main_language_of_sources(spark, d):
    return A.language_share(table(spark, d, "documents").select("source", F.coalesce("lang", F.lit("?")).alias("lang"), "n_chars"), "source", "lang", "n_chars").withColumnRenamed("n_chars", "words")


@query("WITH " + _LATEST + " SELECT posting_id, CASE WHEN nullif(source_language, '') IS NOT NULL THEN lower(source_language) = 'en' END AS agrees FROM cur")
def declared_agreement(spark, d):
    return _cur(spark, d, "source_language").select("posting_id", X.agrees(F.col("source_language"), F.lit("en")).alias("agrees"))


# ---- spans
_SPANS = "(SELECT DISTINCT snapshot_id, posting_id, annotation_id, evidence_text, evidence_start, evidence_end, skill_statement, required_or_preferred, alternative_group_id, annotator_id FROM skills)"


@query("WITH " + _VALID + f" SELECT s.annotation_id, coalesce(s.evidence_start >= 0 AND s.evidence_start < s.evidence_end AND s.evidence_end <= length(v.clean_text) AND substr(v.clean_text, s.evidence_start + 1, s.evidence_end - s.evidence_start) = s.evidence_text, false) AS span_ok FROM {_SPANS} s LEFT JOIN valid v USING (snapshot_id, posting_id)")
def span_checks(spark, d):
    spans = table(spark, d, "skills").dropDuplicates()
    return N.check_spans(spans, _all(spark, d, "clean_text"), ["snapshot_id", "posting_id"]).select("annotation_id", "span_ok").distinct()


@query("WITH " + _VALID + f""", j AS (SELECT s.annotation_id, s.evidence_text AS e, v.clean_text AS t FROM {_SPANS} s JOIN valid v USING (snapshot_id, posting_id) WHERE s.evidence_text <> '')
SELECT DISTINCT annotation_id, array_to_string(list_transform(list_filter(range(1, greatest(length(t) - length(e) + 2, 1)), lambda i: substr(t, i, length(e)) = e), lambda i: i - 1), ',') AS places FROM j""")
def evidence_occurrences(spark, d):
    spans = table(spark, d, "skills").select("snapshot_id", "posting_id", "annotation_id", "evidence_text").where("evidence_text <> ''").distinct()
    joined = spans.join(_all(spark, d, "clean_text"), ["snapshot_id", "posting_id"]).where("clean_text IS NOT NULL")
    return joined.select("annotation_id", F.array_join(X.occurrences(F.col("clean_text"), F.col("evidence_text")).cast("array<string>"), ",").alias("places")).distinct()


@query("WITH " + _VALID + f""", s AS (SELECT * FROM {_SPANS} WHERE annotation_id IS NOT NULL), l AS (SELECT snapshot_id, posting_id, length(clean_text) AS n FROM valid WHERE length(clean_text) > 0),
i AS (SELECT s.*, n FROM s JOIN l USING (snapshot_id, posting_id) WHERE evidence_start >= 0 AND evidence_start < evidence_end AND evidence_end <= n),
e AS (SELECT snapshot_id, posting_id, unnest([evidence_start, evidence_end]) AS pos FROM i UNION SELECT l.snapshot_id, l.posting_id, unnest([0, n]) FROM l WHERE EXISTS (SELECT 1 FROM s WHERE s.snapshot_id = l.snapshot_id AND s.posting_id = l.posting_id)),
p AS (SELECT *, lead(pos) OVER (PARTITION BY snapshot_id, posting_id ORDER BY pos) AS nxt FROM e)
SELECT snapshot_id, posting_id, CAST(pos AS BIGINT) AS "start", CAST(nxt AS BIGINT) AS "end", CAST((SELECT count(DISTINCT annotation_id) FROM i WHERE i.snapshot_id = p.snapshot_id AND i.posting_id = p.posting_id AND i.evidence_start <= pos AND nxt <= i.evidence_end) AS BIGINT) AS covering FROM p WHERE nxt IS NOT NULL""")
def span_segments(spark, d):
    spans = table(spark, d, "skills").select("snapshot_id", "posting_id", F.col("annotation_id").alias("id"), F.col("evidence_start").alias("start"), F.col("evidence_end").alias("end")).where("id IS NOT NULL").distinct()
    keys = ["snapshot_id", "posting_id"]
    texts = _all(spark, d, "clean_text").join(spans.select(*keys).distinct(), keys, "left_semi")
    return N.segments(spans, texts, keys).select(*keys, F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.size("ids").cast("bigint").alias("covering"))


@query("WITH s AS (SELECT DISTINCT ON (annotation_id) * FROM skills) SELECT annotator_id, CAST(count(*) AS BIGINT) AS annotations, CAST(count(DISTINCT posting_id) AS BIGINT) AS postings, CAST(count_if(required_or_preferred = 'required') AS BIGINT) AS required, CAST(count_if(required_or_preferred = 'preferred') AS BIGINT) AS preferred, CAST(count_if(coalesce(trim(skill_statement), '') = '') AS BIGINT) AS blank_statements, CAST(count_if(evidence_text IS NULL) AS BIGINT) AS without_evidence FROM s GROUP BY 1")
def annotator_summary(spark, d):
    return N.annotation_summary(table(spark, d, "skills"))


@query("WITH s AS (SELECT DISTINCT ON (annotation_id) * FROM skills WHERE coalesce(alternative_group_id, '') <> '') SELECT alternative_group_id, CAST(count(*) AS BIGINT) AS members, CAST(count(DISTINCT posting_id) AS BIGINT) AS postings, CAST(count(DISTINCT required_or_preferred) AS BIGINT) AS requirements FROM s GROUP BY 1 HAVING count(*) < 2 OR count(DISTINCT posting_id) > 1 OR count(DISTINCT required_or_preferred) > 1")
def alternative_problems(spark, d):
    return N.alternative_problems(table(spark, d, "skills").dropDuplicates(["annotation_id"]))


@query("WITH " + _VALID + r""", s AS (SELECT DISTINCT snapshot_id, posting_id, annotation_id, trim(skill_statement) AS st, trim(coalesce(evidence_text, '')) AS e FROM skills WHERE annotation_id IS NOT NULL),
j AS (SELECT s.*, v.clean_text AS t, CAST(row_number() OVER (PARTITION BY s.snapshot_id, s.posting_id ORDER BY annotation_id) - 1 AS INTEGER) AS k FROM s JOIN valid v USING (snapshot_id, posting_id)),
h AS (SELECT *, CASE WHEN e = '' OR t IS NULL THEN 0 ELSE len(list_filter(range(1, greatest(length(t) - length(e) + 2, 1)), lambda i: substr(t, i, length(e)) = e)) END AS hits FROM j),
a AS (SELECT *, coalesce(st, '') <> '' AND e <> '' AND hits = 1 AS ok FROM h),
f AS (SELECT *, ok AND row_number() OVER (PARTITION BY snapshot_id, posting_id, lower(st), ok ORDER BY k) = 1 AS kept FROM a)
SELECT snapshot_id, posting_id, k AS model_index, CASE WHEN kept THEN CAST(strpos(t, e) - 1 AS INTEGER) END AS start, kept AS accepted,
  CASE WHEN kept THEN CAST(count(*) FILTER (WHERE kept) OVER (PARTITION BY snapshot_id, posting_id ORDER BY k) - 1 AS BIGINT) END AS ordinal FROM f""")
def statement_ordinals(spark, d):
    """Each posting's statements as a model's output: placed, judged and numbered."""
    rows = table(spark, d, "skills").select("snapshot_id", "posting_id", "annotation_id", "skill_statement", "evidence_text").where("annotation_id IS NOT NULL").distinct()
    none = F.lit(None).cast("string")
    item = F.struct("annotation_id", "skill_statement", "evidence_text", none.alias("evidence_context"), none.alias("requirement_status"), none.alias("mention_relation"), none.alias("alternative_group"))
    output = rows.groupBy("snapshot_id", "posting_id").agg(F.array_sort(F.collect_list(item)).alias("skills")).join(_all(spark, d, "clean_text"), ["snapshot_id", "posting_id"])
    keyed = output.select(F.struct("snapshot_id", "posting_id").alias("key"), "clean_text", "skills")
    found = N.statement_rows(keyed, "key", "clean_text", "skills")
    accepted = F.col("reason").isNull()
    return found.select("key.*", "model_index", F.when(accepted, F.col("start")).alias("start"), accepted.alias("accepted"), F.col("ordinal").cast("bigint").alias("ordinal"))


def _matches(spark, d):
    """One-to-one matches between the spans of every two annotators of a posting."""
    spans = table(spark, d, "skills").dropDuplicates(["annotation_id"]).where("evidence_start IS NOT NULL AND annotator_id IS NOT NULL").select(
        F.concat_ws("|", "snapshot_id", "posting_id").alias("p"), F.col("annotation_id").alias("id"), F.col("evidence_start").alias("start"), F.col("evidence_end").alias("end"), "annotator_id"
    )
    who = spans.select("p", "annotator_id").distinct()
    pairs = who.withColumnRenamed("annotator_id", "a").join(who.withColumnRenamed("annotator_id", "b"), "p").where("a < b")
    side = lambda of: spans.withColumnRenamed("annotator_id", of).join(pairs, ["p", of]).select(F.concat_ws("|", "p", "a", "b").alias("posting_id"), *[F.col(c).alias(c) for c in ("id", "start", "end")])
    return N.match_spans(side("a"), side("b"))


@query()
def annotator_matches(spark, d):
    return _matches(spark, d)


@query("""WITH s AS (SELECT DISTINCT ON (annotation_id) annotation_id, snapshot_id || '|' || posting_id AS p, annotator_id FROM skills WHERE evidence_start IS NOT NULL AND annotator_id IS NOT NULL AND annotation_id IS NOT NULL),
w AS (SELECT DISTINCT p, annotator_id FROM s), q AS (SELECT x.p, x.annotator_id AS a, y.annotator_id AS b FROM w x JOIN w y ON x.p = y.p AND x.annotator_id < y.annotator_id)
SELECT CAST(count(*) FILTER (WHERE s.annotator_id = a) AS BIGINT) AS spans_a, CAST(count(*) FILTER (WHERE s.annotator_id = b) AS BIGINT) AS spans_b FROM q JOIN s ON s.p = q.p""")
def annotator_agreement(spark, d):
    """How many spans the pairs of annotators have on either side: matches and what is left over must add up to them."""
    found = N.agreement(_matches(spark, d))
    matched = F.col("exact") + F.col("overlap")
    return found.select((matched + F.col("only_a")).alias("spans_a"), (matched + F.col("only_b")).alias("spans_b"))


# ---- checks and loads
@query("SELECT snapshot_id, posting_id, CAST(count(*) AS BIGINT) AS rows FROM postings GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_rows(spark, d):
    return checks.duplicate_keys(table(spark, d, "postings"), ["snapshot_id", "posting_id"])


@query("WITH " + _LATEST + " SELECT DISTINCT annotation_id, posting_id FROM skills s WHERE posting_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cur w WHERE w.posting_id = s.posting_id)")
def unknown_originals(spark, d):
    """Annotations of postings that the latest snapshot doesn't have any more."""
    rows = table(spark, d, "skills").select("annotation_id", "posting_id").distinct()
    return checks.missing_references(rows, "posting_id", _cur(spark, d), "posting_id")


_FAULTS = {"text_hash": ("'X' || posting_id", "text_hash is no SHA-256"), "word_count": ("-1 - word_count", "word_count is negative"), "snapshot_id": ("'v' || snapshot_id", "snapshot_id has another form"), "cleaning_version": ("''", "cleaning_version is missing")}


@query("WITH p AS (SELECT *, left(sha256(concat_ws('|', snapshot_id, posting_id, fetched_at)), 1) AS h FROM postings) " + " UNION ALL ".join(
    f"SELECT '{text}' AS problem, CAST(count(*) AS BIGINT) AS rows FROM p WHERE h = '{i}' AND {c} IS NOT NULL HAVING count(*) > 0" for i, (c, (_, text)) in enumerate(_FAULTS.items())))
def row_problems(spark, d):
    """What is wrong with the postings after faults were put into some of them: each row's hash says which."""
    rows = table(spark, d, "postings").withColumn("_h", F.substring(F.sha2(F.concat_ws("|", "snapshot_id", "posting_id", "fetched_at"), 256), 1, 1))
    for i, (column, (fault, _)) in enumerate(_FAULTS.items()):
        rows = rows.withColumn(column, F.when((F.col("_h") == str(i)) & F.col(column).isNotNull(), F.expr(fault)).otherwise(F.col(column)))
    found = checks.problem_counts(rows)
    return found.where(F.col("problem").isin(*[text for _, text in _FAULTS.values()]))


@query("SELECT 'industry_source' AS \"column\", CAST(count(DISTINCT industry_source) AS BIGINT) AS \"values\" FROM postings HAVING count(DISTINCT industry_source) <> 1 UNION ALL SELECT 'source', CAST(count(DISTINCT source) AS BIGINT) FROM postings HAVING count(DISTINCT source) <> 1 UNION ALL SELECT 'cleaning_version', CAST(count(DISTINCT cleaning_version) AS BIGINT) FROM postings HAVING count(DISTINCT cleaning_version) <> 1 UNION ALL SELECT 'board_token', CAST(count(DISTINCT board_token) AS BIGINT) FROM postings HAVING count(DISTINCT board_token) <> 1 UNION ALL SELECT 'snapshot_id', CAST(count(DISTINCT snapshot_id) AS BIGINT) FROM postings HAVING count(DISTINCT snapshot_id) <> 1")
def several_values(spark, d):
    return checks.several_values(table(spark, d, "postings"), ["industry_source", "source", "cleaning_version", "board_token", "snapshot_id"])


_ENDS = "n AS (SELECT min(snapshot_id) AS a, max(snapshot_id) AS b FROM postings)"


@query("WITH " + _VALID + ", " + _ENDS + """, o AS (SELECT * FROM valid, n WHERE snapshot_id = a), w AS (SELECT * FROM valid, n WHERE snapshot_id = b)
SELECT w.posting_id, CASE WHEN o.posting_id IS NULL THEN 'new' WHEN o.title IS NOT DISTINCT FROM w.title AND o.location IS NOT DISTINCT FROM w.location AND o.text_hash IS NOT DISTINCT FROM w.text_hash THEN 'unchanged' ELSE 'conflict' END AS outcome,
  CASE WHEN o.posting_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.title IS DISTINCT FROM w.title THEN 'title' END, CASE WHEN o.location IS DISTINCT FROM w.location THEN 'location' END, CASE WHEN o.text_hash IS DISTINCT FROM w.text_hash THEN 'text_hash' END) END AS differing
FROM w LEFT JOIN o ON o.posting_id = w.posting_id""")
def load_outcomes(spark, d):
    """The last snapshot as a delivery against the first as the store."""
    rows = table(spark, d, "postings")
    first = rows.agg(F.min("snapshot_id")).first()[0]
    stored = valid_rows(rows.where(F.col("snapshot_id") == F.lit(first)), ["posting_id"], "fetched_at", ["title", "location", "text_hash"])
    found = loading.classify_load(_cur(spark, d, "title", "location", "text_hash"), stored, ["posting_id"])
    return found.select("posting_id", "outcome", F.array_join("differing", ",").alias("differing"))


@query("WITH a AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 150000), b AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F') SELECT *, 'derived' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'frozen' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def frozen_difference(spark, d):
    orders = table(spark, d, "orders")
    return loading.frozen_difference(orders.where("o_totalprice > 150000").select("o_custkey", "o_orderstatus"), orders.where("o_orderstatus <> 'F'").select("o_custkey", "o_orderstatus"))


@query("SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM reading_labels WHERE doc_id IS NOT NULL)")
def rows_without_partner(spark, d):
    return checks.missing_references(table(spark, d, "documents").select("doc_id"), "doc_id", table(spark, d, "reading_labels"), "doc_id")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def latest_per_key(spark, d):
    return prepare.latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


# ---- further selection and annotation queries
@query("WITH h AS (SELECT c_custkey, c_nationkey, c_mktsegment, sha256('5:' || c_custkey) AS h FROM customer), t AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY h, c_custkey) AS turn FROM h), n AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY turn, h, c_custkey) AS k FROM t) SELECT c_nationkey, c_mktsegment, c_custkey FROM n WHERE k <= 12")
def diverse_draw(spark, d):
    return selection.diverse_draw(table(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_custkey"), "c_nationkey", "c_mktsegment", "c_custkey", 12, 5)


@query("WITH " + _VALID + r""", s AS (SELECT DISTINCT snapshot_id, posting_id, annotation_id, skill_statement, evidence_text, evidence_start, evidence_end, required_or_preferred, alternative_group_id, annotator_id, skill_category FROM skills),
g AS (SELECT alternative_group_id, count(*) AS n, count(DISTINCT posting_id) AS postings, count(DISTINCT coalesce(required_or_preferred, '')) AS requirements, count(DISTINCT lower(trim(skill_statement))) AS skills, count(skill_statement) AS stated FROM s WHERE coalesce(trim(alternative_group_id), '') <> '' GROUP BY 1),
j AS (SELECT s.*, v.clean_text AS t, count(*) OVER (PARTITION BY annotation_id) AS uses, count(*) OVER (PARTITION BY s.snapshot_id, s.posting_id, evidence_start, evidence_end, lower(trim(skill_statement))) AS spans,
  coalesce(evidence_start >= 0 AND evidence_start < evidence_end AND evidence_end <= length(v.clean_text), false) AS ok FROM s LEFT JOIN valid v USING (snapshot_id, posting_id)),
p AS (SELECT annotation_id, 'skill_statement' AS field, 'empty' AS problem FROM j WHERE coalesce(trim(skill_statement), '') = ''
UNION ALL SELECT annotation_id, 'annotation_id', 'used more than once' FROM j WHERE uses > 1
UNION ALL SELECT annotation_id, 'required_or_preferred', 'unknown value' FROM j WHERE NOT coalesce(required_or_preferred IN ('required', 'preferred', 'unclear'), false)
UNION ALL SELECT annotation_id, 'annotator_id', 'empty' FROM j WHERE coalesce(trim(annotator_id), '') = ''
UNION ALL SELECT annotation_id, 'evidence_start', 'outside the text' FROM j WHERE t IS NOT NULL AND NOT ok
UNION ALL SELECT annotation_id, 'evidence_text', 'not at its place' FROM j WHERE ok AND coalesce(substr(t, evidence_start + 1, evidence_end - evidence_start) <> evidence_text, true)
UNION ALL SELECT annotation_id, 'evidence_text', 'blanks at its ends' FROM j WHERE ok AND evidence_text <> trim(evidence_text)
UNION ALL SELECT annotation_id, 'skill_statement', 'recorded twice for a span' FROM j WHERE coalesce(trim(skill_statement), '') <> '' AND evidence_start IS NOT NULL AND spans > 1
UNION ALL SELECT annotation_id, 'skill_category', 'unknown value' FROM j WHERE coalesce(trim(skill_category), '') <> '' AND skill_category NOT IN ('technical', 'soft')
UNION ALL SELECT annotation_id, CASE k WHEN 1 THEN 'alternative_group_id' WHEN 2 THEN 'alternative_group_id' WHEN 3 THEN 'required_or_preferred' ELSE 'skill_statement' END,
  CASE k WHEN 1 THEN 'only one member' WHEN 2 THEN 'used in several postings' WHEN 3 THEN 'mixed in an alternative group' ELSE 'twice in an alternative group' END
  FROM j JOIN g USING (alternative_group_id), range(1, 5) r(k) WHERE (k = 1 AND g.n < 2) OR (k = 2 AND g.postings > 1) OR (k = 3 AND g.requirements > 1) OR (k = 4 AND g.skills < g.stated)
UNION ALL SELECT annotation_id, 'alternative_group_id', 'malformed' FROM j WHERE coalesce(trim(alternative_group_id), '') <> '' AND NOT regexp_matches(alternative_group_id, '^[A-Za-z0-9_.-]{1,40}$'))
SELECT * FROM p""")
def annotation_problems(spark, d):
    columns = ["snapshot_id", "posting_id", "annotation_id", "skill_statement", "evidence_text", "evidence_start", "evidence_end", "required_or_preferred", "alternative_group_id", "annotator_id", "skill_category"]
    return N.annotation_problems(table(spark, d, "skills").select(*columns).distinct(), _all(spark, d, "clean_text"), categories=("technical", "soft"))


@query("SELECT DISTINCT annotation_id, array_to_string(list_filter([CASE WHEN contains(coalesce(review_notes, ''), 'DISCUSS') THEN 'discuss' END, CASE WHEN contains(coalesce(review_notes, ''), 'illustrative list') THEN 'illustrative' END, CASE WHEN starts_with(coalesce(review_notes, ''), 'AI-SUGGESTED') THEN 'suggested_addition' END], lambda x: x IS NOT NULL), ';') AS flags, coalesce(nullif(regexp_extract(esco_v, '\\bv(\\d+(?:\\.\\d+)+)', 1), ''), '') AS version, CASE skill_category WHEN 'language' THEN 'Language' WHEN 'technical' THEN 'Technical' ELSE 'unknown' END AS shown FROM skills, (SELECT max('taxonomy ' || esco_version || ' en') AS esco_v FROM esco_concepts)")
def note_flags(spark, d):
    line = F.lit("taxonomy " + table(spark, d, "esco_concepts").agg(F.max("esco_version")).first()[0] + " en")
    rows = table(spark, d, "skills").select(
        "annotation_id", F.array_join(X.note_flags(F.col("review_notes")), ";").alias("flags"), F.coalesce(X.version_in(line), F.lit("")).alias("version"),
        X.relabelled(F.col("skill_category"), {"language": "Language", "technical": "Technical"}).alias("shown"),
    )
    return rows.distinct()


@query("WITH " + _LATEST + " SELECT posting_id, '<posting id=\"' || posting_id || '\" title=\"' || coalesce(title, '') || '\">' || chr(10) || coalesce(clean_text, '') || chr(10) || '</posting>' AS prompt FROM cur")
def prompts(spark, d):
    rows = _cur(spark, d, "title", "clean_text")
    return rows.select("posting_id", X.envelope("posting", F.col("clean_text"), id=F.col("posting_id"), title=F.col("title")).alias("prompt"))


@query("SELECT DISTINCT ON (posting_id) posting_id, title FROM postings WHERE posting_id = (SELECT min(posting_id) FROM postings) AND snapshot_id = (SELECT max(snapshot_id) FROM postings WHERE posting_id = (SELECT min(posting_id) FROM postings))")
def point_lookup(spark, d):
    rows = table(spark, d, "postings")
    key = rows.agg(F.min("posting_id")).first()[0]
    own = reading.lookup(rows, posting_id=key)
    return reading.newest_first(own.select("posting_id", "title", "snapshot_id"), "snapshot_id", 1).select("posting_id", "title")


@query("WITH r AS (SELECT posting_id, CASE WHEN substr(sha256(posting_id), 1, 1) < 'a' THEN 'reviewed' ELSE 'in_progress' END AS review_status FROM (SELECT DISTINCT posting_id FROM postings)), k AS (SELECT DISTINCT posting_id FROM skills) SELECT CAST(count(*) AS BIGINT) AS selected, CAST(0 AS BIGINT) AS not_started, CAST(count_if(review_status = 'in_progress') AS BIGINT) AS in_progress, CAST(count_if(review_status = 'reviewed') AS BIGINT) AS reviewed, CAST(count_if(review_status = 'reviewed' AND k.posting_id IS NOT NULL) AS BIGINT) AS reviewed_with_skills, CAST(count_if(review_status = 'reviewed' AND k.posting_id IS NULL) AS BIGINT) AS reviewed_zero_skills, false AS complete FROM r LEFT JOIN k USING (posting_id)")
def review_progress(spark, d):
    reviews = table(spark, d, "postings").select("posting_id").distinct().withColumn("review_status", F.when(F.substring(F.sha2("posting_id", 256), 1, 1) < "a", "reviewed").otherwise("in_progress"))
    return N.review_progress(reviews, table(spark, d, "skills"))


@query("WITH " + _LATEST + " SELECT posting_id, strftime(timezone('UTC', CAST(fetched_at AS TIMESTAMPTZ)), '%Y-%m-%dT%H:%M:%SZ') AS stamp, strftime(timezone('UTC', CAST(source_updated_at AS TIMESTAMPTZ)), '%Y%m%dT%H%M%SZ') AS updated FROM cur")
def utc_stamps(spark, d):
    rows = _cur(spark, d, "fetched_at", "source_updated_at")
    return rows.select("posting_id", X.utc_stamp(F.to_timestamp("fetched_at")).alias("stamp"), X.snapshot_stamp(F.to_timestamp("source_updated_at")).alias("updated"))


@query("WITH " + _LATEST + r""", c AS (SELECT posting_id, substr(clean_text, 1, 20) AS head, trim(regexp_replace(clean_text, '\s+', ' ', 'g')) AS flat FROM cur WHERE clean_text IS NOT NULL) SELECT posting_id, head, CASE WHEN length(flat) <= 60 THEN flat ELSE substr(flat, 1, 59) || '…' END AS short FROM c""")
def excerpts(spark, d):
    rows = _cur(spark, d, "clean_text").where("clean_text IS NOT NULL")
    return rows.select("posting_id", X.around(F.col("clean_text"), F.lit(0), F.lit(0), 20).alias("head"), X.shorten(F.col("clean_text"), 60).alias("short"))


_REVIEWS = """h AS (SELECT posting_id, sha256(posting_id) AS h FROM (SELECT DISTINCT posting_id FROM postings WHERE posting_id IS NOT NULL)),
v AS (SELECT posting_id, CASE WHEN substr(h, 1, 1) < '8' THEN 'development' ELSE 'evaluation' END AS split, CASE WHEN substr(h, 2, 1) < '4' THEN 'not_started' WHEN substr(h, 2, 1) < '8' THEN 'in_progress' WHEN substr(h, 2, 1) < 'e' THEN 'reviewed' ELSE 'done' END AS review_status,
  CASE WHEN substr(h, 3, 1) < 'c' THEN 'ann' ELSE ' ' END AS annotator_id, CASE WHEN substr(h, 4, 1) < '8' THEN '2025-02-28' WHEN substr(h, 4, 1) < 'c' THEN '2025-02-30' ELSE 'soon' END AS reviewed_at, substr(h, 5, 1) AS h5 FROM h WHERE substr(h, 6, 1) < 'e'),
r AS (SELECT * FROM v UNION ALL SELECT * FROM v WHERE h5 = '0'),
c AS (SELECT posting_id, CASE WHEN substr(h, 1, 1) < '7' THEN 'development' ELSE 'evaluation' END AS split FROM h WHERE substr(h, 5, 1) < 'e')"""


@query("WITH " + _REVIEWS + """ SELECT r.posting_id, p.field, p.problem FROM r LEFT JOIN c USING (posting_id), LATERAL (SELECT unnest([
  CASE WHEN c.posting_id IS NULL THEN {'field': 'posting_id', 'problem': 'not selected'} END, CASE WHEN h5 = '0' THEN {'field': 'posting_id', 'problem': 'listed more than once'} END,
  CASE WHEN r.split <> c.split THEN {'field': 'split', 'problem': 'another split'} END, CASE WHEN review_status = 'done' THEN {'field': 'review_status', 'problem': 'unknown value'} END,
  CASE WHEN review_status = 'reviewed' AND annotator_id = ' ' THEN {'field': 'annotator_id', 'problem': 'missing on a reviewed posting'} END,
  CASE WHEN review_status = 'reviewed' AND reviewed_at <> '2025-02-28' THEN {'field': 'reviewed_at', 'problem': 'no ISO date'} END,
  CASE WHEN review_status = 'not_started' AND r.posting_id IN (SELECT posting_id FROM skills WHERE posting_id IS NOT NULL) THEN {'field': 'posting_id', 'problem': 'annotated but not started'} END]) AS p) WHERE p IS NOT NULL
UNION ALL SELECT posting_id, 'posting_id', 'selected but missing' FROM c WHERE posting_id NOT IN (SELECT posting_id FROM v)""")
def review_problems(spark, d):
    """What is wrong with review rows that follow from each posting's hash, against a selection that does."""
    place = lambda i: F.substring("h", i, 1)
    hashed = table(spark, d, "postings").where("posting_id IS NOT NULL").select("posting_id").distinct().withColumn("h", F.sha2("posting_id", 256))
    rows = hashed.where(place(6) < "e").select(
        "posting_id", F.when(place(1) < "8", "development").otherwise("evaluation").alias("split"),
        F.when(place(2) < "4", "not_started").when(place(2) < "8", "in_progress").when(place(2) < "e", "reviewed").otherwise("done").alias("review_status"),
        F.when(place(3) < "c", "ann").otherwise(" ").alias("annotator_id"), F.when(place(4) < "8", "2025-02-28").when(place(4) < "c", "2025-02-30").otherwise("soon").alias("reviewed_at"), place(5).alias("h5"),
    )
    selected = hashed.where(place(5) < "e").select("posting_id", F.when(place(1) < "7", "development").otherwise("evaluation").alias("split"))
    return N.review_problems(rows.unionByName(rows.where("h5 = '0'")).drop("h5"), selected, table(spark, d, "skills"))
