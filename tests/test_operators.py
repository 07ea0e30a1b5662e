import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.operators import analytics as A
from lodestrata.operators import annotation as N
from lodestrata.operators import checks, components, extraction, language, loading, pairs, prepare, reading, selection, taxonomy
from lodestrata.plans.records import OUTPUT_SCHEMA, echo_backend


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- duplicates and rows
def test_duplicates_follow_order_and_skip_null(spark):
    df = spark.createDataFrame([("b:9", 0, 9, "h", ""), ("b:10", 0, 10, "h", "x"), ("a:1", 1, 1, "h", ""), ("n:1", 0, 1, None, ""), ("n:2", 0, 2, None, "")], "posting_id string, board_order int, n int, text_hash string, exclusion_reason string")
    got = {r["posting_id"]: (r["exclusion_reason"], r["is_duplicate_of"]) for r in prepare.mark_duplicates(df, ["board_order", "n"]).collect()}
    assert got == {"b:9": ("", None), "b:10": ("x;exact_duplicate", "b:9"), "a:1": ("exact_duplicate", "b:9"), "n:1": ("", None), "n:2": ("", None)}


def test_build_rows(spark):
    from lodestrata.schemas import JOB
    from lodestrata.sources.boards import board_table, parse_boards

    boards = board_table(spark, parse_boards("boards:\n- {token: acme, company_name: Acme}\n- {token: beta, company_name: Beta}"))
    job = lambda i, title, content: (i, None, title, content, ("Rome",), [(1, "Eng"), (2, None), None], None, "u", "t", None, "Acme")
    raw = spark.createDataFrame([("acme", "20250101T000000Z", "f", job(22, "Engineer", "&lt;p&gt;Build  it.&lt;/p&gt;")), ("acme", "20250101T000000Z", "f", job(3, "General Application", "build it.")), ("beta", "20250101T000000Z", "f", job(1, "A", None)), ("odd", "20250101T000000Z", "f", job(1, "A", ""))], f"board_token string, snapshot_id string, fetched_at string, job {JOB.simpleString()}")
    built = {r["posting_id"]: r for r in prepare.build_rows(raw, boards, "1").collect()}
    assert set(built) == {"board:acme:22", "board:acme:3", "board:beta:1"}
    assert built["board:acme:22"]["is_duplicate_of"] == "board:acme:3" and built["board:acme:22"]["clean_text"] == "Build it."
    assert built["board:acme:3"]["exclusion_reason"] == "placeholder_title:general_application" and built["board:acme:3"]["departments"] == ["Eng"] and built["board:acme:3"]["offices"] == []
    assert built["board:beta:1"]["exclusion_reason"] == "missing_description" and built["board:beta:1"]["text_hash"] is None
    assert [r[0] for r in prepare.unmatched_boards(raw, boards).collect()] == ["odd"]


# ---- aggregates
def test_medians_differ(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 10)] + [("b", 5), ("c", None)], "k string, v int")
    assert rows(A.upper_median(df, "k", "v")) == [("a", 4, 3), ("b", 1, 5)]
    assert A.describe(df.where("k = 'a'"), "v").first()["p50"] == 2.5


def test_histogram_missing_and_crosstab(spark):
    df = spark.createDataFrame([(0.0, "", ["x"]), (1.0, None, []), (2.0, "q", None), (9.0, "q", ["x", None])], "v double, s string, a array<string>")
    assert rows(A.histogram(df, "v", [0, 1, 2, 5])) == [(0, 2), (1, 1), (2, 0)]
    assert rows(A.missing_rates(df)) == [("a", 2, 4), ("s", 2, 4), ("v", 0, 4)]
    assert ("All", "All", 4) in rows(A.crosstab(df, "v", "s")) and rows(A.value_counts(df, "a")) == [("x", 2)]
    assert rows(A.zero_filled(A.value_counts(df, "s"), ["p", "q"], "value", "rows")) == [("p", 0, 0), ("q", 1, 2)]


def test_language_share_ties_by_name(spark):
    df = spark.createDataFrame([("d", "fr", 5), ("d", "en", 5), ("e", "de", 1)], "k string, l string, n int")
    assert rows(A.language_share(df, "k", "l", "n")) == [("d", "en", 5, 10), ("e", "de", 1, 1)]


# ---- checks and loads
def test_row_problems(spark):
    good = ("b:a:1", "b", "1", "a", "Acme", "t", "text", "20250101T000000Z", "0" * 64, 1, False, "", None, "1", [], [])
    schema = "posting_id string, source string, source_job_id string, board_token string, company_name string, fetched_at string, clean_text string, snapshot_id string, text_hash string, word_count bigint, is_placeholder boolean, exclusion_reason string, is_duplicate_of string, cleaning_version string, departments array<string>, offices array<string>"
    names = [p.split()[0] for p in schema.split(", ")]

    def problems(**change):
        row = tuple(change.get(n, v) for n, v in zip(names, good, strict=True))
        return spark.createDataFrame([row], schema).select(checks.row_problems(spark.createDataFrame([row], schema))).first()[0]

    assert problems() == []
    for change in ({"posting_id": "x"}, {"company_name": " "}, {"snapshot_id": "2025"}, {"text_hash": "xyz"}, {"clean_text": None}, {"word_count": -1}, {"is_placeholder": True}, {"is_duplicate_of": "b:a:1"}, {"exclusion_reason": None}, {"departments": None}, {"text_hash": None}):
        assert problems(**change), change


def test_load_is_idempotent_and_refuses_conflicts(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    one = spark.createDataFrame([("s1", "a", 1, None), ("s1", "b", 2, "x")], "s string, id string, v int, n string")
    assert loading.load(one, path, ["s", "id"], "s") == {"inserted": 2, "unchanged": 0}
    assert loading.load(one, path, ["s", "id"], "s") == {"inserted": 0, "unchanged": 2}
    more = one.unionByName(spark.createDataFrame([("s2", "a", 9, None)], one.schema))
    assert loading.load(more, path, ["s", "id"], "s") == {"inserted": 1, "unchanged": 2}
    bad = spark.createDataFrame([("s1", "a", 5, None), ("s3", "z", 1, None)], one.schema)
    with pytest.raises(checks.CheckFailed):
        loading.load(bad, path, ["s", "id"], "s")
    with pytest.raises(checks.CheckFailed):
        loading.load(one.unionByName(one), path, ["s", "id"], "s")
    assert spark.read.parquet(path).count() == 3 and not list(tmp_path.glob("*staging*"))
    got = {r["id"]: (r["outcome"], r["differing"]) for r in loading.classify_load(bad, one, ["s", "id"]).collect()}
    assert got == {"a": ("conflict", ["v"]), "z": ("new", [])}


def test_frozen(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    loading.check_frozen(a, a)
    assert rows(loading.frozen_difference(a, a.distinct())) == [(1, "derived")]
    with pytest.raises(checks.CheckFailed):
        loading.check_frozen(a, a.distinct())


# ---- pairs and components
def test_blocked_pairs(spark):
    data = [("a", "B", "1", "T", "x y", "h"), ("b", "B", "1", "t ", "x z", "h"), ("c", "B", "1", "T", None, None), ("d", "C", "1", "T", "x", None), ("e", "B", None, "", "x", None), ("f", "B", None, "", "x", None)]
    df = spark.createDataFrame([(p, b, i, t, None, x, h, "") for p, b, i, t, x, h in data], "posting_id string, board_token string, internal_job_id string, title string, location string, clean_text string, text_hash string, exclusion_reason string")
    got = {(r["posting_id_a"], r["posting_id_b"]): (r["basis"], r["exact_text_match"], r["token_jaccard"]) for r in pairs.near_duplicate_candidates(df).collect()}
    assert got == {("a", "b"): ("internal_job_id+title", True, 0.3333), ("a", "c"): ("internal_job_id+title", False, 0.0), ("b", "c"): ("internal_job_id+title", False, 0.0)}


def union_find(entries):
    parent = {k: k for k, _ in entries}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for k, b in entries:
        if b is not None:
            by[b].append(k)
    for ks in by.values():
        for k in ks[1:]:
            a, b = sorted((find(ks[0]), find(k)))
            parent[b] = a
    return sorted((k, find(k)) for k in parent)


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    entries = [(f"k{rng.randrange(60):02}", rng.choice([None, *map(str, range(45))])) for _ in range(110)] + [(f"p{i:02}", f"q{i // 2}") for i in range(30)] + [(f"p{i:02}", f"r{(i + 1) // 2}") for i in range(30)]
    df = spark.createDataFrame([*entries, (None, "1")], "k string, b string")
    assert rows(components.shared_key_components(df, "k", "b")) == union_find(entries)


# ---- selection
@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(0, 50), min_size=1, max_size=8), st.integers(0, 200))
def test_quotas(capacity, total):
    if sum(capacity.values()) < total:
        with pytest.raises(selection.SelectionError):
            selection.quotas(capacity, total)
        return
    seats = selection.quotas(capacity, total)
    assert sum(seats.values()) == total and all(0 <= seats[k] <= capacity[k] for k in capacity)
    free = [seats[k] for k in capacity if seats[k] < capacity[k]]
    assert not free or max(seats.values()) - min(free) <= 1


def test_published_quotas():
    assert sorted(selection.quotas({"a": 9, "b": 54, "c": 80, "d": 129, "e": 139}, 100).values()) == [9, 22, 23, 23, 23]


def test_seeded_set(spark):
    df = spark.createDataFrame([(f"p{i:03}", f"g{i // 2}", "abc"[i % 6 // 2]) for i in range(240)], "id string, grp string, s string")
    one = selection.select_set(df, "id", "s", "grp", 30, 6, 7)
    assert rows(one) == rows(selection.select_set(df.repartition(7), "id", "s", "grp", 30, 6, 7)) != rows(selection.select_set(df, "id", "s", "grp", 30, 6, 8))
    got = one.collect()
    assert len(got) == len({r["grp"] for r in got}) == 30 and sum(r["split"] == "development" for r in got) == 6
    assert selection.leaking_groups(one, "grp", "split").isEmpty()


def test_draw_keeps_exactly_the_first(spark):
    df = spark.range(5000).select(F.col("id"), F.lit("x").alias("s"))
    seats = spark.createDataFrame([("x", 40)], "s string, seats int")
    want = sorted(r[0] for r in df.orderBy(selection.seeded(1, "id")).limit(40).collect())
    assert sorted(r["id"] for r in selection.draw(df, "s", "id", seats, 1).collect()) == want


# ---- taxonomy
def test_taxonomy_rules(spark):
    df = spark.createDataFrame([("s1", "2024", 1, "A"), ("s1", "2025", 3, "A"), ("s2", "2024", 2, None), ("s2", "2024", 4, "B")], "uri string, modified string, row int, label string")
    assert rows(taxonomy.keep_newest(df, "uri", "modified", "row").select("uri", "row")) == [("s1", 3), ("s2", 2)]
    assert rows(taxonomy.differing_columns(df, "uri", ("row",))) == [("s1", 2, ["modified"]), ("s2", 2, ["label"])]
    links = spark.createDataFrame([("s1", "s2", "G"), ("s1", "s2", "K"), ("s2", "s2", "K"), ("s1", "zz", "K")], "c string, p string, t string")
    kinds = spark.createDataFrame([("s1", "K"), ("s2", "K")], "uri string, kind string")
    resolved = taxonomy.resolve_links(links, ["c", "p"], kinds, "uri", "kind")
    assert tuple(taxonomy.link_problems(resolved, "c", "p", {"p": "t"}).first()) == (1, 1, 1, 1)
    assert taxonomy.has_cycle(spark.createDataFrame([("a", "b"), ("b", "a")], "c string, p string"), "c", "p") and not taxonomy.has_cycle(links.where("c <> p"), "c", "p")
    levels = spark.createDataFrame([("a", "", "b", None), ("a", "x", "b", "c")], "l0 string, l1 string, l2 string, l3 string")
    assert rows(taxonomy.path_links(levels, ["l0", "l1", "l2", "l3"])) == [("b", "a"), ("b", "x"), ("c", "b"), ("x", "a")]
    assert rows(spark.createDataFrame([("a\n b \n\n",), ("",), (None,)], "t string").select(X.split_labels(F.col("t")).alias("l"), X.dropped_labels(F.col("t")))) == [(["a", "b"], 2), ([], 0), ([], 0)]


# ---- annotation
def test_statements(spark):
    skill = "struct<skill_statement:string,evidence_text:string,evidence_context:string,requirement_status:string,mention_relation:string,alternative_group:string>"
    items = [("Go", "Go", "", "required", "core", "g"), ("go ", "Go", "", "required", "core", "g"), (" ", "Go", "", "", "", ""), ("Rust", "Rust", "", "preferred", "core", "g"), ("C", "nowhere", "", "", "", "")]
    df = spark.createDataFrame([("p", "Go or Rust.", items)], f"posting_id string, clean_text string, skills array<{skill}>")
    judged = N.statement_rows(df, "posting_id", "clean_text", "skills")
    got = {r["model_index"]: (r["ordinal"], r["reason"]) for r in judged.collect()}
    assert got[0] == (0, None) and got[3] == (1, None) and got[1][1].startswith("duplicate") and got[2][1] == "empty skill_statement" and got[4][1].startswith("unsupported")
    kept = N.drop_bad_alternatives(judged.where("reason IS NULL"), "posting_id").collect()
    assert all(r["alternative_group"] is None and "different requirement_status" in r["warning"] for r in kept)


def test_matching_and_agreement(spark):
    schema = "posting_id string, id string, start int, end int"
    a = spark.createDataFrame([("p", "a1", 0, 6), ("p", "a2", 10, 13), ("p", "a3", 30, 40), ("q", "a4", 0, 1)], schema)
    b = spark.createDataFrame([("p", "b1", 0, 6), ("p", "b2", 0, 14), ("r", "b3", 0, 1)], schema)
    m = N.match_spans(a, b)
    assert {(r["kind"], r["a_id"], r["b_id"]) for r in m.collect()} == {("exact", "a1", "b1"), ("overlap", "a2", "b2"), ("only_a", "a3", None), ("only_a", "a4", None), ("only_b", None, "b3")}
    assert tuple(N.agreement(m).first()) == (1, 1, 2, 1, 0.5714)
    assert N.agreement(m.limit(0)).first()["overlap_f1"] is None


def test_segments_make_up_the_text(spark):
    texts = spark.createDataFrame([("p", "Strong SQL and Python skills."), ("q", "plain"), ("e", "")], "k string, clean_text string")
    spans = spark.createDataFrame([("p", "x", 7, 10), ("p", "y", 7, 21), ("p", "bad", 5, 99), ("p", "z", -1, 3)], "k string, id string, start int, end int")
    got = sorted(N.segments(spans, texts, ["k"]).collect(), key=lambda r: (r["k"], r["start"]))
    assert [(r["start"], r["end"], r["ids"]) for r in got if r["k"] == "p"] == [(0, 7, []), (7, 10, ["x", "y"]), (10, 21, ["y"]), (21, 29, [])]
    assert [(r["start"], r["end"]) for r in got if r["k"] == "q"] == [(0, 5)] and not [r for r in got if r["k"] == "e"]


# ---- calls, language, views
def test_calls(spark):
    df = spark.createDataFrame([("a", "Hello there"), ("b", ""), ("c", "lower")], "posting_id string, clean_text string")
    requests = extraction.with_keys(df, model="m", prompt="1").withColumn("prompt", F.col("clean_text"))
    judged = extraction.judge(extraction.complete(requests, echo_backend), OUTPUT_SCHEMA)
    assert {r["posting_id"]: r["status"] for r in judged.collect()} == {"a": "ok", "b": "failed", "c": "zero_skills"}
    totals = extraction.run_totals(judged).first()
    assert (totals["ok"], totals["zero_skills"], totals["failed"], totals["input_tokens"]) == (1, 1, 1, 3)
    key = {r["posting_id"]: r["cache_key"] for r in requests.collect()}
    cache = spark.createDataFrame([(key["a"], False, 1), (key["a"], True, 2), (key["b"], False, 1)], "cache_key string, valid boolean, received_at int")
    assert {r["posting_id"]: r["action"] for r in extraction.call_plan(requests, cache).collect()} == {"a": "cached (valid)", "b": "cached (invalid, would re-call)", "c": "would call"}
    assert key["a"] != extraction.with_keys(df, model="m", prompt="2").where("posting_id = 'a'").first()["cache_key"]
    bad = spark.createDataFrame([("x", "k", b, s) for b, s in (("{", "end_turn"), ('{"skills": []}', "end_turn"), ('{"skills": [], "no_skills_reason": " "}', "end_turn"), ("{}", "max_tokens"), (None, "end_turn"), ("{}", None))], "posting_id string, cache_key string, body string, stop_reason string")
    assert extraction.judge(bad, OUTPUT_SCHEMA).where("status <> 'failed'").isEmpty()


def test_language_rules(spark):
    en = "You will write the reports of the team and explain them to our customers in the office. We are looking for a person who can plan this work with us and who will help the others."
    fr = "Vous allez écrire les rapports de l'équipe et les expliquer à nos clients dans le bureau. Nous cherchons une personne qui peut préparer ce travail avec nous et qui va aider les autres."
    df = spark.createDataFrame([("en", en), ("fr", fr), ("short", "the work"), ("none", " "), ("null", None), ("mix", f"{en}\n\n{en}\n\n{fr}")], "id string, t string")
    got = {r["id"]: r for r in language.detect(df, "id", "t").collect()}
    assert (got["en"]["language"], got["fr"]["language"], got["none"]["language"], got["null"]["reasons"]) == ("en", "fr", None, "empty_text")
    assert "short_text" in got["short"]["reasons"] and got["mix"]["language"] == "en" and got["mix"]["other_paragraphs"] == 1 and "other_language_paragraphs" in got["mix"]["reasons"]


def test_views(spark):
    df = spark.createDataFrame([("a", "X", "Big Engineer", ""), ("b", "X", "Cook", "r"), ("c", "Y", None, "")], "posting_id string, company string, title string, exclusion_reason string")
    ids = lambda d: [r[0] for r in rows(d.select("posting_id"))]
    assert ids(reading.filtered(df, {"company": "X"}, "usable")) == ["a"] and ids(reading.filtered(df, {"company": ""}, "excluded")) == ["b"] and ids(reading.filtered(df, contains={"title": "ENGINE"})) == ["a"] and ids(reading.filtered(df, state="r")) == ["b"]
    manifest = spark.createDataFrame([("a", "evaluation", "a;c"), ("b", "development", "b"), ("d", "evaluation", "d;b")], "posting_id string, split string, group_members string")
    hidden = reading.held_out(manifest)
    assert ids(hidden) == ["a", "c", "d"] and ids(reading.visible(df, hidden)) == ["b"]
    assert rows(reading.details(df.select("posting_id"), "posting_id", {"title": df}, {"n": manifest}))[2] == ("c", "", 0)
