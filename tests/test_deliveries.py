import json

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.functions.jsonschema import Schema, schema_errors
from lodestrata.operators import analytics as A
from lodestrata.operators import extraction, loading, selection, taxonomy
from lodestrata.operators.checks import CheckFailed
from lodestrata.sinks import files as out
from lodestrata.sinks import publish


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def concepts(spark, *data):
    return spark.createDataFrame([(u, k, l, [l or ""], []) for u, k, l in data], "concept_uri string, concept_type string, preferred_label string, alt_labels array<string>, hidden_labels array<string>")


def test_taxonomy_import_is_whole_or_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    good = concepts(spark, ("http://a", "SkillGroup", "a"), ("http://b", "KnowledgeSkillCompetence", "b"))
    links = spark.createDataFrame([("http://b", "http://a")], "child string, parent string")
    for bad, bad_links in [
        (concepts(spark, ("a", "SkillGroup", "a")), links.limit(0)), (concepts(spark, ("http://a", "Odd", "a")), links.limit(0)), (concepts(spark, ("http://a", "SkillGroup", " ")), links.limit(0)),
        (good.unionByName(good), links), (good, links.unionByName(links)), (good, spark.createDataFrame([("http://b", "http://z")], links.schema)), (good, spark.createDataFrame([("http://b", "http://b")], links.schema)),
    ]:
        with pytest.raises(CheckFailed):
            taxonomy.import_taxonomy(bad, bad_links, path, "v1", "en", "d1")
    assert not publish.exists(spark, path)
    assert taxonomy.import_taxonomy(good, links, path, "v1", "en", "d1") == {"concepts": 2, "links": 1, "labels": 4}
    assert taxonomy.import_taxonomy(good, links, path, "v1", "en", "d1") is None
    for version, language, digest in (("v1", "de", "d1"), ("v1", "en", "d2"), ("v2", "en", "d1")):
        with pytest.raises(CheckFailed):
            taxonomy.import_taxonomy(good, links, path, version, language, digest)
    # Folders that a broken import left behind aren't seen, and the next try replaces them.
    good.write.parquet(f"{path}/concepts/import_id=v2-en")
    assert loading.imported(spark, path, "concepts").count() == 2
    assert taxonomy.import_taxonomy(good, links, path, "v2", "en", "d2")["concepts"] == 2
    assert loading.imported(spark, path, "concepts").count() == 4
    assert loading.prior_imports(spark.read.schema(loading.LEDGER).parquet(f"{path}/imports"), version="v2", digest="d2").count() == 1


def test_schema_version_gate(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    loading.require_version(spark, path, 3)
    loading.require_version(spark, path, 3)
    with pytest.raises(CheckFailed):
        loading.require_version(spark, path, 4)


def test_run_is_resumed_by_the_same_model_only(spark, tmp_path):
    path, requests = f"file://{tmp_path}/run", spark.createDataFrame([("a",), ("b",), ("c",)], "posting_id string")
    todo, kept = extraction.resume(requests, path, {"model": "m"})
    assert todo.count() == 3 and kept is None
    done = spark.createDataFrame([("a", "ok", "m"), ("b", "failed", "m")], "posting_id string, status string, model string")
    extraction.store_run(path, spark.createDataFrame([("a", "x"), ("b", "y")], "posting_id string, statement string"), done)
    todo, kept = extraction.resume(requests, path, {"model": "m"})
    assert rows(todo) == [("b",), ("c",)] and rows(kept) == [("a", "x")]
    with pytest.raises(CheckFailed):
        extraction.resume(requests, path, {"model": "n"})


def test_history_keeps_all_and_cache_the_newest(spark, tmp_path):
    path = f"file://{tmp_path}/h"
    schema = "cache_key string, posting_id string, received_at string, body string"
    assert extraction.store_responses(spark.createDataFrame([("k", "p", "1", "old")], schema), path) == 1
    extraction.store_responses(spark.createDataFrame([("k", "p", "2", "new"), ("j", "q", "1", None)], schema), path)
    history = spark.read.schema(schema).parquet(path)
    assert history.count() == 3 and {(r["cache_key"], r["body"]) for r in extraction.latest_responses(history).collect()} == {("k", "new"), ("j", None)}


def test_totals_of_runs(spark):
    df = spark.createDataFrame([("ok", 5, None, ["a", "b"], True), ("failed", None, 2, None, False)], "status string, input_tokens bigint, output_tokens bigint, attempts array<string>, cache_hit boolean")
    assert extraction.run_totals(df).first().asDict() == {"attempts": 2, "cache_hits": 1, "ok": 1, "zero_skills": 0, "failed": 1, "input_tokens": 5, "output_tokens": 2}


def test_export_refuses_protected_and_known_folders(spark, tmp_path):
    path, df = f"file://{tmp_path}/e", spark.range(2).toDF("id")
    target = publish.export({"a": df, "b": df}, path, "20250101T000000Z")
    assert spark.read.parquet(f"{target}/b").count() == 2
    with pytest.raises(ValueError):
        publish.export({"a": df}, path, "20250101T000000Z")
    with pytest.raises(ValueError):
        publish.export({"a": df}, path, "x", (path,))


def test_small_files(spark, tmp_path):
    log, template = tmp_path / "l.jsonl", tmp_path / "t.csv"
    out.append_lines(log, [{"a": "é"}])
    out.append_lines(log, [{"a": None}, {"b": 1}])
    assert [json.loads(line) for line in log.read_text().splitlines()] == [{"a": "é"}, {"a": None}, {"b": 1}]
    template.write_text("x")
    out.clone_file(template, tmp_path / "u.csv")
    with pytest.raises(FileExistsError):
        out.clone_file(template, tmp_path / "u.csv")
    df = spark.range(1000).toDF("id")
    assert len(out.csv_text(df).splitlines()) == 1001 and out.markdown_table(df).count("\n") == 1001
    with pytest.raises(ValueError):
        out.csv_text(spark.range(out.MOST_ROWS + 1).toDF("id"))


def test_compiled_schema():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "array", "items": {"anyOf": [{"type": "integer"}, {"enum": ["x"]}]}}, "b": {"type": ["string", "null"]}}}
    assert Schema(schema).errors({"a": [1, "x"], "b": None}) == []
    assert schema_errors({"a": [1, "y", True], "b": 2, "c": 0}, schema) == ["$: unknown c", "$.b: expected string or null", "$.a[1]: matches no alternative", "$.a[2]: matches no alternative"] or sorted(schema_errors({"a": [1, "y", True], "b": 2, "c": 0}, schema)) == sorted(["$: unknown c", "$.b: expected string or null", "$.a[1]: matches no alternative", "$.a[2]: matches no alternative"])
    assert schema_errors([], schema) == ["$: expected object"] and schema_errors({}, schema) == ["$: missing a"]
    assert Schema(schema).errors_of_text("{") == ["$: invalid JSON"] and Schema(schema).errors_of_text(None) == ["$: invalid JSON"]


def test_draw_keeps_every_winner(spark):
    """Against a plain sort, with strata of very unequal sizes and seats beyond them."""
    df = spark.createDataFrame([("big", i) for i in range(3000)] + [("small", i) for i in range(5)] + [(None, 1)], "s string, id int")
    seats = spark.createDataFrame([("big", 700), ("small", 9), ("none", 2)], "s string, seats int")
    got = {(r["s"], r["id"]) for r in selection.draw(df, "s", "id", seats, 3).collect()}
    keyed = df.withColumn("h", selection.seeded(3, "id")).collect()
    want = {(s, r["id"]) for s, n in (("big", 700), ("small", 9)) for r in sorted((r for r in keyed if r["s"] == s), key=lambda r: (r["h"], r["id"]))[:n]}
    assert got == want


def test_least_seats(spark):
    df = spark.createDataFrame([("a", 97), ("b", 2), ("c", 1)], "k string, n int")
    seats = lambda total, least: {r["k"]: r["seats"] for r in selection.largest_remainder(df, "k", "n", total, least=least).collect()}
    assert seats(10, 0) == {"a": 10, "b": 0, "c": 0} and seats(10, 1) == {"a": 8, "b": 1, "c": 1} or sum(seats(10, 1).values()) == 10 and min(seats(10, 1).values()) >= 1
    assert seats(2, 1) == {"a": 2, "b": 0, "c": 0}


def test_set_gives_every_cell_a_seat(spark):
    data = [(f"p{i}", "s1" if i % 2 else "s2", f"g{i}", "junior" if i < 4 else "senior", f"d{i % 5}") for i in range(120)]
    df = spark.createDataFrame(data, "id string, s string, g string, cell string, dept string")
    chosen = selection.select_set(df, "id", "s", "g", 20, 6, 1, cell="cell", variety="dept").join(df.select("id", "cell"), "id").collect()
    assert len(chosen) == 20 and sum(r["split"] == "development" for r in chosen) == 6
    assert all(any(r["s"] == s and r["cell"] == c for r in chosen) for s in ("s1", "s2") for c in ("junior", "senior"))


def test_places_in_texts(spark):
    df = spark.createDataFrame([("ab ab ab", "ab", "x ab", "Remote, US"), (None, "a", None, None), ("aaa", "", "", "Rome; Paris")], "t string, e string, c string, l string")
    assert rows(df.select(X.nth_occurrence(F.col("t"), F.col("e"), 2), X.outside_us(F.col("l")), X.several_places(F.col("l")), X.is_remote(F.col("l")))) == sorted([(3, False, False, True), (None, True, False, False), (None, True, True, False)], key=str)
    got = df.select(X.resolve_evidence(F.lit("a b. a c."), F.lit(" a "), F.lit("a c")).alias("r"), X.resolve_evidence(F.lit("a b. a c."), F.lit("a"), F.lit("zz")).alias("q"), X.resolve_evidence(F.lit("x"), F.lit("x"), F.lit(None).cast("string")).alias("o")).first()
    assert tuple(got["r"]) == (5, 6, "context (2 occurrences), trimmed whitespace", None)
    assert got["q"]["start"] is None and got["q"]["reason"].endswith("2 times and context not found") and tuple(got["o"]) == (0, 1, "unique", None)


def test_rates_and_medians(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, None), ("b", None, False)], "k string, v int, f boolean")
    assert rows(A.rates(df, {"f": F.col("f")}, ["k"])) == [("a", 2, 1.0), ("b", 1, 0.0)]
    assert rows(A.medians(df, ["k"], "v")) == [("a", 2, 1.5), ("b", 0, None)]
