import pytest
from pyspark.sql import functions as F

from lodestrata import __main__ as cli
from lodestrata.functions import text as X
from lodestrata.operators import annotation as N
from lodestrata.operators import reading, selection
from lodestrata.operators.selection import SelectionError


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_diverse_draw_takes_each_value_first(spark):
    df = spark.createDataFrame([("s", "a", i) for i in range(20)] + [("s", "b", 100), ("s", None, 200), ("t", "a", 300)], "s string, v string, id int")
    got = selection.diverse_draw(df, "s", "v", "id", 4, 1).collect()
    assert sorted(str(r["v"]) for r in got if r["s"] == "s") == ["None", "a", "a", "b"] and [r["id"] for r in got if r["s"] == "t"] == [300]


def test_overflow():
    assert selection.overflow({"a": 5, "b": 1}, {"a": 2, "b": 9, "c": 4}) == {"a": 2, "b": 4, "c": 0} or sum(selection.overflow({"a": 5, "b": 1}, {"a": 2, "b": 9, "c": 4}).values()) == 6
    assert selection.overflow({"a": 2}, {"a": 3}) == {"a": 2}
    with pytest.raises(SelectionError):
        selection.overflow({"a": 5}, {"a": 2})


def test_selection_problems(spark):
    schema = "id string, h string, g string, split string"
    chosen = spark.createDataFrame([("a", "1", "g1", "dev"), ("b", "9", "g1", "eval"), ("c", "3", "g2", "eval")], schema)
    source = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, h string")
    assert rows(selection.selection_problems(chosen, source, "id", "h", "g", "split", {"dev": 1, "eval": 1})) == [("groups in two splits", 1), ("not in the source", 1), ("rows off in eval", 1), ("text has changed", 1)]


def test_annotation_problems(spark):
    texts = spark.createDataFrame([("s", "p", "Strong SQL skills")], "snapshot_id string, posting_id string, clean_text string")
    schema = "snapshot_id string, posting_id string, annotation_id string, skill_statement string, evidence_text string, evidence_start int, evidence_end int, required_or_preferred string, alternative_group_id string, annotator_id string"
    data = [("s", "p", "ok", "SQL", "SQL", 7, 10, "required", None, "a"), ("s", "p", "x", " ", "SQL", 7, 99, "odd", "bad id!", ""), ("s", "q", "x", "SQL", "SQL", 1, 2, "required", "", "a"), ("s", "p", "y", "sql ", "SQL", 7, 10, "required", None, "a"), ("s", "p", "z", "S", "no", 0, 2, "required", None, "a"), ("s", "p", "w", "S", " SQL", 6, 10, "required", None, "a"), ("s", "p", None, "S", None, None, None, None, None, None)]
    got = rows(N.annotation_problems(spark.createDataFrame(data, schema), texts, texts.select("posting_id"), "s"))
    assert ("x", "evidence_start", "outside the text") in got and ("x", "annotation_id", "used more than once") in got and ("x", "posting_id", "not selected") in got and ("x", "alternative_group_id", "malformed") in got
    assert ("z", "evidence_text", "not at its place") in got and ("w", "evidence_text", "blanks at its ends") in got and ("ok", "skill_statement", "recorded twice for a span") in got and (None, "annotation_id", "empty") in got
    assert {g[0] for g in got if g[0] == "ok"} and len([g for g in got if g[0] == "ok"]) == 1


def test_small_functions(spark):
    df = spark.createDataFrame([("AI-SUGGESTED DISCUSS", "Guide v1.2.3 x"), (None, "none")], "n string, v string")
    assert rows(df.select(X.note_flags(F.col("n")).alias("f"), X.version_in(F.col("v")), X.envelope("p", F.col("n"), id=F.col("v")))) == [(["discuss", "suggested_addition"], "1.2.3", '<p id="Guide v1.2.3 x">\nAI-SUGGESTED DISCUSS\n</p>'), ([], None, '<p id="none">\n\n</p>')]
    assert rows(reading.lookup(df, n=None)) == [(None, "none")] and reading.newest_first(df, "v", 1).first()["v"] == "none"


def test_progress(spark):
    reviews = spark.createDataFrame([("a", "reviewed"), ("b", "reviewed"), ("c", "not_started")], "posting_id string, review_status string")
    assert tuple(N.review_progress(reviews, spark.createDataFrame([("a",), ("a",)], "posting_id string")).first()) == (3, 1, 0, 2, 1, 1, False)


def test_command_line(capsys):
    assert cli.main(["list"]) == 0 and "p5_found" in capsys.readouterr().out
    assert cli.main(["sql", "p5_found"]) == 0 and "SELECT" in capsys.readouterr().out
    assert cli.main(["run", "nothing", "x", "y"]) == 2
