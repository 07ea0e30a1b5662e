"""The review list: its similarity beside difflib's, and blocks of many rows."""

from __future__ import annotations

import difflib
import random

from pyspark.sql import functions as F

from lodestrata.functions import jvm
from lodestrata.operators import pairs

SCHEMA = "posting_id string, board_token string, internal_job_id string, title string, location string, clean_text string, text_hash string, exclusion_reason string"


def texts(seed):
    draw = random.Random(seed)
    words = ["data", "team", "plans", "plan", "the", "a", "and", "Straße", "设计", "😀", "you", "your", "design", "designs"]
    sentences = [" ".join(draw.choices(words, k=draw.randrange(3, 12))) + draw.choice([".", "!\n", ""]) for _ in range(12)]

    def chars(alphabet, most):
        return "".join(draw.choices(alphabet, k=draw.randrange(most)))

    cases = [("", ""), ("", "x"), (None, None), (None, "x"), ("same", "same"), ("a" * 300, "a" * 200), ("ab" * 90, "ba" * 70), ("😀a", "a😀"), ("é", "é")]
    for alphabet in ("a", "ab", "abc", "abcdef", "ab😀 "):
        cases += [(chars(alphabet, most), chars(alphabet, most)) for most in (5, 20, 80, 300) for _ in range(10)]
    cases += [(" ".join(draw.choices(sentences, k=8)), " ".join(draw.choices(sentences, k=8))) for _ in range(60)]
    cases += [(chars("abc", 60), chars("xyz", 60) + "c") for _ in range(5)]
    return cases


def difflib_ratio(a, b):
    return difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).ratio()


def test_ratio_is_that_of_difflib(spark):
    cases = texts(5)
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a string, b string")
    got = dict(df.select("i", jvm.seq_ratio(spark, "a", "b")).collect())
    assert [i for i, (a, b) in enumerate(cases) if got[i] != difflib_ratio(a, b)] == []


def test_ratio_without_the_list_of_stretches(spark):
    jvm.register(spark)
    one = spark.sparkContext._lodestrata_loader.loadClass("lodestrata.SeqRatio").getDeclaredConstructors()[0].newInstance(None)
    cases = [(a, b) for a, b in texts(6) if a is not None and b is not None][::4]
    assert [(a, b) for most in (0, 1, 10) for a, b in cases if one.bounded(a, b, most) != difflib_ratio(a, b)] == []


def test_ratio_of_long_texts(spark):
    draw = random.Random(7)
    words = ["".join(draw.choices("etaoinshrdlu", k=draw.randrange(2, 9))) for _ in range(300)]
    a, b = (" ".join(draw.choices(words, k=1100)) for _ in range(2))
    assert len(a) * len(b) > 1 << 24
    assert spark.createDataFrame([(a, b)], "a string, b string").select(jvm.seq_ratio(spark, "a", "b")).first()[0] == difflib_ratio(a, b)


def test_function_in_another_session(spark):
    other = spark.newSession()
    assert other.createDataFrame([("abcd", "bcde")], "a string, b string").select(jvm.seq_ratio(other, "a", "b")).first()[0] == 0.75


def test_scored_without_python(spark):
    df = spark.createDataFrame([("a", "B", "1", "T", None, "x y", "h", "")], SCHEMA)
    assert "EvalPython" not in pairs.near_duplicate_candidates(df)._jdf.queryExecution().toString()


def test_great_block_in_parts(spark):
    n = 2 * pairs.PART + 3
    df = spark.range(n).select(
        F.col("id").cast("string").alias("posting_id"), F.lit("B").alias("board_token"), F.when(F.col("id") < 5, "7").alias("internal_job_id"), F.lit("T ").alias("title"),
        F.lit(None).cast("string").alias("location"), F.concat(F.lit("x "), F.col("id")).alias("clean_text"), F.lit(None).cast("string").alias("text_hash"), F.lit("").alias("exclusion_reason"),
    )
    found = pairs.near_duplicate_candidates(df).groupBy("basis", "group_key").agg(F.count("*"), F.countDistinct("posting_id_a", "posting_id_b"), F.max("shared_tokens"), F.min("all_tokens")).collect()
    both, all_ = 10, n * (n - 1) // 2
    assert sorted(map(tuple, found)) == [("internal_job_id+title", "internal_job_id=7 | title=t", both, both, 1, 3), ("title", "title=t", all_ - both, all_ - both, 1, 3)]
