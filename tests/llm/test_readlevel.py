import random

from lodestrata.llm import readlevel as R
from tests.llm.test_languages import TEXTS, model  # noqa: F401

rng = random.Random(2)
EASY = "we stack the box and mend the hat . you sort a tool each day . the work is fun and the pay is good".split()
MIDDLE = "the team reports to the manager and plans quarterly budgets with customers . we improve schedules before the summer".split()
HARD = "notwithstanding institutional prerequisites the consortium endeavours to operationalise methodological conceptualisation and jurisdictional commensurability".split()


def text(words, n=60):
    return " ".join(rng.choices(words, k=n))


def test_held_out_accuracy():
    rows = [(text(w), g) for g, w in enumerate((EASY, MIDDLE, HARD)) for _ in range(30)]
    rng.shuffle(rows)
    fitted = R.Grades([t for t, _ in rows[:60]], [g for _, g in rows[:60]])
    assert sum(fitted.level(t)[1] == g for t, g in rows[60:]) >= 28
    assert fitted.of["commensurability"] > fitted.of["budgets"] > fitted.of["mend"]
    assert fitted.level("zzz qqq")[1] == 1 and fitted.level("")[1] == 1


def test_votes(spark):
    df = spark.createDataFrame([(1, "a", "plain"), (1, "b", " PLAIN"), (1, "c", "demanding"), (2, "a", None), (2, "b", "odd"), (None, "a", "plain"), (3, "a", "middle"), (3, "a", "middle"), (4, "a", "plain"), (4, "b", "demanding")], "doc_id bigint, rater_id string, band string")
    assert {tuple(r) for r in R.votes(df, "doc_id", "rater_id", "band").collect()} == {(1, 0), (3, 1), (4, 1)}


def test_table(spark, model):  # noqa: F811
    fitted = R.Grades([text(w) for w in (EASY, MIDDLE, HARD) for _ in range(10)], [g for g in range(3) for _ in range(10)])
    long_english = " ".join([TEXTS["en"]] * 3)
    docs = [(1, long_english), (2, " ".join([TEXTS["fr"]] * 3)), (3, TEXTS["en"][:60]), (4, None), (5, ""), (6, long_english + "\n\n" + TEXTS["de"]), (None, long_english), (1, long_english), (7, (TEXTS["en"] + " ") * 500)]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, band string")
    rows = R.reading_levels(df, "doc_id", "text", fitted, model).collect()
    bands = {r["doc_id"]: r["band"] for r in rows}
    assert len(rows) == 9 and bands[1] and bands[6] and bands[7] and bands[None]
    assert [bands[k] for k in (2, 3, 4, 5)] == [None] * 4
    assert R.reading_levels(df.limit(0), "doc_id", "text", fitted, model).count() == 0
