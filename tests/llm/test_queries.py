import difflib

from lodestrata.llm import queries
from tests.llm.test_languages import TEXTS


def postings(spark, tmp_path):
    rows = []
    for s in ("s1", "s2"):
        for c, t in TEXTS.items():
            rows += [(s, f"{c}{i}", "2026-01-01", c, f"{t} {t}", 2 * len(t.split())) for i in range(3)]
    rows += [
        ("s1", "gone", "2026-01-01", "de", TEXTS["de"] + " " + TEXTS["de"], 60),
        ("s2", "short", "2026-01-01", "en", TEXTS["en"], 30),
        ("s2", "short", "2026-01-02", "en", TEXTS["fr"], 30),
        ("s2", "short2", "2026-01-02", "en", TEXTS["fr"].upper(), 30),
        ("s2", "empty", "2026-01-01", None, None, 0),
        (None, "no snapshot", "2026-01-01", "en", TEXTS["en"], 30),
    ]
    spark.createDataFrame(rows, "snapshot_id string, posting_id string, fetched_at string, source_language string, clean_text string, word_count bigint").write.parquet(f"{tmp_path}/postings.parquet")
    return str(tmp_path)


def test_languages_of_every_valid_posting(spark, tmp_path):
    rows = queries.p1_languages(spark, postings(spark, tmp_path)).where("seg = 0").collect()
    found = {(r["snapshot_id"], r["posting_id"]): r["lang"] for r in rows}
    assert len(rows) == len(found) == 2 * 3 * len(TEXTS) + 4
    assert found["s1", "gone"] == "de" and found["s2", "short"] == "fr" and found["s2", "empty"] is None and found["s1", "nl0"] == "nl"


def test_classes_hold_short_postings(spark, tmp_path):
    rows = {r["posting_id"]: r for r in queries.p3_classes(spark, postings(spark, tmp_path)).collect()}
    assert len(rows) == 3 * len(TEXTS) + 3 and "gone" not in rows
    assert rows["short"]["class"] == rows["short2"]["class"] == rows["fr0"]["class"] and rows["short"]["copies"] == 4
    assert rows["empty"]["copies"] == 0 and rows["empty"]["linked_classes"] == 0


def test_pairs_have_both_similarities(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(50))
    texts = {"a": text, "b": text, "c": " ".join(reversed(text.split())), "d": text.replace("word9 ", "other "), "e": "nothing " * 50}
    rows = [("s1", k, "2026-01-01", f"board {k}", f"title {k}", t, 50) for k, t in texts.items()]
    spark.createDataFrame(rows, "snapshot_id string, posting_id string, fetched_at string, board_token string, title string, clean_text string, word_count bigint").write.parquet(f"{tmp_path}/postings.parquet")
    found = {(r["posting_id_a"], r["posting_id_b"]): (r["text_similarity"], r["token_jaccard"]) for r in queries.p3_pairs(spark, str(tmp_path)).collect()}
    ratio = lambda a, b: round(difflib.SequenceMatcher(None, texts[a], texts[b], autojunk=False).ratio(), 4)
    near = round(49 / 51, 4)
    assert found == {("a", "b"): (1.0, 1.0), ("a", "c"): (ratio("a", "c"), 1.0), ("b", "c"): (ratio("b", "c"), 1.0), **{p: (ratio(*p), near) for p in (("a", "d"), ("b", "d"), ("c", "d"))}}
