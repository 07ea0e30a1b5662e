from lodestrata.operators.snapshots import snapshot_changes, valid_rows

SCHEMA = "snapshot_id string, posting_id string, text_hash string, fetched_at string, kind string, k string"


def changes(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return {tuple(r) for r in snapshot_changes(df).collect()}


def test_added_removed_changed_and_back(spark):
    rows = [
        ("s1", "a", "1", "t1"), ("s2", "a", "1", "t2"), ("s3", "a", "2", "t3"), ("s4", "a", "2", "t4"),
        ("s1", "b", "1", "t1"), ("s4", "b", "1", "t4"), ("s2", "c", None, "t2"), ("s3", "c", None, "t3"), ("s4", "c", "9", "t4"),
    ]
    assert changes(spark, rows) == {("s3", "a", "changed"), ("s2", "b", "removed"), ("s4", "b", "added"), ("s2", "c", "added"), ("s4", "c", "changed")}


def test_late_corrections_and_repeats(spark):
    rows = [("s1", "a", "1", "t1"), ("s2", "a", "2", "t2"), ("s2", "a", "1", "t3"), ("s2", "a", "1", "t3")]
    assert changes(spark, rows) == set()


def test_null_keys_and_small_tables(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [("s1", "a", "1", "t1")]) == set()
    rows = [(None, "a", "1", "t"), ("s1", None, "1", "t"), ("s1", "a", "1", None), ("s2", "a", None, None)]
    assert changes(spark, rows) == {("s2", "a", "changed")}


def test_valid_rows_prefers_newest_then_greatest(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 2, "c"), (None, 3, "d")], "key string, v int, x string")
    assert [tuple(r) for r in valid_rows(df, ["key"], "v", ["x"]).collect()] == [("k", "c")]
