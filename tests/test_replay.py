import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import combine, reading, replay, snapshots
from lodestrata.operators.checks import CheckFailed
from lodestrata.streaming import events as log

SCHEMA = "scope string, n int, saw int, request string, kind string, outcome_of string"


def brute(events):
    out, version, seen = {}, {}, {}
    first = {}
    for s, n, _, r, *_ in sorted(events, key=lambda e: e[1]):
        if r is not None:
            first.setdefault((s, r), n)
    for s, n, saw, r, *_ in sorted(events, key=lambda e: e[1]):
        outcome, version[s] = replay.step(version.get(s, 0), saw, r is not None and first[s, r] < n)
        out[s, n] = (outcome, version[s])
    return out


def events(k=200):
    rng = random.Random(4)
    return [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), n, rng.choice([None, None, rng.randrange(60)]), rng.choice([None, f"r{rng.randrange(40)}"]), rng.choice("xy"), "o") for n in range(k)]


def test_replay_equals_plain_fold(spark):
    rows = events()
    found = replay.replay(spark.createDataFrame(rows, SCHEMA), "scope", "n", "saw", "request")
    assert {(r["scope"], r["n"]): (r["outcome"], r["version"]) for r in found.collect()} == brute(rows)
    assert found.columns == ["scope", "n", "saw", "request", "kind", "outcome_of", "outcome", "version"]
    assert replay.replay(spark.createDataFrame([], SCHEMA), "scope", "n", "saw", "request").count() == 0


def test_last_decision_and_side_output(spark):
    rows = [("a", 1, None, "r1", "keep", ""), ("a", 2, 1, None, "drop", ""), ("a", 3, 1, None, "late", ""), ("a", 4, None, "r1", "again", ""), ("a", 5, 2, None, "keep", "")]
    found = replay.replay(spark.createDataFrame(rows, SCHEMA), "scope", "n", "saw", "request")
    assert [tuple(r) for r in replay.last_decisions(found, ["scope"], "n", ["kind"]).collect()] == [("a", "keep", 3)]
    assert [r["n"] for r in replay.stale_events(found).collect()] == [3]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Two runs over one checkpoint: state is kept between them, and what is stale goes to the side."""
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "at"))
    write = lambda rows: spark.createDataFrame(rows, "scope string, n int, saw int").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: replay.replay_stream(spark.readStream.schema("scope string, n int, saw int").parquet(source), "scope", "n", "saw")
    for part in ([("a", 2, 0), ("a", 1, None)], [("a", 3, 1), ("a", 4, 0), ("b", 1, 0)]):
        write(part)
        log.run_once(stream(), lambda batch, number: batch.write.mode("append").parquet(sink), checkpoint)
    got = {(r["scope"], r["n"]): (r["outcome"], r["version"]) for r in spark.read.parquet(sink).collect()}
    assert got == {("a", 1): ("applied", 1), ("a", 2): ("stale", 1), ("a", 3): ("applied", 2), ("a", 4): ("stale", 2), ("b", 1): ("applied", 1)}


def test_late_rows_are_dropped(spark, tmp_path):
    from lodestrata.schemas import EVENTS

    source, checkpoint, seen = str(tmp_path / "in"), str(tmp_path / "at"), []
    for hour in (0, 10, 1, 20):  # the third comes after the watermark has passed it
        row = spark.sql(f"SELECT CAST({hour} AS BIGINT) AS event_id, TIMESTAMP_NTZ '2024-01-01 {hour:02}:30:00' AS ts, CAST(1 AS BIGINT) AS user_id, 'x' AS event_type, CAST(1 AS DOUBLE) AS value, '' AS props")
        row.select(*EVENTS.fieldNames()).coalesce(1).write.mode("append").parquet(source)
        stream = log.windowed_counts(log.read_stream(spark, source), "1 hour", "2 hours")
        log.run_once(stream, lambda batch, number: seen.extend((r["start"].hour, r["events"]) for r in batch.collect()), checkpoint, "append")
    assert sorted(seen) == [(0, 1), (10, 1)]  # 1 o'clock was late; 20 o'clock is still open


def test_collected_stream_is_a_table(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    got = log.collected(spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")))
    assert got.count() == 5 and got.columns == ["id", "batch"]


def test_numbered_is_a_total_order(spark):
    df = spark.createDataFrame([(random.Random(i).randrange(50), i) for i in range(500)] + [(None, 500)], "v int, id int").repartition(7)
    rows = sorted(reading.numbered(df, ["v", "id"]).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(1, 502))
    assert [(r["v"], r["id"]) for r in rows] == sorted(((r["v"], r["id"]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert reading.numbered(df.limit(0), ["v"]).count() == 0


def test_refusals_first_ids_and_statements(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "posting_id string")
    got = {tuple(r) for r in reading.refusals(ids("a", "b", "b", "z", None), ids("a", "b"), ids("b")).collect()}
    assert got == {("b", "held out"), ("z", "unknown"), (None, "unknown")}
    assert [r[0] for r in reading.first_ids(ids("c", "a", "b"), "posting_id", 2).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        reading.first_ids(ids("a"), "posting_id", 0)
    with pytest.raises(ValueError):
        reading.sql_rows("DROP TABLE x", {}, x=ids("a"))


def test_empty_snapshot_is_an_error(spark):
    df = spark.createDataFrame([("s1", "b"), ("s1", "a")], "snapshot_id string, posting_id string")
    assert [r["posting_id"] for r in snapshots.snapshot_rows(df, "s1", "posting_id").collect()] == ["a", "b"]
    for missing in ("s2", None):
        with pytest.raises(snapshots.EmptySnapshot):
            snapshots.snapshot_rows(df, missing, "posting_id")


def test_merges_are_checked(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, x string"), spark.createDataFrame([(1, 5)], "k int, y int")
    assert sorted(tuple(r) for r in combine.checked_merge(left, right, ["k"]).collect()) == [(1, "a", 5), (2, "b", None), (2, "c", None)]
    with pytest.raises(CheckFailed):
        combine.checked_merge(right, left, ["k"])
    with pytest.raises(CheckFailed):
        combine.checked_merge(left, right.withColumn("x", F.lit(1)), ["k"])
    both = combine.concat_distinct([spark.createDataFrame([(1, "first")], "k int, x string"), left], ["k"])
    assert sorted(tuple(r) for r in both.collect()) == [(1, "first"), (2, "b")]
