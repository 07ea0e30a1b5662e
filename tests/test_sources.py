import json
import zipfile
from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from lodestrata import schemas
from lodestrata.operators.checks import CheckFailed
from lodestrata.sinks import files as out
from lodestrata.sinks import publish
from lodestrata.sources import archives, boards, files
from lodestrata.sources.files import SourceError
from lodestrata.streaming import events as log


def test_jobs_and_bad_payloads(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"jobs": [{"id": 1, "title": "x", "location": {"name": "Rome"}}, {"id": 2}], "meta": {"total": 2}}))
    (tmp_path / "b.json").write_text("[1]")
    (tmp_path / "c.json").write_text('{"meta": {}}')
    rows = files.read_jobs(spark, [str(tmp_path / "a.json")]).select("job.id", "job.location.name").collect()
    assert [tuple(r) for r in rows] == [(1, "Rome"), (2, None)]
    bad = [r[0].rsplit("/", 1)[1] for r in files.bad_payloads(spark, [str(p) for p in tmp_path.iterdir()]).collect()]
    assert sorted(bad) == ["b.json", "c.json"]


def test_strict_jsonl(spark, tmp_path):
    schema = schemas.strings("a", "b")
    good = tmp_path / "g.jsonl"
    good.write_text('{"a": "1", "b": null}\n{"b": "x", "a": "é"}\n')
    assert files.read_jsonl(spark, str(good), schema).count() == 2
    for text in ('{"a": "1"}\n', '{"a": "1", "b": "2", "c": "3"}\n', "{\n", '{"a": "1", "b": "2"}\n\n{"a": "1", "b": "2"}\n'):
        good.with_name("bad.jsonl").write_text(text)
        with pytest.raises(SourceError):
            files.read_jsonl(spark, str(good.with_name("bad.jsonl")), schema)
    assert files.or_empty(spark, f"file://{tmp_path}/none", schema).count() == 0


def test_strict_csv(spark, tmp_path):
    schema, path = schemas.strings("a", "b"), tmp_path / "x.csv"
    path.write_text('a,b\n1,"two\nlines"\n"say ""hi""",\n')
    assert [tuple(r) for r in files.read_csv(spark, str(path), schema).collect()] == [("1", "two\nlines"), ('say "hi"', "")]
    path.write_text("a,c\n1,2\n")
    with pytest.raises(SourceError):
        files.read_csv(spark, str(path), schema)
    path = tmp_path / "y.csv"
    path.write_text("a,b\n1\n2,3\n")
    with pytest.raises(SourceError):
        files.read_csv(spark, str(path), schema)
    assert [tuple(r) for r in files.read_csv(spark, str(path), schema, ragged=True).collect()] == [("1", ""), ("2", "3")]
    assert files.profile_csv(spark, str(path)) == (["a", "b"], 2)


def test_hashes_and_newest_verified(spark, tmp_path):
    (tmp_path / "1.json").write_text("one")
    (tmp_path / "2.json").write_text("two")
    found = files.file_hashes(spark, str(tmp_path))
    by = {r["path"].rsplit("/", 1)[1]: r for r in found.collect()}
    row = lambda s, name, sha=None, status="200": (s, "acme", by[name]["path"], "t", status, "1", sha or by[name]["sha256"], str(by[name]["bytes"]))
    manifest = spark.createDataFrame([row("s1", "1.json"), row("s2", "2.json", "0" * 64), row("s3", "1.json", status="500")], schemas.RAW_MANIFEST)
    assert files.newest_verified(manifest, found).first()["snapshot_id"] == "s1"
    problems = files.verify_files(found, manifest.select(F.col("file_path").alias("path"), "bytes", "sha256").unionByName(spark.createDataFrame([("gone", "1", "x")], "path string, bytes string, sha256 string")))
    assert sorted(r["problem"] for r in problems.collect()) == ["hash differs", "missing"]


def test_boards():
    assert boards.parse_boards("boards:\n- {token: a-1, company_name: A, industry: X, industry_source: s}")[0].industry == "X"
    for bad in ("boards: []", "x: 1", "boards:\n- {token: a}", "boards:\n- {token: 'a b', company_name: A}", "boards:\n- {token: a, company_name: A}\n- {token: A, company_name: B}", "boards:\n- {token: a, company_name: A, industry: X}", "boards:\n- {token: a, company_name: A, extra: 1}"):
        with pytest.raises(SourceError):
            boards.parse_boards(bad)


def test_fetch_retries_within_its_budget():
    now, waits = datetime(2025, 1, 1, tzinfo=UTC), []
    answers = iter([(503, b"", {"Retry-After": "2"}), (429, b"", {}), (200, b'{"jobs": [1]}', {})])
    body, status = boards.fetch("u", get=lambda u, t: next(answers), sleep=waits.append, now=lambda: now)
    assert status == 200 and boards.payload_jobs(body) == 1 and waits[0] == 2 and len(waits) == 2
    with pytest.raises(SourceError):
        boards.fetch("u", get=lambda u, t: (503, b"", {"Retry-After": "100"}), sleep=waits.append, now=lambda: now)
    assert boards.fetch("u", get=lambda u, t: (404, b"no", {}))[1] == 404

    def broken(u, t):
        raise OSError("down")

    with pytest.raises(SourceError):
        boards.fetch("u", get=broken, sleep=lambda s: None, retries=1)
    assert boards.retry_after("Wed, 01 Jan 2025 00:00:09 GMT", now) == 9 and boards.retry_after("-5", now) == 0 and boards.retry_after("soon", now) is None
    for bad in (b"{", b"[]", b'{"jobs": 1}'):
        with pytest.raises(SourceError):
            boards.payload_jobs(bad)


def test_fetch_plan(spark):
    b = boards.board_table(spark, boards.parse_boards("boards:\n- {token: a, company_name: A}\n- {token: b, company_name: B}"))
    known = spark.createDataFrame([("a",)], "board_token string")
    assert {r[0]: r[1] for r in boards.fetch_plan(b, known).collect()} == {"a": "would_use_cache", "b": "would_fetch"}


def test_archives(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("x.csv", "a\n1\n")
        z.writestr("sub/y.csv", "b\n")
    rows = archives.unpack(path, tmp_path / "out-1")
    assert [r[0] for r in rows] == ["x.csv", "sub/y.csv"] and rows[0][2] == archives.sha256_file(tmp_path / "out-1" / "x.csv")
    assert archives.unpack(path, tmp_path / "out-1") == rows
    (tmp_path / "out-1" / "x.csv").write_text("changed")
    with pytest.raises(SourceError):
        archives.unpack(path, tmp_path / "out-1")
    for name in ("../x", "/x", "c:x"):
        with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
            z.writestr(name, "x")
        with pytest.raises(SourceError):
            archives.unpack(tmp_path / "b.zip", tmp_path / "o")
    assert archives.only_folder(tmp_path, "out-").name == "out-1" and archives.required_files(tmp_path, ["a.zip"])
    with pytest.raises(SourceError):
        archives.required_files(tmp_path, ["none"])
    with pytest.raises(SourceError):
        archives.acquired("2025-02-01", date(2025, 1, 1))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a|b", ["x", "é"], True, None)], "s string, l array<string>, f boolean, n string")
    df = df.coalesce(1)
    out.write_csv(df, str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("*.csv")).read_text() == 's,l,f,n\na|b,"[""x"",""é""]",true,\n'
    out.write_jsonl(df, str(tmp_path / "json"), ["n", "s"])
    assert next((tmp_path / "json").glob("*.json")).read_text() == '{"n":null,"s":"a|b"}\n'
    assert "a\\|b" in out.quality_report({"One": df}, "Report") and out.csv_text(df).startswith("s,l,f,n")
    out.write_file(tmp_path / "r.md", "x")
    out.write_file(tmp_path / "r.md", "y")
    assert (tmp_path / "r.md").read_text() == "y" and len(list(tmp_path.glob("tmp*"))) == 0
    publish.snapshot(df, f"file://{tmp_path}/snap", "s1")
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        publish.snapshot(df, f"file://{tmp_path}/snap", "s1")
    publish.replace(df, f"file://{tmp_path}/t")
    publish.replace(df.limit(0), f"file://{tmp_path}/t")
    assert spark.read.schema(df.schema).parquet(f"file://{tmp_path}/t").count() == 0
    rows = spark.createDataFrame([("f", "h1")], "name string, sha256 string")
    path = f"file://{tmp_path}/manifest"
    assert [publish.append_manifest(rows, path, ["name"], "sha256") for _ in range(2)] == [1, 0]
    with pytest.raises(CheckFailed):
        publish.append_manifest(spark.createDataFrame([("f", "h2")], rows.schema), path, ["name"], "sha256")


def test_streams_equal_batches(spark, tmp_path):
    at = datetime(2025, 1, 1)
    rows = [(i, at.replace(hour=i % 3, minute=i % 50), i % 4, "ab"[i % 2], float(i), None) for i in range(60)]
    df = spark.createDataFrame(rows, schemas.EVENTS)
    for k in range(3):
        df.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    held, windows = {}, {}
    log.run_once(log.running_versions(log.read_stream(spark, str(tmp_path / "in"), 1)), lambda b, n: held.update({r[0]: (r[1], r[2]) for r in b.collect()}), str(tmp_path / "c1"), "update")
    assert held == {u: (15, float(sum(i for i in range(60) if i % 4 == u))) for u in range(4)}
    log.run_once(log.windowed_counts(log.read_stream(spark, str(tmp_path / "in")), "1 hour", "1 day"), lambda b, n: windows.update({(r[0].hour, r[1]): r[2] for r in b.collect()}), str(tmp_path / "c2"), "update")
    assert sum(windows.values()) == 60 and windows[(0, "a")] == 10
    seen = []
    once = log.deduplicated(log.read_stream(spark, str(tmp_path / "in")).withColumn("r", F.col("event_id") % 7), "r", "1 day")
    log.run_once(once, lambda b, n: seen.extend(r["r"] for r in b.collect()), str(tmp_path / "c3"))
    assert sorted(seen) == list(range(7))
    again = []
    log.run_once(once, lambda b, n: again.extend(b.collect()), str(tmp_path / "c3"))
    assert again == []


def test_event_rules(spark):
    df = spark.createDataFrame([(1, "a", "r1", "open"), (2, "a", "r1", "close"), (3, "a", None, "close"), (4, "b", None, "close"), (5, "b", "r2", "edit")], "n int, scope string, request string, kind string")
    assert sorted(r["n"] for r in log.once(df, "request", "n").collect()) == [1, 3, 4, 5]
    assert {r[0]: r[1] for r in log.open_after(df, "scope", "n", "kind", "close").collect()} == {"a": True, "b": False}
    assert [r["version"] for r in log.versions(df, "scope", ["n"]).orderBy("n").collect()] == [1, 2, 3, 1, 2]
