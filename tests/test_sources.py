import datetime as dt
import hashlib
import json
import os
import stat

import pytest

from fluxpanel.sources import files
from fluxpanel.streaming.daily import daily_totals


def test_csv_is_typed_and_a_wrong_header_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,day,v\n1,20240102,5\n2,20240103,\n")
    kind = "id int, day date, v long"
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), kind).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, dt.date(2024, 1, 2), 5), (2, dt.date(2024, 1, 3), None)]
    assert files.read_csv(spark, str(tmp_path / "a.csv"), kind, ["v"]).columns == ["v"]
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "a.csv"), "id int, other date, v long").collect()
    (tmp_path / "b.csv").write_text("20240102,5,6\n")
    assert files.read_csv(spark, str(tmp_path / "b.csv"), "day string, p string, r string", header=False).first()[0] == "20240102"


def test_parquet_pushes_the_range_down(spark, tmp_path):
    path = str(tmp_path / "p")
    files.write_parquet(spark.range(1000).selectExpr("id", "id % 7 as k", "cast(id as string) as s"), path, sort=["id"], range_by="id")
    df = files.read_parquet(spark, path, ["k"], ("id", 10, 20))
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThanOrEqual(id,10), LessThanOrEqual(id,20)]" in plan and "s:string" not in plan.split("ReadSchema")[1].splitlines()[0]
    assert df.count() == 11
    with pytest.raises(Exception):
        files.write_parquet(spark.range(1), path)
    described = files.describe_parquet(spark, path).collect()
    assert sum(r.rows for r in described) == 1000
    assert all(r.row_groups >= 1 and r.least_rows <= r.most_rows <= r.rows and r.compression == "ZSTD" for r in described)


def test_small_csv_with_mark(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä"), (2, None)], "a int, b string")
    files.write_small_csv(df, str(tmp_path / "x.csv"), bom=True)
    assert (tmp_path / "x.csv").read_bytes().startswith(b"\xef\xbb\xbfa,b")
    files.write_small_csv(df.select("a"), str(tmp_path / "y.csv"), header=False, encoding="ascii")
    assert (tmp_path / "y.csv").read_text() == "1\n2\n"
    with pytest.raises(ValueError):
        files.write_small_csv(df, str(tmp_path / "z.csv"), most=1)


def test_hashes_and_inventory(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, t in (("a", "1"), ("b", "2"), ("c", "3")):
        (tmp_path / "in" / n).write_text(t)
    found = files.file_hashes(spark, str(tmp_path / "in"))
    h = {r.file: r.sha256 for r in found.collect()}
    assert h["a"] == hashlib.sha256(b"1").hexdigest() == files.sha256(tmp_path / "in" / "a")
    (tmp_path / "list").write_text(f"{h['a']}  a\nnot a line\n{h['b'].upper()} *b\n")
    listed = files.read_hashes(spark, str(tmp_path / "list"))
    assert files.same_hashes(listed, found.where("file <> 'c'").select("file", "sha256"))
    expected = spark.createDataFrame([("a", 1, h["a"]), ("b", 1, "0" * 64), ("d", 1, h["c"])], "file string, bytes long, sha256 string")
    assert {r.file: r.status for r in files.verify_inventory(expected, found).collect()} == {"a": "PASS", "b": "changed", "c": "extra", "d": "missing"}


def test_snapshot_publish_manifest_and_seal(tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a").write_text("1")
    good = {"a": files.sha256(tmp_path / "raw" / "a")}
    assert files.snapshot(tmp_path / "raw", tmp_path / "snap", good) == good
    assert files.snapshot(tmp_path / "raw", tmp_path / "snap", good) == good
    with pytest.raises(ValueError):
        files.snapshot(tmp_path / "raw", tmp_path / "other", {"a": "0" * 64})
    with pytest.raises(RuntimeError), files.publish(tmp_path / "new"):
        raise RuntimeError
    assert sorted(os.listdir(tmp_path)) == ["raw", "snap"]
    with pytest.raises(FileExistsError), files.publish(tmp_path / "snap"):
        pass
    made = files.write_manifest(tmp_path / "snap", {"rows": 1})
    assert made["files"]["a"]["sha256"] == good["a"] and json.loads((tmp_path / "snap" / "manifest.json").read_text())["rows"] == 1
    files.seal([tmp_path / "snap" / "a"])
    assert not os.stat(tmp_path / "snap" / "a").st_mode & stat.S_IWUSR
    assert files.scaffold(tmp_path, "v002_trial").is_dir()
    with pytest.raises(ValueError):
        files.scaffold(tmp_path, "x1")


def test_windows_records_markdown_and_model(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"windows": [{"id": "a", "start": "2024-01-01", "end": "2024-01-30"}]}))
    assert files.read_windows(spark, str(tmp_path / "w.json")).first().end == dt.date(2024, 1, 30)
    (tmp_path / "bad.json").write_text(json.dumps({"windows": [{"id": "a", "start": "2024-02-01", "end": "2024-01-30"}]}))
    with pytest.raises(ValueError):
        files.read_windows(spark, str(tmp_path / "bad.json"))
    df = spark.createDataFrame([(dt.date(2024, 1, 1), float("nan"), 1234.5)], "d date, x double, y double")
    assert files.json_records(df).first().record == '{"d":"2024-01-01","x":null,"y":1234.5}'
    assert files.markdown_table(df, ["d", "y"], 1, {"y": "Y"}) == "| d | Y |\n| --- | --- |\n| 2024-01-01 | 1,234.5 |\n"
    files.save_model(spark, {"a": [1.5]}, str(tmp_path / "m"))
    assert files.load_model(spark, str(tmp_path / "m")) == {"a": [1.5]}
    assert files.timed_reads({"r": lambda: spark.range(5)})[0]["trials"] == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + i % 5, i % 24), "ab"[i % 2], i / 10) for i in range(200)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.day.day, r.event_type): (r.events, r.cents) for r in daily_totals(spark, str(tmp_path / "events.parquet"), str(tmp_path / "scratch")).collect()}
    want = {}
    for ts, kind, v in rows:
        n, c = want.get((ts.day, kind), (0, 0))
        want[ts.day, kind] = (n + 1, c + int(v * 100 + 0.5))
    assert got == want


def test_markdown_table_refuses_what_it_would_cut(spark):
    df = spark.range(3)
    assert files.markdown_table(df, most=3).count("\n") == 5
    with pytest.raises(ValueError):
        files.markdown_table(df, most=2)
