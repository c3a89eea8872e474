"""Records in and out: round trips, layouts and what is refused."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessella.operators import ingest
from tessella.sources import records

ROWS = [("r1", "t", "ga4", "2024-01-01T00:00:00", "u", ["a", "b"], ["/x"], {"k": "v"}, "1.0"), ("r2", "t", "hubspot", None, None, [], [], {}, "1.0")]


def plain(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: r["record_id"])


def test_jsonl_round_trip_and_blank_lines(spark, tmp_path):
    d = spark.createDataFrame(ROWS, records.RECORD)
    records.write_jsonl(d, str(tmp_path / "out"), "source")
    written = [os.path.join(a, f) for a, _, fs in os.walk(tmp_path / "out") for f in fs if f.endswith(".json")]
    lines = [x for p in written for x in open(p, encoding="utf-8").read().splitlines()]
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.jsonl").write_text("\n\n".join(x[:-1] + f', "source": "{json.loads(x).get("source", "s")}"' + "}" for x in lines) + "\n")
    (folder / "ignored.txt").write_text("no json")
    got = plain(records.read_jsonl(spark, str(tmp_path / "in")))
    assert [(r["record_id"], r["behaviors"], r["payload"]) for r in got] == [("r1", ["a", "b"], {"k": "v"}), ("r2", [], {})]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        records.read_jsonl(spark, str(tmp_path / "nowhere")).count()


def test_json_array_and_labels(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"record_id": "r1", "tenant_id": "t", "source": "s", "behaviors": ["x"]}, {"record_id": "r2", "tenant_id": "t", "source": "s"}]))
    assert [r["behaviors"] for r in plain(records.read_json_array(spark, str(tmp_path / "a.json")))] == [["x"], None]
    (tmp_path / "l.csv").write_text('item,label\n1,good\n2,"bad, really"\n')
    assert [tuple(r) for r in records.read_labels(spark, str(tmp_path / "l.csv")).collect()] == [("1", "good"), ("2", "bad, really")]


def test_fetch_all_keeps_repeats(spark):
    d = spark.createDataFrame(ROWS, records.RECORD)
    assert records.fetch_all(d, d.drop("payload"), d.limit(1)).count() == 5


def test_benchmark_results(spark, tmp_path):
    one = {"tenants": {"t1": {"clusters": [{"groundedness": 0.9, "attempts": 2, "cost_usd": 0.1, "judge_score": {"overall": 4.0}}, {"failed": True, "cost_usd": 0.2}]}, "t2": {"clusters": []}}}
    (tmp_path / "run.json").write_text(json.dumps(one, indent=1))
    got = [(r["tenant_id"], r["failed"], r["groundedness"], r["judge"]) for r in records.read_results(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == [("t1", False, 0.9, 4.0), ("t1", True, None, None)]


BRONZE = "record_type string, platform string, crawl_run_id string, community_id string, community_name string, community_type string, observed_at string, seq int"


def folders(spark, rows):
    return {r["crawl_run_id"]: r["folder"] for r in records.run_folders(spark.createDataFrame(rows, BRONZE)).collect()}


def test_run_folders(spark):
    at = "2024-03-07T10:00:00Z"
    server, channel = ("community", "discord", "{}", "s1", "My Server!", "server", at, 0), ("community", "discord", "{}", "c1", "General Chat", "channel", at, 1)
    message = lambda run, c: ("message", "discord", run, c, None, None, at, 2)
    of = lambda row, run: (row[0], row[1], run, *row[3:])
    rows = [
        ("message", "reddit", "a", "r/x", None, None, at, 0), ("message", "x", "b", None, None, None, None, 0),
        of(server, "c"), of(channel, "c"), message("c", "c1"), message("c", "s1"),
        of(server, "d"), of(channel, "d"), message("d", "c1"), message("d", "c2"),
        of(server, "e"), of(channel, "e"), message("f", None),
    ]
    assert folders(spark, rows) == {
        "a": "reddit/r/x/2024-03-07", "b": "x/global/unknown-date", "c": "discord/my-server/general-chat_c1/3/7/2024", "d": "discord/my-server/multi-channel/3/7/2024",
        "e": "discord/my-server/general-chat_c1/3/7/2024", "f": "discord/discord/unknown-channel/3/7/2024",
    }


def test_runs_are_written_and_none_is_an_error(spark, tmp_path):
    d = spark.createDataFrame([("message", "reddit", "run1", "r", None, None, "2024-03-07T10:00:00Z", 0)], BRONZE)
    (path,) = records.write_runs(d, str(tmp_path))
    assert path.endswith("/reddit/r/2024-03-07/run1.jsonl") and spark.read.json(path).first()["crawl_run_id"] == "run1"
    with pytest.raises(ValueError, match="no records"):
        records.write_runs(d.where("false"), str(tmp_path))


def test_cursors(spark, tmp_path):
    root = str(tmp_path)
    assert records.load_cursor(spark, root, "discord/My Server") is None
    records.save_cursor(spark, root, "discord/My Server", "10", {"a": "b"})
    path = records.save_cursor(spark, root, "discord/My Server", "11")
    assert path.endswith("/discord__my-server.json") and records.load_cursor(spark, root, "discord/My Server") == ("11", {})
    records.save_cursor(spark, root, "other", " ")
    assert records.load_cursor(spark, root, "other") is None


def test_cursor_filters_each_source(spark):
    d = spark.createDataFrame([("a", "1"), ("a", "3"), ("b", "0")], "source string, at string")
    c = spark.createDataFrame([("a", "2")], "source string, cursor string")
    assert sorted(tuple(r) for r in ingest.since_cursor(d, c, ["source"], "at").collect()) == [("a", "3"), ("b", "0")]


def test_recorded_results_accumulate(spark, tmp_path):
    d = spark.createDataFrame([("D1", 1.0)], "dimension_id string, score double")
    records.record_results(d, str(tmp_path / "r"), "first")
    records.record_results(d, str(tmp_path / "r"), "second")
    records.record_results(d, str(tmp_path / "r"), "second")
    assert {r["suite"]: r["count"] for r in records.load_results(spark, str(tmp_path / "r")).groupBy("suite").count().collect()} == {"first": 1, "second": 2}


def test_bronze_is_checked_before_it_is_written(spark, tmp_path):
    columns = "record_type string, platform string, crawl_run_id string, tombstone_type string, target_record_type string, target_record_id string, observed_at string, reason string"
    good = ("tombstone", "p", "r", "deleted", "message", "m", "2024-01-01T00:00:00Z", "gone")
    m = records.write_bronze(spark.createDataFrame([good, good], columns), str(tmp_path / "b"))
    assert [tuple(r) for r in m.collect()] == [("tombstone", 2)] and os.listdir(tmp_path / "b") != []
    with pytest.raises(ValueError, match="reason is blank"):
        records.write_bronze(spark.createDataFrame([good, (*good[:-1], "")], columns), str(tmp_path / "c"))
    assert not (tmp_path / "c").exists()


def test_body_fallbacks(spark):
    rows = [("hi", [], []), (" ", [{"description": "d", "title": "t"}, {"description": "", "title": "t2"}], ["f"]), (None, [], ["a.png", "b.png"]), ("", None, None)]
    d = spark.createDataFrame(rows, "body string, embeds array<struct<description:string,title:string>>, files array<string>")
    got = d.select(ingest.body_or_fallback(F.col("body"), F.col("embeds"), F.col("files")).alias("x")).collect()
    assert [r["x"] for r in got] == ["hi", "d t2", "a.png b.png", None]


def test_script_shells(spark):
    rows = [('<div id="__next"></div>', 0), ("<script>" * 5 + "<p>hi</p>", 1), ("<script>" * 5 + "<p>" + "long " * 400, 1), ("<script>" * 5, 2), ("<script>" * 4, 0)]
    d = spark.createDataFrame(rows, "html string, n int")
    assert [r["x"] for r in d.select(ingest.js_shell(F.col("html"), F.col("n")).alias("x")).collect()] == [True, True, False, False, False]
