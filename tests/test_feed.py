"""Feeds: cursors, pushed filters, and writes that are repeated."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.sources import feed

DDL = "record_id string, tenant_id string, source string, timestamp string, user_id string, n bigint"


def rows(first, last, source="ga4"):
    return [(f"r{i:03}", f"t{i % 2}", source, f"2024-01-{i // 10 + 1:02}T{i % 10:02}:00:00", None if i % 7 == 0 else f"u{i % 5}", i) for i in range(first, last)]


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/feed"


def ids(df):
    return sorted(r["record_id"] for r in df.collect())


def test_what_is_written_is_read(spark, path):
    d = spark.createDataFrame([*rows(0, 40), *rows(40, 60, "hubspot"), ("odd", None, None, None, "é \n\"x\"", None)], DDL).repartition(3)
    feed.write_feed(d, path, run="one")
    got = feed.read_feed(spark, path, DDL)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, d.collect()), key=str)
    assert {f.channel for f in feed.files(path)} == {"ga4", "hubspot", "unknown"}
    assert got.rdd.getNumPartitions() == len(feed.files(path))  # one a file


def test_filters_reach_the_files(spark, path):
    d = spark.createDataFrame([*rows(0, 40), *rows(40, 80, "hubspot")], DDL)
    for i, part in enumerate(("n < 20", "n >= 20")):
        feed.write_feed(d.where(part), path, run="one", batch=str(i))
    got = lambda where: feed.read_feed(spark, path, DDL, where)
    late = got((F.col("source") == "ga4") & (F.col("timestamp") >= "2024-01-03T05:00:00"))
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan
    assert late.rdd.getNumPartitions() < len(feed.files(path))  # files before the cursor and of other channels aren't opened
    assert ids(late) == [f"r{i:03}" for i in range(25, 40)]
    assert ids(late.where("n < 30 and source = 'ga4'")) == [f"r{i:03}" for i in range(25, 30)] and late.count() == 15
    assert ids(got("timestamp > '2024-01-03T05:00:00' and timestamp <= '2024-01-03T07:00:00'")) == ["r026", "r027"]
    assert ids(got("user_id is not null and n in (7, 8, 77)")) == ["r008"]
    assert ids(got("user_id is null and n < 10")) == ["r000", "r007"]
    whole = got(None)
    assert whole.where("n < 5").unionByName(whole.where("n > 75")).count() == 9 and whole.count() == 80


def test_fetch(spark, path):
    feed.write_feed(spark.createDataFrame(rows(0, 30), DDL), path, run="one")
    assert ids(feed.fetch(spark, path, "t1")) == [f"r{i:03}" for i in range(1, 30, 2)]
    assert ids(feed.fetch(spark, path, "t1", since="2024-01-02T01:00:00")) == [f"r{i:03}" for i in range(11, 30, 2)]


def test_a_second_pass_gives_later_rows_only(spark, path, tmp_path):
    def run(number):
        d = feed.read_increments(spark, path, DDL, cursor="ga4/main").withColumn("pass", F.lit(number))
        feed.record_stream(d, f"file://{tmp_path}/out", "copy", f"file://{tmp_path}/state").awaitTermination()
        return feed.read_feed(spark, f"file://{tmp_path}/out", DDL + ", pass int")

    feed.write_feed(spark.createDataFrame(rows(0, 20), DDL), path, run="one", batch="0")
    assert ids(run(1)) == [f"r{i:03}" for i in range(20)]
    feed.write_feed(spark.createDataFrame([*rows(20, 33), *rows(50, 53, "hubspot")], DDL), path, run="one", batch="1")
    both = run(2)
    assert ids(both.where("pass = 1")) == [f"r{i:03}" for i in range(20)]
    assert ids(both.where("pass = 2")) == [f"r{i:03}" for i in [*range(20, 33), *range(50, 53)]]
    assert run(3).count() == both.count() == 36  # nothing came
    cursor = json.load(open(f"{tmp_path}/feed/_cursors/ga4-main.json"))
    assert json.loads(cursor["value"]) == {"ga4": ["2024-01-02T09:00:00", "r019"]}  # what Spark has declared done: a batch less


def test_a_stream_begins_at_since_and_keeps_ties(spark, path, tmp_path):
    d = [("a", "t", "s", "2024-01-01", None, 1), ("b", "t", "s", "2024-01-02", None, 2), ("c", "t", "s", "2024-01-02", None, 3), ("z", "t", "s", "2024-01-02", None, 4)]
    feed.write_feed(spark.createDataFrame(d[:3], DDL), path, run="one", batch="0")
    go = lambda: feed.record_stream(feed.read_increments(spark, path, DDL, since="2024-01-02"), f"file://{tmp_path}/out", "copy", f"file://{tmp_path}/state").awaitTermination()
    go()
    assert ids(feed.read_feed(spark, f"file://{tmp_path}/out", DDL)) == ["b", "c"]
    feed.write_feed(spark.createDataFrame(d[3:], DDL), path, run="one", batch="1")  # at the same time, behind by its key
    go()
    assert ids(feed.read_feed(spark, f"file://{tmp_path}/out", DDL)) == ["b", "c", "z"]


def test_a_repeated_batch_adds_nothing(spark, path):
    d = spark.createDataFrame(rows(0, 20), DDL).repartition(2)
    for _ in range(3):
        feed.write_feed(d, path, run="suite", batch="7")
    assert feed.read_feed(spark, path, DDL).count() == 20
    feed.write_feed(d, path, run="suite", batch="8")
    assert feed.read_feed(spark, path, DDL).count() == 40


def test_a_killed_write_leaves_each_row_once(spark, path, tmp_path):
    """Tasks that wrote without a commit, a task that ran twice, and then the whole write again."""
    layout = feed.Layout(path, "source", "timestamp", "record_id")
    names = [c.split()[0] for c in DDL.split(", ")]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows(0, 12)])
    killed = feed.FeedWriter(layout, "suite", "0")
    killed.write(iter([batch]))  # the driver died before it could commit or abort
    feed.register(spark)
    again = feed.FeedWriter(layout, "suite", "0")
    kept, twin = again.write(iter([batch])), again.write(iter([batch]))  # speculative copies: Spark commits one
    again.commit([kept])
    again.abort([twin])
    assert feed.read_feed(spark, path, DDL).count() == 12
    feed.write_feed(spark.createDataFrame(rows(0, 12), DDL), path, run="suite", batch="0")
    assert feed.read_feed(spark, path, DDL).count() == 12


def test_a_batch_that_a_stream_repeats(spark, path, tmp_path):
    """The checkpoint is lost after the sink's commit: the same batch comes again."""
    feed.write_feed(spark.createDataFrame(rows(0, 20), DDL), path, run="one")
    for state in ("a", "b"):
        feed.record_stream(feed.read_increments(spark, path, DDL), f"file://{tmp_path}/out", "copy", f"file://{tmp_path}/{state}").awaitTermination()
    assert feed.read_feed(spark, f"file://{tmp_path}/out", DDL).count() == 20


def test_folders_without_a_log(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        feed.files(f"{tmp_path}/nowhere")
    with pytest.raises(ValueError, match="no records"):
        feed.files(str(tmp_path))
    (tmp_path / "reddit").mkdir()
    (tmp_path / "reddit" / "x.jsonl").write_text('\n{"record_id": "1", "source": "reddit", "n": 3}\n\n{"record_id": "2"}')
    got = feed.read_feed(spark, str(tmp_path), DDL)
    assert ids(got) == ["1", "2"] and ids(feed.read_feed(spark, str(tmp_path), DDL, "source = 'reddit'")) == ["1"] and feed.files(str(tmp_path))[0].channel == "reddit"


def test_rows_pass_as_lines(spark, path):
    """Spark writes and reads the JSON, every type of it; the source moves lines."""
    d = spark.sql("""select 'r' || id as record_id, 's' as source, '2024-01-01' as timestamp, timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id / 1e6) as at,
      map('k', cast(id as string), 'none', null, 'é "\\n', '') as payload, array('a', null) as items, if(id = 3, double('nan'), id / 7) as x from range(5)""")
    feed.write_feed(d, path, run="one")
    got = feed.read_feed(spark, path, d.schema)
    assert "from_json" in got._jdf.queryExecution().optimizedPlan().toString()
    text = lambda df: sorted(str(r.asDict()) for r in df.collect())
    assert text(got) == text(d)
    by_filter = feed.read_feed(spark, path, d.schema["record_id"].name + " string, payload map<string,string>, x double", "record_id in ('r3', 'r4')")
    assert text(by_filter) == text(d.select("record_id", "payload", "x").where("record_id in ('r3', 'r4')"))


def test_lines_and_rows_are_entered_alike(tmp_path):
    """Whole columns give the positions and files that single rows gave."""
    layout = feed.Layout(f"{tmp_path}/feed", "source", "timestamp", "record_id")
    data = [dict(source=s, timestamp=t, record_id=k) for s, t, k in [("a", "2", "x"), ("a", None, "z"), ("A", "1", None), ("a", None, "y"), ("a", "2", "w"), (None, None, "q")]]
    batch = pa.RecordBatch.from_pylist(data)
    lines = pa.RecordBatch.from_arrays([batch["source"], batch["timestamp"], batch["record_id"], pa.array([json.dumps(r) for r in data])], ["channel", "at", "key", "line"])
    for by_lines, b in ((False, batch), (True, lines)):
        entries = feed.FeedWriter(layout, "suite", "0", by_lines).write(iter([b.slice(0, 2), b.slice(2)])).entries
        got = {e["channel"]: (e["rows"], e["low"], e["high"]) for e in entries}
        # "a" and "A" share a folder, but no file
        assert got == {"a": (4, [None, "y"], ["2", "x"]), "A": (1, ["1", ""], ["1", ""]), "unknown": (1, [None, "q"], [None, "q"])}
        for e in entries:
            assert len(open(f"{tmp_path}/feed/{e['file']}").read().splitlines()) == e["rows"]


def test_whole_files_of_a_stream_are_not_looked_into(spark, path):
    for i in (0, 1):
        feed.write_feed(spark.createDataFrame(rows(10 * i, 10 * i + 10), DDL).coalesce(1), path, run="one", batch=str(i))
    reader = feed.FeedStreamReader(feed.Layout(path, "source", "timestamp", "record_id"), feed.RECORD, None, None, True)
    end = reader.latestOffset()
    assert [(p.after, p.until) for p in reader.partitions({}, end)] == [(None, None)] * 2
    low, middle = ("2024-01-01T09:00:00", "r009"), ("2024-01-02T03:00:00", "r013")
    assert [(p.after, p.until) for p in reader.partitions({"ga4": list(low)}, end)] == [(None, None)]
    assert sorted((p.after, p.until) for p in reader.partitions({"ga4": list(middle)}, end)) == [(middle, None)]
