"""Archives against a plain reader and a plain grouping of pages."""

import base64
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import warc

DDL = "page_id long, url string, html string, payload int, top string, copies string, record_type string"


def plain_records(data: bytes):
    """(header lines, block) of each record of an inflated archive."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        n = int(head["Content-Length"])
        out.append((head, data[end + 4 : end + 4 + n]))
        assert data[end + 4 + n : end + 8 + n] == b"\r\n\r\n"
        at = end + 8 + n
    return out


def plain_report(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of each row, sorted."""
    groups, out = {}, []
    for page, url, html in rows:
        groups.setdefault((html or "").encode(), []).append((page, url))
    for payload, own in groups.items():
        facts = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        top = own.pop()
        out.append((top[0], *facts, "response", None))
        out += [(p, *facts, "revisit", top[0]) if len(payload) >= least else (p, *facts, "response", None) for p, _ in own]
    return sorted(out, key=str)


def reported(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


def odd_pages():
    r = random.Random(1)
    rows = [(i, f"http://x/{i}", r.choice(["<p>same</p>", None, "", "é漢", "x" * 50, str(i)])) for i in range(60)]
    rows += [(7, "http://x/other", "<p>same</p>"), (7, "http://x/7", "own"), (None, "http://none", "<p>same</p>"), (None, None, "no id at all"), (None, None, "no id at all")]
    rows += [(500, "http://tie", "<p>alike</p>")] * 3 + [(499, "http://tie", "<p>alike</p>")] * 2 + [(-4, None, "\r\n\r\nWARC/1.1\r\n\r\n"), (61, "http://in\r\nWARC-Type: x\r\n\r\n", "odd url"), (62, "http://long", "<b>" * 400_000)]
    return rows


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*x, 1, "t", "c", "r") for x in odd_pages()], DDL).repartition(4)


@pytest.mark.parametrize("least", [0, 5])
def test_report_of_odd_rows(pages, least):
    assert reported(warc.archive_report(pages, least)) == plain_report(odd_pages(), least)


def test_report_of_none(spark):
    got = warc.archive_report(spark.createDataFrame([], DDL))
    assert got.count() == 0 and "refers_to" in got.columns


def test_files_are_archives_that_others_can_read(spark, pages, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archives(pages, path)
    assert len(warc.archive_files(path)) > 1
    found = [x for f, _ in warc.archive_files(path) for x in plain_records(gzip.open(f).read())]
    assert len(found) == len(odd_pages()) and len({h["WARC-Record-ID"] for h, _ in found}) == len(found)
    bodies = {h["WARC-Record-ID"]: b.split(b"\r\n\r\n", 1)[1] for h, b in found if h["WARC-Type"] == "response"}
    assert sorted(bodies.values()) == sorted({(t or "").encode() for _, _, t in odd_pages()})
    for h, b in found:
        assert h["WARC-Type"] in ("response", "revisit")
        body = bodies[h["WARC-Refers-To"]] if h["WARC-Type"] == "revisit" else bodies[h["WARC-Record-ID"]]
        assert h["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert f"Content-Length: {len(body)}\r\n".encode() in b


def test_filters_reach_the_scan(spark, pages, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archives(pages, path)
    d = warc.read_archives(spark, path)
    revisits = warc.read_archives(spark, path, where="record_type = 'revisit' and target_uri like 'http://x/%'")
    plan = revisits._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan  # both are the reader's
    want = [r for r in d.collect() if r["record_type"] == "revisit" and (r["target_uri"] or "").startswith("http://x/")]
    assert sorted(r["record_id"] for r in revisits.collect()) == sorted(r["record_id"] for r in want) and want
    one = want[0]
    both = F.col("target_uri").isin(one["target_uri"], "nowhere") & (F.col("payload_digest") == one["payload_digest"])
    assert warc.read_archives(spark, path, where=both).count() >= 1
    assert revisits.where("http_length >= 0").count() == len(want) and d.count() == len(odd_pages())
    assert warc.read_archives(spark, path, where="target_uri is null and http_length > 0").count() == len([u for _, u, t in odd_pages() if u is None and t])
    assert "payload" not in warc.read_archives(spark, path, payload=False).columns


def test_unwanted_payloads_are_not_inflated():
    r = random.Random(2)
    rows = [{"record_id": f"urn:{i}", "record_type": "response", "target_uri": "u", "payload_digest": None, "refers_to": None, "http_length": 100_000, "payload": bytes(r.choices(b"abcdef", k=100_000))} for i in range(20)]
    data = b"".join(warc.gzip_member(warc.record_bytes(x, "d")) for x in rows)
    seen, one = {}, {}
    assert len(list(warc.read_records(io.BytesIO(data), seen=seen))) == 20
    got = list(warc.read_records(io.BytesIO(data), lambda value: value("record_id") == "urn:13", seen=one))
    assert [x["payload"] for x in got] == [rows[13]["payload"]]
    assert one["records"] == 20 and one["passed"] == 19 and one["inflated"] < seen["inflated"] / 8


@pytest.mark.parametrize("form", ["plain", "members", "whole"])
def test_foreign_archives(form):
    rows = [{"record_id": f"urn:{i}", "record_type": t, "target_uri": None, "payload_digest": None, "refers_to": "urn:0", "http_length": n, "payload": b"p" * n} for i, (t, n) in enumerate([("response", 70_000), ("revisit", 5), ("response", 0), ("response", 3)])]
    parts = [warc.record_bytes(x, "d") for x in rows]
    parts.insert(1, b"WARC/1.0\r\nWARC-Type: warcinfo\r\nX-Long: a\r\n b\r\nContent-Length: 4\r\n\r\nk: v\r\n\r\n")
    data = {"plain": b"".join(parts), "members": b"".join(map(gzip.compress, parts)), "whole": gzip.compress(b"".join(parts))}[form]
    got = list(warc.read_records(io.BytesIO(data)))
    assert [x["record_type"] for x in got] == ["response", "warcinfo", "revisit", "response", "response"]
    assert [x["payload"] for x in got] == [b"p" * 70_000, b"k: v", None, b"", b"ppp"] and got[1]["headers"]["x-long"] == "a b"
    some = list(warc.read_records(io.BytesIO(data), lambda value: value("record_type") == "response", payload=False))
    assert [(x["http_length"], x["payload"]) for x in some] == [(70_000, None), (0, None), (3, None)]
    with pytest.raises((EOFError, ValueError)):
        list(warc.read_records(io.BytesIO(data[:-40])))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(b"no archive\r\n\r\n")))


def test_only_committed_files_are_read(tmp_path):
    """A task that ran twice, one that was lost, and a job that failed."""
    import pyarrow as pa

    row = {"record_id": "urn:1", "record_type": "response", "target_uri": "u", "payload_digest": "d", "refers_to": None, "http_length": 1, "payload": b"x"}
    batch = pa.RecordBatch.from_pylist([row] * 5, warc.arrow_schema(list(warc.WRITTEN)))
    path = str(tmp_path / "a")
    writer = warc.WarcWriter(path, "d", False, 400)
    first, twice, lost = (writer.write(iter([batch])) for _ in range(3))
    assert len(first.names) > 1  # files of a bounded size
    writer.commit([first, None])
    assert len(warc.archive_files(path)) == len(first.names)
    writer.abort([lost])
    assert not any((tmp_path / "a" / n).exists() for n in lost.names) and (tmp_path / "a" / twice.names[0]).exists()
    again = warc.WarcWriter(path, "d", True, 1 << 20)
    again.commit([again.write(iter([batch]))])
    assert len(warc.archive_files(path)) == 1 and not (tmp_path / "a" / first.names[0]).exists()
