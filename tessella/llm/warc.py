"""WARC archives as a Spark data source, with deduplication by revisit records.

``spark.read.format("warc")`` plans archive files as partitions. Each record's headers are parsed
first: predicates on its type and on other headers are pushed down to the scan, and the payload of a
record that they rule out is neither decoded nor, where the archive says how long the record is,
inflated. ``df.write.format("warc")`` has each task write files of its own, named by attempt, and lists
the files of the tasks that Spark committed in a manifest when the job commits; so a task that is
lost, repeated or run twice adds no record, and a job that fails leaves nothing to read.

Records are gzip members, one each. A member's extra field holds its compressed length, which is how
a reader gets past it; archives without that field, and such that aren't compressed, are read too.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from ..sources.feed import place, pushed
from .common import discard, materialize, scratch_dir, scratch_scope

MANIFEST = "_manifest-"
#: A task begins a new file at this size, so a partition of a later read is bounded.
FILE_BYTES = 128 << 20
#: Rows of a batch that the reader hands over come to about this many bytes.
BATCH_BYTES = 4 << 20
#: Bytes that are read at a time, and inflated at a time at least.
CHUNK, STEP = 1 << 15, 1 << 12
HEADERS_LIMIT = 1 << 20

#: Columns of a read, and the header that each holds.
FIELDS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "content_type": "content-type",
}
SCHEMA = ", ".join(f"{c} string" for c in FIELDS) + ", http_length bigint, headers map<string,string>, payload binary"
#: What the writer takes; http_length is that of the full payload, which a revisit doesn't carry.
WRITTEN = ("record_id", "record_type", "target_uri", "payload_digest", "refers_to", "http_length", "payload")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# Files


def archive_files(path: str) -> list[tuple[str, int]]:
    """Files to read and their sizes: those that manifests list, or where there is none, all archives
    in the folder, or the file itself."""
    fs, base = place(path)
    info = fs.get_file_info(base)
    if info.type == pafs.FileType.File:
        return [(base, info.size)]
    found = [f for f in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if f.type == pafs.FileType.File]
    manifests = [f for f in found if f.base_name.startswith(MANIFEST)]
    listed: set[str] = set()
    for m in manifests:
        with fs.open_input_stream(m.path) as f:
            listed |= set(json.loads(f.readall()))
    keep = [f for f in found if (f.base_name in listed if manifests else re.search(r"\.warc(\.gz)?$", f.base_name))]
    return sorted((f.path, f.size) for f in keep)


# Records as bytes.


def _header(value: str) -> str:
    """A value that can't break out of its line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(row: dict, date: str) -> bytes:
    """A response, revisit or other record. A revisit has the HTTP headers, but no payload."""
    payload = row["payload"] or b""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['http_length']}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {_header(row['record_type'])}", f"WARC-Record-ID: <{_header(row['record_id'])}>", f"WARC-Date: {date}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_header(row['target_uri'])}")
    if row["payload_digest"] is not None:
        lines.append(f"WARC-Payload-Digest: sha1:{_header(row['payload_digest'])}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", "WARC-Truncated: length"]
        payload = b""
        if row["refers_to"] is not None:
            lines.append(f"WARC-Refers-To: <{_header(row['refers_to'])}>")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(head) + len(payload)}", "", ""]
    return b"".join(("\r\n".join(lines).encode(), head, payload, b"\r\n\r\n"))


def gzip_member(data: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` holds its compressed and its full length."""
    body = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = body.compress(data) + body.flush()
    total = 24 + len(packed) + 8
    skip = struct.pack("<HBBHII", 12, ord("s"), ord("l"), 8, min(total, 0xFFFFFFFF), min(len(data), 0xFFFFFFFF))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + skip + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _File:
    """A file read forward, with a look ahead and skips that seek."""

    def __init__(self, f) -> None:
        self.f, self.held, self.at = f, b"", 0

    def look(self, n: int) -> bytes:
        while len(self.held) < n and (more := self.f.read(max(CHUNK, n - len(self.held)))):
            self.held += more
        return self.held[:n]

    def take(self, n: int) -> bytes:
        out = self.look(n)
        self.held = self.held[len(out) :]
        self.at += len(out)
        return out

    def skip_to(self, at: int) -> None:
        ahead = at - self.at
        if ahead > len(self.held):
            self.f.seek(at)
            self.held = b""
        else:
            self.held = self.held[ahead:]
        self.at = at


class _Content:
    """What a gzip member holds, or a plain file from here on; ``inflated`` counts its bytes so far."""

    def __init__(self, src: _File) -> None:
        self.src, self.ready, self.end, self.inflated = src, b"", None, 0
        self.unzip = zlib.decompressobj(31) if src.look(2) == b"\x1f\x8b" else None
        if self.unzip:
            self.end = self._skip_length(src)

    @staticmethod
    def _skip_length(src: _File) -> int | None:
        """Where the member ends, if it says so."""
        fixed = src.look(12)
        if len(fixed) < 12 or not fixed[3] & 4:
            return None
        extra = src.look(12 + struct.unpack("<H", fixed[10:12])[0])[12:]
        i = 0
        while i + 4 <= len(extra):
            name, size = extra[i : i + 2], struct.unpack("<H", extra[i + 2 : i + 4])[0]
            if name == b"sl" and size == 8:
                packed, full = struct.unpack("<II", extra[i + 4 : i + 12])
                return src.at + packed if max(packed, full) < 0xFFFFFFFF else None
            i += 4 + size
        return None

    def read(self, n: int) -> bytes:
        """n bytes, fewer where the content ends."""
        if not self.unzip:
            return self.src.take(n)
        parts, have = [self.ready], len(self.ready)
        while have < n and not self.unzip.eof:
            data = self.unzip.unconsumed_tail or self.src.take(CHUNK if self.end is None else min(CHUNK, self.end - self.src.at))
            if not data:
                raise EOFError("the archive ends within a gzip member")
            parts.append(self.unzip.decompress(data, max(STEP, n - have)))
            have += len(parts[-1])
            self.inflated += len(parts[-1])
        whole = b"".join(parts)
        self.ready = whole[n:]
        return whole[:n]

    def put_back(self, data: bytes) -> None:
        if self.unzip:
            self.ready = data + self.ready
        else:
            self.src.held, self.src.at = data + self.src.held, self.src.at - len(data)

    def skip(self, n: int) -> None:
        if not self.unzip:
            self.src.skip_to(self.src.at + n)
        while self.unzip and n > 0 and (gone := len(self.read(min(n, CHUNK)))):
            n -= gone

    def leave(self) -> None:
        """On to the next member."""
        if self.end is not None:
            self.src.skip_to(self.end)
        elif self.unzip:
            while not self.unzip.eof:
                self.read(CHUNK)
                self.ready = b""
            rest = self.unzip.unused_data
            self.src.held, self.src.at = rest + self.src.held, self.src.at - len(rest)


def _fields(head: bytes) -> dict[str, str]:
    """Names in lower case; a line that begins with a blank goes on with the one before."""
    out, name = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _value(fields: dict[str, str], column: str) -> str | None:
    value = fields.get(FIELDS[column])
    if value is not None and column in ("record_id", "refers_to"):
        return value.removeprefix("<").removesuffix(">")
    return value.removeprefix("sha1:") if value is not None and column == "payload_digest" else value


def read_records(f, wanted=lambda column: True, payload: bool = True, seen: dict | None = None) -> Iterator[dict]:
    """The records of an open archive that are ``wanted`` by their header fields (given a function from
    column to value). Others are passed over by their length. ``seen`` counts records, those passed
    over, and bytes inflated."""
    src, seen = _File(f), {} if seen is None else seen
    while src.look(1):
        content = _Content(src)
        while head := _head(content):
            fields = _fields(head)
            length = int(fields.get("content-length", 0))
            seen["records"] = seen.get("records", 0) + 1
            if not wanted(lambda c: _value(fields, c)):  # noqa: B023
                seen["passed"] = seen.get("passed", 0) + 1
                if content.end is not None:
                    break  # a member of its own: its end is known
                content.skip(length + 4)
                continue
            row = {c: _value(fields, c) for c in FIELDS}
            if payload or row["record_type"] == "revisit":
                block = content.read(length)
                if len(block) < length:
                    raise EOFError("the archive ends within a record")
                content.skip(4)
            else:
                block = content.read(min(length, CHUNK))
                content.skip(length - len(block) + 4)
            yield row | _block(row, block, length, payload) | {"headers": fields}
        seen["inflated"] = seen.get("inflated", 0) + content.inflated
        content.leave()


def _head(content: _Content) -> bytes:
    """The header lines of the next record; nothing at the end."""
    head = b""
    while b"\r\n\r\n" not in (head := head.lstrip(b"\r\n")):
        more = content.read(512)
        if not more:
            if head:
                raise EOFError("the archive ends within a record's headers")
            return b""
        head += more
        if len(head) > HEADERS_LIMIT:
            raise ValueError("a record's headers don't end")
    at = head.index(b"\r\n\r\n") + 4
    content.put_back(head[at:])
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    return head[: at - 2]


def _block(row: dict, block: bytes, length: int, payload: bool) -> dict:
    """The payload behind HTTP headers, if there are any, and its full length as these say it."""
    said, skip = None, 0
    if (row["content_type"] or "").startswith("application/http") and (at := block.find(b"\r\n\r\n")) >= 0:
        skip = at + 4
        value = _fields(block[:at]).get("content-length", "")
        said = int(value) if value.isdigit() else None
    body = None if row["record_type"] == "revisit" or not payload else block[skip:]
    return {"http_length": length - skip if said is None else said, "payload": body}


# The data source.


@dataclass
class ArchivePart(InputPartition):
    path: str
    file: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, schema: StructType) -> None:
        self.path, self.payload, self.names = path, payload, schema.names
        self.tests: list[Filter] = []

    def partitions(self) -> list[ArchivePart]:
        return [ArchivePart(self.path, f) for f, _ in archive_files(self.path)]

    def wanted(self, value) -> bool:
        for x in self.tests:
            v = value(x.attribute[0])
            if v is None:
                return False
            ok = True if isinstance(x, IsNotNull) else v in x.value if isinstance(x, In) else v.startswith(x.value) if isinstance(x, StringStartsWith) else v == x.value
            if not ok:
                return False
        return True

    def read(self, partition: ArchivePart | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, ArchivePart):
            return  # no files: Spark asks once nevertheless
        schema = arrow_schema(self.names)
        fs, rows, held = place(self.path)[0], [], 0
        with fs.open_input_file(partition.file) as f:
            for row in read_records(f, self.wanted, self.payload):
                row["headers"] = list(row["headers"].items())
                rows.append(row)
                held += len(row["payload"] or b"") + 1024
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist([{c: r[c] for c in self.names} for r in rows], schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in self.names} for r in rows], schema)


class PushedWarcReader(WarcReader):
    """Spark refuses a reader that takes filters while pushing down is off, so it is one of its own."""

    def pushFilters(self, filters: list[Filter]):
        for x in filters:
            if isinstance(x, (EqualTo, In, StringStartsWith, IsNotNull)) and len(x.attribute) == 1 and x.attribute[0] in FIELDS:
                self.tests.append(x)
            else:
                yield x


def arrow_schema(names: list[str]) -> pa.Schema:
    kinds = {"http_length": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
    return pa.schema([(c, kinds.get(c, pa.string())) for c in names])


@dataclass
class FilesWritten(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, date: str, overwrite: bool, file_bytes: int) -> None:
        self.path, self.date, self.overwrite, self.file_bytes = path, date, overwrite, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> FilesWritten:
        fs, base = place(self.path)
        fs.create_dir(base, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in WRITTEN}
                    if out is None:
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{base}/{names[-1]}", compression=None), 0
                    member = gzip_member(record_bytes(row, self.date))
                    out.write(member)
                    size += len(member)
                    if size >= self.file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return FilesWritten(names)

    def commit(self, messages: list[FilesWritten | None]) -> None:
        fs, base = place(self.path)
        fs.create_dir(base, recursive=True)
        before = fs.get_file_info(pafs.FileSelector(base)) if self.overwrite else []
        names = sorted(n for m in messages if m for n in m.names)
        name = f"{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{base}/.{name}") as f:
            f.write(json.dumps(names).encode())
        fs.move(f"{base}/.{name}", f"{base}/{MANIFEST}{name}")
        for old in sorted(before, key=lambda x: not x.base_name.startswith(MANIFEST)):  # what was listed goes out of sight first
            if old.base_name not in names:
                fs.delete_file(old.path)

    def abort(self, messages: list[FilesWritten | None]) -> None:
        fs, base = place(self.path)
        for n in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{base}/{n}")


class WarcDataSource(DataSource):
    """Options: ``path``; ``payload`` (false: payloads are neither read nor a column); ``pushdown``, whether a
    reader takes filters (:func:`read_archives` sets it); ``date`` and
    ``file_bytes`` of what is written."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def _payload(self) -> bool:
        return str(self.options.get("payload", "true")).lower() != "false"

    def schema(self) -> str:
        return SCHEMA if self._payload() else SCHEMA.removesuffix(", payload binary")

    def reader(self, schema: StructType) -> WarcReader:
        pushing = str(self.options.get("pushdown", "false")).lower() == "true"
        return (PushedWarcReader if pushing else WarcReader)(self.options["path"], self._payload(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"), overwrite, int(self.options.get("file_bytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)


def read_archives(spark: SparkSession, path: str, payload: bool = True, where: Column | str | None = None) -> DataFrame:
    """The records of the archives below ``path``; those that ``where`` holds for, which reaches the reader."""
    register(spark)
    d = spark.read.format("warc").options(payload=str(payload).lower(), pushdown=str(where is not None).lower()).load(path)
    return d if where is None else pushed(d, where)


# Pages as records.


def payload_digest(payload: Column) -> Column:
    """Upper-case base 32 of the SHA-1: each 40 bits as eight digits, whose letters are then those of
    base 32."""
    sha = F.sha1(payload)
    digits = F.concat(*(F.lpad(F.conv(F.substring(sha, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: str, copy: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(F.url_encode(F.col(page_id).cast("string")), F.lit("")), F.lit(":"), copy.cast("string"))


def page_id_of(record_id: str, kind: str) -> Column:
    found = F.regexp_extract(record_id, "^urn:page:([^:]*):", 1)
    return F.when(found != "", F.url_decode(found).cast(kind))


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """A record for each row of ``pages`` (page_id, url, html), as the writer takes it.

    Of rows with equal payloads (html as UTF-8, null as empty) of ``min_bytes`` at least, that with the
    largest page_id is a response and the others are revisits of it; a row without an id has less than
    all others, of rows with one id that with the largest url is chosen, and of rows alike in all, one.
    All smaller payloads are responses. Empty and very long pages are rows like others, further
    columns aren't looked at, and an empty table gives no records.

    Only payloads that come more than once are gathered, as digests; pages themselves don't move
    unless the table of these digests is too large for Spark to broadcast. Rows that are alike in all
    and chosen are the exception: these are counted by digest.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    p = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("payload"))
    p = p.withColumns({"payload_digest": payload_digest(F.col("payload")), "http_length": F.octet_length("payload").cast("bigint")})
    group, row = ("payload_digest", "http_length"), ("page_id", "url")
    counted = p.where(F.col("http_length") >= min_bytes).groupBy(*group, *row).agg(F.count("*").alias("copies"))
    tops = counted.groupBy(*group).agg(F.sum("copies").alias("rows"), F.max(F.struct(*row, "copies")).alias("top")).where("rows > 1")
    tops = materialize(tops.select(*group, "top"), "warc-tops")
    joined = p.join(tops, list(group), "left")
    is_top = F.col("top").isNotNull() & F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("url").eqNullSafe(F.col("top.url"))
    again = is_top & (F.col("top.copies") > 1)
    revisit = F.col("top").isNotNull() & ~is_top

    def records(d: DataFrame, revisit: Column, copy: Column, refers_to: Column) -> DataFrame:
        return d.select(
            _record_id("page_id", copy).alias("record_id"),
            F.when(revisit, "revisit").otherwise("response").alias("record_type"),
            F.col("url").alias("target_uri"),
            "payload_digest",
            F.when(revisit, refers_to).alias("refers_to"),
            "http_length",
            F.when(~revisit, F.col("payload")).alias("payload"),
        )

    first = _record_id("top.page_id", F.lit(1))
    number = F.monotonically_increasing_id() + 2  # apart from the first of its id
    out = records(joined.where(~again), revisit, F.when(revisit, number).otherwise(1), first)
    if tops.where("top.copies > 1").isEmpty():
        return out
    # rows alike in all: one response, the rest revisits of it
    alike = joined.where(again).groupBy(*group, *row).agg(F.first("payload").alias("payload"), F.count("*").alias("copies"))
    dealt = alike.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.unionByName(records(dealt, F.col("copy") > 1, F.col("copy"), _record_id("page_id", F.lit(1))))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, mode: str = "append") -> None:
    register(pages.sparkSession)
    page_records(pages, min_bytes).write.format("warc").mode(mode).save(path)


def archive_report(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the archives of ``pages``, reads them back, and gives per row page_id, payload_bytes,
    payload_digest, record_type, refers_to, target_uri. Of a response, length and digest are those of
    the payload as it was read; of a revisit, those that its headers state. Odd rows as in
    :func:`page_records`."""
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    with scratch_scope():
        write_archives(pages, path, min_bytes)
    own = read_archives(spark, path, where=F.col("record_type") == "response")
    own = own.withColumns({"http_length": F.octet_length("payload").cast("bigint"), "payload_digest": payload_digest(F.col("payload"))})
    others = read_archives(spark, path, payload=False, where=F.col("record_type") == "revisit")
    both = own.drop("payload").unionByName(others)
    report = both.select(page_id_of("record_id", kind).alias("page_id"), F.col("http_length").alias("payload_bytes"), "payload_digest", "record_type", page_id_of("refers_to", kind).alias("refers_to"), "target_uri")
    held = materialize(report, "warc-report")
    discard(_Folder(spark, path))
    return held


class _Folder:
    """What :func:`discard` deletes."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.sparkSession, self._scratch_path = spark, path
