"""Feeds: channels of records in files, read from a cursor on, and written once however often a write
is repeated.

A feed is a folder with one folder of JSONL files for each channel, and a log of commits that says of
each file its channel, rows, and first and last position. A position is (cursor value, key): by
default a record's timestamp and its id. ``spark.read.format("feed")`` plans a partition for each file;
comparisons of scalar columns are pushed down to the reader, which leaves out whole files by channel
and by position. ``spark.readStream.format("feed")`` has the cursor as its offset: for each channel the
last position that was handed on. Rows that arrive later than a newer one was handed on are behind the
cursor and stay there, as with any cursor by time.

``df.write.format("feed")`` and the stream writer have a task write files of its own; only when Spark
commits the job are they entered in the log, under the name of run and batch. A batch that is already
there is not entered again, so a write that was killed and repeated leaves each row once.

The functions below (``write_feed``, ``read_feed``, ``read_increments``, ``record_stream``) have Spark turn rows
into lines of JSON and back; the source then moves lines (option ``lines``) and looks at their positions by
columns. Rows pass through Python one by one only where filters are pushed down, or where a file lies across
a cursor.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, FloatType, MapType, StructType

from .records import RECORD

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
LOG, CURSORS, UNKNOWN = "_commits", "_cursors", "unknown"
FILE_ROWS = 1_000_000

Position = tuple[object, str]


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address, and the path there."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), unquote(urlsplit(path).path)
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def _load(fs: pafs.FileSystem, path: str):
    with fs.open_input_stream(path) as f:
        return json.loads(f.readall())


def _store(fs: pafs.FileSystem, path: str, value) -> None:
    """Write whole or not at all."""
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(aside) as f:
        f.write(json.dumps(value).encode())
    fs.move(aside, path)


@dataclass
class Held:
    """A file of a feed. Positions are unknown (None) in a folder without a log."""

    path: str
    channel: str
    rows: int = -1
    low: Position | None = None
    high: Position | None = None


def files(path: str) -> list[Held]:
    """The files that commits have entered; in a folder without a log all JSONL files, whose channel is
    their folder. A path that isn't there, or without any file, is an error."""
    fs, base = place(path)
    info = fs.get_file_info(base)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [Held(base, UNKNOWN)]
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if f.type == pafs.FileType.File]
    log = [f for f in found if f"/{LOG}/" in f and f.endswith(".json")]
    if fs.get_file_info(f"{base}/{LOG}").type != pafs.FileType.NotFound:
        entries = (e for f in log for e in _load(fs, f))
        return sorted((Held(f"{base}/{e['file']}", e["channel"], e["rows"], _position(e["low"]), _position(e["high"])) for e in entries), key=lambda h: h.path)
    plain = sorted(f for f in found if re.search(r"\.jsonl(\.gz)?$", f))
    if not plain:
        raise ValueError(f"no records below {path}")
    return [Held(f, f.rsplit("/", 2)[-2]) for f in plain]


def _position(x) -> Position | None:
    return None if x is None else (x[0], x[1])


def _behind(a: Position, b: Position) -> bool:
    """Whether a comes before b; a missing cursor value comes first."""
    if (a[0] is None) != (b[0] is None):
        return a[0] is None
    return (a[1] < b[1]) if a[0] == b[0] else (a[0] is not None and a[0] < b[0])


def channel_folder(value) -> str:
    text = "".join(c.lower() if c.isalnum() else "-" for c in str(value if value is not None else UNKNOWN))
    return "-".join(p for p in text.split("-") if p) or UNKNOWN


@dataclass
class Layout:
    """Which columns are a record's channel, cursor value and key."""

    path: str
    channel: str
    at: str
    key: str

    def position(self, row: dict) -> Position:
        return row.get(self.at), _text(row.get(self.key))


# Reading


@dataclass
class FilePart(InputPartition):
    file: str
    after: Position | None = None  # a stream's rows come behind this position
    until: Position | None = None


_COMPARE: dict[type, Callable] = {
    EqualTo: lambda v, x: v == x,
    In: lambda v, x: v in x,
    GreaterThan: lambda v, x: v > x,
    GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x,
    LessThanOrEqual: lambda v, x: v <= x,
    IsNotNull: lambda v, x: True,
}


def _holds(test: Filter, value) -> bool:
    return value is not None and _COMPARE[type(test)](value, getattr(test, "value", None))


def _batches(layout: Layout, schema: StructType, part: FilePart, tests: list[Filter], lines: bool) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_schema(schema)
    maps = [f.name for f in schema.fields if isinstance(f.dataType, MapType)]
    floats = [f.name for f in schema.fields if isinstance(f.dataType, DoubleType | FloatType)]

    def inside(row: dict) -> bool:
        here = layout.position(row)
        return not (part.after and not _behind(part.after, here)) and not (part.until and _behind(part.until, here))

    with place(layout.path)[0].open_input_stream(part.file) as f:  # inflates by the file's ending
        for held in _lines(f):
            if lines:
                if part.after or part.until:
                    held = [x for x in held if inside(json.loads(x))]
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], schema=arrow)
                continue
            rows = []
            for row in map(json.loads, held):
                if ((part.after or part.until) and not inside(row)) or not all(_holds(t, row.get(t.attribute[0])) for t in tests):
                    continue
                row = {n: row.get(n) for n in schema.names}
                for n in maps:
                    row[n] = list(row[n].items()) if isinstance(row[n], dict) else None
                for n in floats:
                    row[n] = float(row[n]) if isinstance(row[n], str) else row[n]  # Spark quotes what isn't a number
                rows.append(row)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)


def _lines(f) -> Iterator[list[bytes]]:
    """The lines that aren't blank, some at a time."""
    rest = b""
    while chunk := f.read(1 << 20):
        *whole, rest = (rest + chunk).split(b"\n")
        yield [x for x in whole if x.strip()]
    if rest.strip():
        yield [rest]


class FeedReader(DataSourceReader):
    def __init__(self, layout: Layout, schema: StructType, lines: bool = False) -> None:
        self.layout, self.schema, self.lines, self.tests = layout, schema, lines, []

    def _may_hold(self, f: Held) -> bool:
        for x in self.tests:
            name, value = x.attribute[0], getattr(x, "value", None)
            if name == self.layout.channel and f.rows >= 0:  # the log has the channel's value itself
                if not _holds(x, f.channel):
                    return False
            if name == self.layout.at and f.high is not None and f.high[0] is not None:
                if isinstance(x, (GreaterThan, GreaterThanOrEqual, EqualTo)) and not (f.high[0] > value or (f.high[0] == value and not isinstance(x, GreaterThan))):
                    return False
                low = f.low[0]
                if low is not None and isinstance(x, (LessThan, LessThanOrEqual, EqualTo)) and not (low < value or (low == value and not isinstance(x, LessThan))):
                    return False
        return True

    def partitions(self) -> list[FilePart]:
        return [FilePart(f.path) for f in files(self.layout.path) if f.rows and self._may_hold(f)]

    def read(self, partition: FilePart | None) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, FilePart):
            yield from _batches(self.layout, self.schema, partition, self.tests, self.lines)


class PushedFeedReader(FeedReader):
    """Spark refuses a reader that takes filters while pushing down is off, so it is one of its own."""

    def pushFilters(self, filters: list[Filter]):
        scalar = {f.name for f in self.schema.fields if f.dataType.simpleString() in ("string", "int", "bigint", "double", "boolean")}
        for x in filters:
            if type(x) in _COMPARE and len(x.attribute) == 1 and x.attribute[0] in scalar:
                self.tests.append(x)
            else:
                yield x


class FeedStreamReader(DataSourceStreamReader):
    """The offset is the cursor: {channel: [cursor value, key]} of the last row handed on."""

    def __init__(self, layout: Layout, schema: StructType, since: str | None, name: str | None, lines: bool = False) -> None:
        self.layout, self.schema, self.since, self.name, self.lines = layout, schema, since, name, lines

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out: dict[str, list] = {}
        for f in files(self.layout.path):
            if f.high is not None and (f.channel not in out or _behind(tuple(out[f.channel]), f.high)):
                out[f.channel] = list(f.high)
        return out

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        parts = []
        for f in files(self.layout.path):
            after, until = _position(start.get(f.channel)), _position(end.get(f.channel))
            if after is None and self.since is not None:
                after = (self.since, "")  # at or behind ``since``: keys aren't empty
            if until is None or f.high is None or (after and not _behind(after, f.high)) or _behind(until, f.low):
                continue
            # a file between the two has no row to leave out
            parts.append(FilePart(f.path, after if after and not _behind(after, f.low) else None, until if _behind(until, f.high) else None))
        return parts

    def read(self, partition: FilePart | None) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, FilePart):
            yield from _batches(self.layout, self.schema, partition, [], self.lines)

    def commit(self, end: dict) -> None:
        if self.name:
            fs, base = place(self.layout.path)
            _store(fs, f"{base}/{CURSORS}/{channel_folder(self.name)}.json", {"key": self.name, "value": json.dumps(end), "metadata": {}})


# Writing


@dataclass
class FilesWritten(WriterCommitMessage):
    entries: list[dict] = field(default_factory=list)


def _text(x) -> str:
    return str(x if x is not None else "")


def _ends(at: pa.Array, key: pa.Array) -> tuple[Position, Position]:
    """The first and the last position, as :func:`_behind` orders them."""
    ends, missing = pc.min_max(at), at.is_null()
    none = pc.any(missing).as_py()
    out = []
    for bound, first in (("min", none), ("max", at.null_count == len(at))):
        keys = key.filter(missing if first else pc.equal(at, ends[bound]))
        out.append((None if first else ends[bound].as_py(), pc.min_max(keys)[bound].as_py()))
    return out[0], out[1]


class _Writer:
    """What the batch and the stream writer share."""

    def __init__(self, layout: Layout, run: str, batch: str, lines: bool = False) -> None:
        self.layout, self.run, self.batch, self.lines = layout, run, batch, lines

    def _columns(self, batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
        """Channel, cursor value, key (as text) and line of each row."""
        if self.lines:
            channel, at, key, line = batch.columns
        else:
            channel, at, key = (batch.column(c) if c in batch.schema.names else pa.nulls(len(batch), pa.string()) for c in (self.layout.channel, self.layout.at, self.layout.key))
            line = pa.array([json.dumps(row, default=str, ensure_ascii=False) for row in batch.to_pylist(maps_as_pydicts="lossy")], pa.string())
        key = key.fill_null("") if pa.types.is_string(key.type) else pa.array([_text(x) for x in key.to_pylist()], pa.string())
        return channel, at, key, line.cast(pa.binary())

    def write(self, iterator: Iterator[pa.RecordBatch]) -> FilesWritten:
        fs, base = place(self.layout.path)
        done, open_files = [], {}
        try:
            for batch in iterator:
                channels, at, key, line = self._columns(batch)
                for channel in pc.unique(channels).to_pylist():
                    mine = channels.is_null() if channel is None else pc.equal(channels, channel)
                    if channel not in open_files:
                        folder = channel_folder(channel)
                        name = f"{folder}/{uuid.uuid4().hex}.jsonl"
                        fs.create_dir(f"{base}/{folder}", recursive=True)
                        entry = {"file": name, "channel": folder if channel is None else channel, "rows": 0, "low": None, "high": None}
                        open_files[channel] = (fs.open_output_stream(f"{base}/{name}"), entry)
                    f, entry = open_files[channel]
                    own = line.filter(mine).to_pylist()
                    f.write(b"\n".join(own) + b"\n")
                    low, high = _ends(at.filter(mine), key.filter(mine))
                    entry["rows"] += len(own)
                    if entry["low"] is None or _behind(low, _position(entry["low"])):
                        entry["low"] = list(low)
                    if entry["high"] is None or _behind(_position(entry["high"]), high):
                        entry["high"] = list(high)
                    if entry["rows"] >= FILE_ROWS:
                        f.close()
                        done.append(open_files.pop(channel)[1])
        finally:
            for f, entry in open_files.values():
                f.close()
                done.append(entry)
        return FilesWritten(done)

    def enter(self, messages: list[FilesWritten | None], batch: str) -> None:
        fs, base = place(self.layout.path)
        log = f"{base}/{LOG}/{channel_folder(self.run)}-{channel_folder(batch)}.json"
        if fs.get_file_info(log).type != pafs.FileType.NotFound:
            self.remove(messages)  # this batch is there already
            return
        _store(fs, log, [e for m in messages if m for e in m.entries])

    def remove(self, messages: list[FilesWritten | None]) -> None:
        fs, base = place(self.layout.path)
        for e in (e for m in messages if m for e in m.entries):
            if fs.get_file_info(f"{base}/{e['file']}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{base}/{e['file']}")


class FeedWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list[FilesWritten | None]) -> None:
        self.enter(messages, self.batch)

    def abort(self, messages: list[FilesWritten | None]) -> None:
        self.remove(messages)


class FeedStreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list[FilesWritten | None], batchId: int) -> None:
        self.enter(messages, str(batchId))

    def abort(self, messages: list[FilesWritten | None], batchId: int) -> None:
        self.remove(messages)


class FeedDataSource(DataSource):
    """Options: ``path``; ``pushdown``, whether a reader takes filters (see :func:`pushed`); ``channel``, ``at`` and ``key``, the columns of a record's channel, cursor value and
    id (source, timestamp, record_id); ``lines``, whether rows come and go as lines (read: a column ``line``; written: channel,
    cursor value, id and line); ``since``, where a stream without a cursor begins; ``cursor``, a
    name under which a stream's cursor is also kept beside the feed (up to the batch that Spark has last
    declared done); ``run`` and ``batch``, what a write
    is known by (a stream's batches are numbered by Spark)."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> StructType:
        return RECORD

    def _layout(self) -> Layout:
        o = self.options
        return Layout(o["path"], o.get("channel", "source"), o.get("at", "timestamp"), o.get("key", "record_id"))

    def _by_lines(self) -> bool:
        return self.options.get("lines", "false").lower() == "true"

    def reader(self, schema: StructType) -> FeedReader:
        pushing = self.options.get("pushdown", "false").lower() == "true"
        return (PushedFeedReader if pushing else FeedReader)(self._layout(), schema, self._by_lines())

    def streamReader(self, schema: StructType) -> FeedStreamReader:
        return FeedStreamReader(self._layout(), schema, self.options.get("since"), self.options.get("cursor"), self._by_lines())

    def writer(self, schema: StructType, overwrite: bool) -> FeedWriter:
        return FeedWriter(self._layout(), self.options.get("run", uuid.uuid4().hex), self.options.get("batch", "0"), self._by_lines())

    def streamWriter(self, schema: StructType, overwrite: bool) -> FeedStreamWriter:
        return FeedStreamWriter(self._layout(), self.options["run"], "", self._by_lines())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedDataSource)


def pushed(df: DataFrame, where: Column | str) -> DataFrame:
    """Rows of a frame just loaded from a Python data source that ``where`` holds for, as far as may be by
    the reader.

    Spark 4.1 keeps what it has pushed down with the loaded frame and reads no more rows for any later
    plan of it. So pushing down is on only while this one plan is made; a frame is loaded anew for
    each condition, and what is derived from the result is narrower anyway."""
    conf = df.sparkSession.conf
    before = conf.get(PUSHDOWN, "false")
    conf.set(PUSHDOWN, "true")
    try:
        out = df.where(where)
        out._jdf.queryExecution().executedPlan()
    finally:
        conf.set(PUSHDOWN, before)
    return out


#: Nulls are written as well, times with all their digits; a line that isn't JSON is an error.
_WRITTEN, _READ = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}, {"mode": "FAILFAST"}


def _as_lines(df: DataFrame, options: dict[str, str]) -> DataFrame:
    """Channel, cursor value, key and line of each row."""
    names = [options.get(k, default) for k, default in (("channel", "source"), ("at", "timestamp"), ("key", "record_id"))]
    of = lambda c: F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string")
    return df.select(*(of(c).alias(k) for c, k in zip(names, ("channel", "at", "key"), strict=True)), F.to_json(F.struct("*"), _WRITTEN).alias("line"))


def _from_lines(lines: DataFrame, schema: StructType | str | None) -> DataFrame:
    return lines.select(F.from_json("line", RECORD if schema is None else schema, _READ).alias("row")).select("row.*")


def write_feed(df: DataFrame, path: str, run: str, batch: str = "0", **options: str) -> None:
    """Enter the rows as batch ``batch`` of ``run``; once, however often this is repeated."""
    register(df.sparkSession)
    _as_lines(df, options).write.format("feed").mode("append").options(run=run, batch=batch, lines="true", **options).save(path)


def read_feed(spark: SparkSession, path: str, schema: StructType | str | None = None, where: Column | str | None = None, **options: str) -> DataFrame:
    """The feed, or what ``where`` holds for, by :func:`pushed`."""
    register(spark)
    r = spark.read.format("feed").options(**options)
    if where is None:
        return _from_lines(r.options(lines="true").schema("line string").load(path), schema)
    return pushed((r if schema is None else r.schema(schema)).options(pushdown="true").load(path), where)


def fetch(spark: SparkSession, path: str, tenant_id: str, since: str | None = None) -> DataFrame:
    """A tenant's records at or after ``since``; both conditions are the reader's."""
    own = F.col("tenant_id") == tenant_id
    return read_feed(spark, path, where=own if since is None else own & (F.col("timestamp") >= since))


def read_increments(spark: SparkSession, path: str, schema: StructType | str | None = None, **options: str) -> DataFrame:
    """The feed as a stream, from a cursor on."""
    register(spark)
    lines = spark.readStream.format("feed").options(lines="true", **options).schema("line string").load(path)
    return _from_lines(lines, schema)


def record_stream(df: DataFrame, path: str, run: str, checkpoint: str, **options: str):
    """A started query that enters each batch of a stream once in the feed at ``path``."""
    register(df.sparkSession)
    return _as_lines(df, options).writeStream.format("feed").options(run=run, lines="true", **options).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
