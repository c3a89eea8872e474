"""What the operators of this subpackage share: shared scratch tables, input columns, bounded caches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: blank, tab, line feed, vertical tab, form feed, return.
WORD_BREAKS = r"[\x20\x09-\x0D]+"
#: Spark's own setting that deletes a query's shuffle files when the query ends.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: list[list[DataFrame]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in
    ``spark.checkpoint.dir``. Where that is unset, a local session gets a folder of this machine;
    on a cluster that would lose rows, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessella-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut, a lost
    executor costs no recomputation of it, and its shuffle files go when it is written."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema, before = df.schema, spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that nothing will read again."""
    for t in tables:
        if path := getattr(t, "_scratch_path", None):
            _delete(t.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application; results not yet written are lost."""
    _delete(spark, scratch_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch_scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within it, the function it gives names a table that outlives the scope; all other scratch
    tables made within are deleted at its end."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield lambda df: (kept.append(df), df)[1]
    finally:
        _scopes.pop()
        discard(*(t for t in made if not any(t is k for k in kept)))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, under fixed names, so that further columns of
    the input can't clash with its own. A null text counts as an empty one."""
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))


def spans_of_chars(lengths, limit: int, rows: int = 1 << 30):
    """Cut a list of lengths into runs of about ``limit`` characters and ``rows`` texts at most:
    (first, last + 1)."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i - start == rows or (total and total + n > limit):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def text_runs(batches: Iterator[pa.RecordBatch], limit: int, rows: int = 1 << 30, col: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``limit`` bytes of text and ``rows`` rows at most, so that what a
    step makes of a batch is bounded (a longer text is a batch of its own)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_pylist()
        for lo, hi in spans_of_chars(lengths, limit, rows):
            yield batch.slice(lo, hi - lo)


class ByteBound(dict):
    """A worker's cache of at most about ``limit`` bytes in two generations: when the young one is
    full it becomes the old one, whose entries come back when they are asked for again. ``make``
    computes a missing value, ``weigh`` says its bytes with its key; ``make_all`` computes a list of them
    at once."""

    def __init__(self, make: Callable, weigh: Callable, limit: int, make_all: Callable | None = None) -> None:
        self.make, self.weigh, self.half = make, weigh, limit // 2
        self.make_all = make_all or (lambda keys: list(map(make, keys)))
        self.old: dict = {}
        self.held = 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self._hold([key], [value])
        return value

    def all_of(self, keys: list) -> list:
        """The values of distinct keys, of which the missing ones are made together."""
        values = list(map(self.get, keys))
        absent = [i for i, v in enumerate(values) if v is None]
        for i in absent:
            values[i] = self.old.get(keys[i])
        new = [i for i in absent if values[i] is None]
        for i, v in zip(new, self.make_all([keys[i] for i in new]), strict=True):
            values[i] = v
        self._hold([keys[i] for i in absent], [values[i] for i in absent])
        return values

    def _hold(self, keys: list, values: list) -> None:
        weight = sum(map(self.weigh, keys, values))
        if len(keys) > 1 and weight > self.half:
            half = len(keys) // 2
            self._hold(keys[:half], values[:half])
            self._hold(keys[half:], values[half:])
            return
        self.held += weight
        if self.held > self.half:
            self.old = dict(self)
            self.clear()
            self.held = weight
        self.update(zip(keys, values, strict=True))
