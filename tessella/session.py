"""Sessions, and how the package reaches executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def build(app: str = "tessella", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine's semantics need: UTC, adaptive execution."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}
    return b.config(map={**fixed, **conf}).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to executors that don't have it on their path: as a zip through Spark's
    own file server, once a session."""
    sc = spark.sparkContext
    root = os.path.dirname(PACKAGE)
    if getattr(sc, "_tessella_shipped", False):
        return
    sc._tessella_shipped = True
    # a worker's path comes from the environment that the JVM was started with
    if root in str(sc._jvm.System.getenv("PYTHONPATH") or "").split(os.pathsep):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tessella-"), "tessella.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(PACKAGE):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)


def _shared(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; where that is unset, a local session gets a
    folder of this machine, and any other is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared one."""
    return f"{_shared(spark).rstrip('/')}/tessella-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """Written once into the shared folder, lineage cut."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As :func:`kept`, but as a Parquet table. For loops: what a checkpointed frame remembers of its columns
    (constraints) grows with every round, a table remembers nothing."""
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
