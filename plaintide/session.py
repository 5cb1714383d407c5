"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import contextlib
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "plaintide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on (UTC, ANSI, AQE)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Call-site capture costs several JVM calls per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # The JVM does not compile methods above 8,000 bytes; larger stages run faster unfused.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder of this application that every executor can reach.

    It lies below ``spark.checkpoint.dir``. Where that is unset, it lies below the
    warehouse, which driver and executors share by definition.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared root for a landed file set or a sink."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is written meanwhile leaves no shuffle files; else they stay until the driver collects its garbage.

    For writes alone: a relation that is defined meanwhile and read twice would be shuffled twice.
    """
    before = spark.conf.get(_SHUFFLE_CLEANUP, "false")
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Write ``df`` as Parquet below the shared root and read on from there.

    Used where one relation feeds several branches: the scan below it runs once,
    every branch sees identical values, the planner knows the measured size and
    prunes columns, and a lost executor re-reads a file instead of replaying the
    scan.
    """
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has settled; call it when its results are consumed."""
    system, path = fs.FileSystem.from_uri(shared_root(spark))
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)
