"""Incremental ingest of landed search pages with Structured Streaming.

Each run reads the page files that arrived since the last one and stops. The
checkpoint holds the progress, so a restart continues where it was, and the
state of ``dropDuplicates`` holds the ids of all earlier runs. The state lives in
RocksDB, on disk and in the checkpoint, so its size is not bound by memory.
"""

from __future__ import annotations

import json
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaintide.schemas import SEARCH_PAGE
from plaintide.sources.pages import search_hits

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the start of one stream, put back afterwards."""
    earlier = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in earlier.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


class ScopeChanged(ValueError):
    """The stored progress belongs to a different date range or product list."""


def guard_scope(spark: SparkSession, root: str, scope: dict) -> None:
    """Store the scope on the first run; refuse to continue under another one."""
    path, wanted = f"{root}/scope", json.dumps(scope, sort_keys=True)
    # A write that leaves an existing table alone needs no look at the file system first.
    spark.range(1).select(F.lit(wanted).alias("value")).coalesce(1).write.mode("ignore").parquet(path)
    stored = spark.read.schema("value string").parquet(path).first()["value"]
    if stored != wanted:
        raise ScopeChanged(f"stored scope {stored} differs from {wanted}; start afresh in a new folder")


def ingest_available(
    spark: SparkSession,
    pages: str,
    root: str,
    scope: dict,
    key: str = "complaint_id",
    watermark: tuple[str, str] | None = None,
    state_partitions: int | None = None,
) -> DataFrame:
    """Append the unseen records of newly landed pages; returns all stored so far.

    ``watermark`` = (event-time column, delay) bounds the id state: duplicates
    further apart than the delay are then no longer recognised. The id state is
    split into ``state_partitions`` (the cores of the cluster by default); the
    number of the first run stays with the stored progress.
    """
    guard_scope(spark, root, scope)
    partitions = state_partitions or spark.sparkContext.defaultParallelism
    settings = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.shuffle.partitions": str(partitions),
    }
    with _settings(spark, settings):
        hits = search_hits(spark.readStream.schema(SEARCH_PAGE).json(pages))
        hits = hits.where(F.col(key).isNotNull())
        if watermark:
            column, delay = watermark
            hits = hits.withColumn(column, F.try_to_timestamp(column)).withWatermark(column, delay)
            unique = hits.dropDuplicatesWithinWatermark([key])
        else:
            unique = hits.dropDuplicates([key])
        query = (
            unique.writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", f"{root}/progress")
            .option("path", f"{root}/records")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.parquet(f"{root}/records")
