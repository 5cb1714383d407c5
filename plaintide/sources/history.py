"""The ids that earlier runs have stored, kept so that a run need not shuffle them again.

The history is a table bucketed by the id. New records are shuffled into as many buckets and
joined bucket by bucket; the history itself is read where it lies, its id column only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaintide.session import settle
from plaintide.sources.pages import first_seen

#: Buckets of a history; choose it for the size it will reach, at least the shuffle partitions.
BUCKETS = 64


def open_history(spark: SparkSession, name: str, key: str, kind: str, buckets: int = BUCKETS) -> DataFrame:
    """The history table, created empty where it does not exist."""
    if not spark.catalog.tableExists(name):
        empty = spark.createDataFrame([], f"{key} {kind}")
        empty.write.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def ingest(new: DataFrame, key: str, place: list[str], name: str, buckets: int = BUCKETS) -> DataFrame:
    """New records that no earlier run has stored, the first of each id, and their ids added to the history.

    The records are settled before the ids are added, so that they stay the same. Records without an id never enter.
    A run that fails before its ids are added gives the same records when it is run again.
    """
    spark = new.sparkSession
    history = open_history(spark, name, key, dict(new.dtypes)[key], buckets)
    fresh = settle(first_seen(new, key, place, history), "fresh")
    fresh.select(key).repartition(buckets, F.col(key)).write.mode("append").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return fresh
