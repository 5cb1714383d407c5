"""Typed loads, sinks, views and the named-query runner."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns cast to the declared types, empty text as null.

    A value that does not fit its type, or a null in a required column, fails
    the job, as a typed table load does.
    """
    columns = []
    for field in schema:
        value = F.nullif(F.col(field.name), F.lit("")) if dict(df.dtypes)[field.name] == "string" else F.col(field.name)
        value = value.cast(field.dataType)
        if not field.nullable:
            problem = F.raise_error(F.lit(f"null in required column {field.name}"))
            value = F.coalesce(value, problem.cast(field.dataType))
        columns.append(value.alias(field.name))
    return df.select(*columns)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _versions(spark: SparkSession, name: str) -> str:
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}.versions"


def replace_table(df: DataFrame, name: str) -> None:
    """Replace what ``name`` reads, in one step that readers do not notice.

    The rows are written whole to a folder of their own; then one change of the catalog lets the
    name read them. Until then, and if the write fails, the name reads what it did before, and
    readers that have begun keep their files. ``df`` may read the table it replaces.
    """
    spark = df.sparkSession
    folder = f"{_versions(spark, name)}/version-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM parquet.`{folder}`")


def sweep_versions(spark: SparkSession, name: str) -> int:
    """Delete all versions of a replaced table but the current one, half-written ones too: how many.

    To be called when no reader is left on an older one.
    """
    system, folder = fs.FileSystem.from_uri(_versions(spark, name))
    current = {path.rsplit("/", 2)[1] for path in spark.table(name).inputFiles()}
    gone = [f for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name not in current]
    for old in gone:
        system.delete_dir(old.path)
    return len(gone)


def register_views(views: dict[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def sample_extract(df: DataFrame, path: str, rows: int = 1000, key: str = "complaint_id") -> None:
    """The first rows by key, as a file that shows the schema."""
    write_csv(df.orderBy(key).limit(rows), path)


def run_named(
    spark: SparkSession,
    queries: dict[str, Callable[[SparkSession, str], DataFrame]],
    source: str,
    target: str,
    side_by_side: int = 1,
    limit: float | None = None,
) -> dict[str, str]:
    """Run and export every query; a failure is recorded and does not stop the rest.

    So many run side by side, each in a scheduler pool of its own, which fair scheduling
    (``spark.scheduler.mode``) gives its share. One that takes longer than ``limit`` seconds, counted from
    the time the runner turns to it, is cancelled by the tag of its jobs and recorded as late.
    """
    context, failures = spark.sparkContext, {}
    run = uuid.uuid4().hex

    def export(name: str) -> None:
        context.setLocalProperty("spark.scheduler.pool", name)
        context.addJobTag(f"{run}-{name}")
        try:
            write_csv(queries[name](spark, source), f"{target}/{name}")
        finally:
            context.clearJobTags()
            context.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(side_by_side) as threads:
        started = {name: threads.submit(export, name) for name in queries}
        for name, done in started.items():
            try:
                done.result(limit)
            except Late:
                if not done.cancel():
                    context.cancelJobsWithTag(f"{run}-{name}")
                failures[name] = f"not done within {limit} seconds"
            except Exception as error:  # noqa: BLE001 - each failure belongs in the report
                failures[name] = str(error).strip().splitlines()[0]
    return failures
