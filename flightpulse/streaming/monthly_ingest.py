"""Ingest of newly arrived monthly files, one month's partition at a time."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.facts import facts_from_flights
from ..plans.rollup import write_rollup
from ..plans.views import refresh_views
from ..sources.monthly_csv import list_monthly_files, month_of_file, read_monthly_files
from ..sources.tables import read_flights, write_flights
from ..vocabulary import MONTHLY_FILE_GLOB

# What the file listing source provides; the content itself is never selected.
_LISTING_SCHEMA = "path STRING, modificationTime TIMESTAMP_LTZ, length BIGINT, content BINARY"


def load_months(
    spark: SparkSession,
    directory: str,
    table: str,
    months: set[str],
    rollup: str | None = None,
    checks: Observation | None = None,
) -> None:
    """Rebuild the partitions of the given months from all their files.

    The result depends only on the files present, so repeating it after a
    failure gives the same table. The flights and the rollup each change all at
    once; views of the stored flights then show the new months and their
    columns. ``checks`` counts rows, refused times and missing codes on
    the way.
    """
    paths = [path for path in list_monthly_files(spark, directory) if month_of_file(path) in months]
    write_flights(read_monthly_files(spark, paths, checks=checks), table, replace_all=False, months=months)
    if rollup is not None:
        write_rollup(facts_from_flights(read_flights(spark, table)), rollup, sorted(months))
    refresh_views(spark)


def _load_batch(arrivals: DataFrame, _: int, directory: str, table: str, rollup: str | None) -> None:
    months = {month_of_file(row.path) for row in arrivals.select("path").collect()}
    if months:
        load_months(arrivals.sparkSession, directory, table, months, rollup)


def ingest_new_files(
    spark: SparkSession,
    directory: str,
    table: str,
    checkpoint: str,
    rollup: str | None = None,
    files_per_batch: int = 200,
) -> StreamingQuery:
    """Load the monthly files not seen before, then stop.

    A batch takes ``files_per_batch`` of them, so what the driver lists at once
    does not grow with the backlog.

    The stream carries file names only; the months they belong to are read by
    the batch reader. The checkpoint remembers which files were loaded.
    """
    arrivals = (
        spark.readStream.format("binaryFile")
        .schema(_LISTING_SCHEMA)
        .option("pathGlobFilter", MONTHLY_FILE_GLOB)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(directory)
        .select("path")
    )
    return (
        arrivals.writeStream.foreachBatch(
            partial(_load_batch, directory=directory, table=table, rollup=rollup)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
