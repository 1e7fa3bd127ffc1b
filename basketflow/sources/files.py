"""JSON-lines files as raw events, and the stored result tables.

A result table is a folder of Parquet files, laid out flat or by day (``day=2025-01-31``), the
day being that of the window's start. A table laid out by day may also hold closed days in
compacted form; see :mod:`basketflow.streaming.compaction`.
"""

import json
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketflow import folders
from basketflow.schema import DAY, TABLE_SCHEMAS, table_schema

#: Folder of the compacted days, below the table. Spark passes over names with an underscore.
COMPACTED = "_compacted"


def read_events_files(
    spark: SparkSession, path: str, streaming: bool = True, max_files: int | None = None
) -> DataFrame:
    """Raw events (column ``value``) from a folder of JSON-lines files."""
    if not streaming:
        return spark.read.text(path)
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)


def time_column(table: str) -> str:
    """The column a stored table's day is taken from: the start of its windows."""
    return T.StructType.fromDDL(TABLE_SCHEMAS[table]).names[0]


def with_day(frame: DataFrame, table: str) -> DataFrame:
    """Add the partition column ``day`` to rows of a stored table."""
    return frame.withColumn(DAY, F.to_date(time_column(table)))


def stored_days(spark: SparkSession, path: str) -> list[date]:
    """The days a table is laid out by, in order, from one listing of its folder.

    Empty for a table laid out flat and for one that is not there.
    """
    prefix = f"{DAY}="
    found = [name.removeprefix(prefix) for name in folders.names(spark, path) if name.startswith(prefix)]
    return sorted(date.fromisoformat(name) for name in found if not name.startswith("__"))


def compacted_days(spark: SparkSession, path: str) -> dict[date, str]:
    """Days that have been compacted, and the folder each is in."""
    pointer = folders.read_text(spark, f"{path}/{COMPACTED}/_current")
    return {date.fromisoformat(day): run for day, run in json.loads(pointer or "{}").items()}


def _parquet(spark: SparkSession, schema: T.StructType, *paths: str, base: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema)
    if base is not None:
        reader = reader.option("basePath", base)
    try:
        return reader.parquet(*paths)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, table: str, parts: bool = False) -> DataFrame:
    """A stored table with its partition column ``day`` where it has one.

    A day that has been compacted is read from there, and its small files are left alone.
    """
    schema = table_schema(table, parts)
    if not stored_days(spark, path):
        return _parquet(spark, schema, path).select(schema.names)
    schema = T.StructType([*schema.fields, T.StructField(DAY, T.DateType())])
    streamed = _parquet(spark, schema, path).select(schema.names)
    packed = compacted_days(spark, path)
    if not packed:
        return streamed
    base = f"{path}/{COMPACTED}"
    runs = sorted({f"{base}/{run}" for run in packed.values()})
    return (
        _parquet(spark, schema, *runs, base=base).select(schema.names)
        .union(streamed.where(~F.col(DAY).isin(*packed)))
    )


def read_result(
    spark: SparkSession,
    path: str,
    table: str,
    parts: bool = False,
    since: date | None = None,
    until: date | None = None,
) -> DataFrame:
    """A stored result table; empty, with its columns, when nothing was written yet.

    The schema is given and not inferred, so no footers are read up front. ``since`` and
    ``until`` (days, both included) limit the rows; in a table laid out by day they choose the
    folders that are read, in a flat one they are pushed down to the row groups. ``parts`` adds
    the mergeable columns, null where the table was written without them. The partition column
    is left out.
    """
    stored = read_table(spark, path, table, parts)
    moment = F.col(time_column(table))
    if since is not None:
        stored = stored.where(moment >= F.lit(since).cast("timestamp"))
    if until is not None:
        stored = stored.where(moment < F.date_add(F.lit(until), 1).cast("timestamp"))
    if DAY in stored.columns:
        day = F.col(DAY)
        stored = stored if since is None else stored.where(day >= F.lit(since))
        stored = stored if until is None else stored.where(day <= F.lit(until))
    return stored.select(table_schema(table, parts).names)


def read_newest_day(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The newest day of a stored table that has rows, or the whole of a flat table.

    The days come from the listing of the folder, newest first; one that holds only files of a
    batch that was never committed is passed over. All that a report on the newest window needs
    is then in one partition, however long the table's history.
    """
    for day in reversed(stored_days(spark, path)):
        found = read_result(spark, path, table, since=day, until=day)
        if not found.isEmpty():
            return found
    return read_result(spark, path, table)
