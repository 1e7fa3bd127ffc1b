"""Closed days of a streamed table, packed into few files.

A streaming sink leaves a handful of files at every trigger, for ever, and its log names them,
so they cannot be rewritten in place. Closed days are therefore packed into a folder beside
them, and a pointer that is replaced in one step says which days are to be read from there.
"""

import json
from datetime import date
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketflow import folders
from basketflow.schema import DAY, PART_SCHEMAS
from basketflow.sources.files import COMPACTED, compacted_days, read_table, stored_days, time_column


def closed_days(spark: SparkSession, path: str, table: str) -> list[date]:
    """Days to which the stream adds nothing any more.

    A window is written when the watermark passes its end, so with the first row of a day all
    windows of the days before have been written, in this batch or an earlier one. A day
    counts as begun only when its rows are committed.
    """
    days = stored_days(spark, path)
    while days and read_table(spark, path, table).where(F.col(DAY) == days[-1]).isEmpty():
        days.pop()
    return days[:-1]


def compact(
    spark: SparkSession, path: str, table: str, target_bytes: int = 128 << 20
) -> list[date]:
    """Pack all closed days that are not packed yet; returns them.

    Files hold about ``target_bytes`` each, by the size of the day's files now, and are sorted
    by time. A reader sees a day either unpacked or packed, never both; one that opened the
    table before goes on reading the small files, which stay.
    """
    if folders.exists(spark, path) and not stored_days(spark, path) and folders.exists(spark, f"{path}/_spark_metadata"):
        raise ValueError(f"table {path} is laid out flat; only tables laid out by day can be compacted")
    done = compacted_days(spark, path)
    todo = [day for day in closed_days(spark, path, table) if day not in done]
    if not todo:
        return []
    stored = read_table(spark, path, table, parts=table in PART_SCHEMAS).where(F.col(DAY).isin(*todo))
    files = {day: max(1, -(-folders.size(spark, f"{path}/{DAY}={day}") // target_bytes)) for day in todo}
    run = f"run={uuid4().hex}"
    _packed(stored, time_column(table), files).write.partitionBy(DAY).parquet(f"{path}/{COMPACTED}/{run}")
    pointer = {str(day): where for day, where in done.items()} | {str(day): run for day in todo}
    folders.replace_text(spark, f"{path}/{COMPACTED}/_current", json.dumps(pointer, sort_keys=True))
    return todo


def _packed(stored: DataFrame, time: str, files: dict[date, int]) -> DataFrame:
    """Each day dealt to its number of writers, so that each writes one file of it."""
    numbers = F.create_map(*[F.lit(x) for pair in files.items() for x in pair])
    writer = F.pmod(F.xxhash64(*[c for c in stored.columns if c != DAY]), numbers[F.col(DAY)])
    return (
        stored.withColumn("_writer", writer)
        .repartition(sum(files.values()), DAY, "_writer")
        .sortWithinPartitions(DAY, "_writer", time)
        .drop("_writer")
    )
