"""Helpers the operators share."""

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import basketflow.llm
from basketflow.streaming.storage import workspace

# Tasks carry the functions they run, so that executors need no copy of this package.
register_pickle_by_value(basketflow.llm)

#: Rows of one Arrow batch: with texts of a few hundred kB a Python worker stays below 100 MB.
BATCH_ROWS = 500


#: Spark removes the shuffle files of a query when it ends, and not when the driver next collects
#: its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what runs within are removed with it."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def saved_at(frame: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``saved``, and the folder, which ``removed`` takes away once the table is spent."""
    spark = frame.sparkSession
    path = f"{workspace(spark, label)}/table"
    with cleaned_up(spark):
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path), path


def saved(frame: DataFrame, label: str) -> DataFrame:
    """The frame written once as Parquet to the shared folder and read again.

    It cuts the lineage, survives lost executors, and gives the planner a size. What was shuffled
    to make it is removed, since the table takes its place.
    """
    return saved_at(frame, label)[0]


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables of ``saved_at`` from which all that is needed has been written elsewhere."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of the frame's (Spark ignores case)."""
    taken = {c.lower() for c in frame.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, where the optimizer would copy it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def map_batches(
    frame: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with batches that are small enough for long texts."""
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return frame.mapInArrow(work, schema)


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text, nulls as empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space; ``bytes`` knows no other kind."""
    return text.lower().split()
