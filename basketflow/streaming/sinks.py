"""Start streaming queries: console, Parquet table, table snapshot, Kafka topic."""

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from basketflow import versions
from basketflow.sources.codec import encode_events


def _writer(
    frame: DataFrame, mode: str, name: str, checkpoint: str | None, every: str | None, once: bool
) -> DataStreamWriter:
    writer = frame.writeStream.outputMode(mode).queryName(name)
    if checkpoint is not None:
        writer = writer.option("checkpointLocation", checkpoint)
    if once:
        return writer.trigger(availableNow=True)
    return writer if every is None else writer.trigger(processingTime=every)


def start_console(
    frame: DataFrame,
    name: str,
    mode: str = "complete",
    every: str = "10 seconds",
    num_rows: int = 20,
    checkpoint: str | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Print the first ``num_rows`` rows, in full width, at each trigger.

    The console sink brings every row it is given to the driver before it prints the first
    few, so it is given no more than the rows shown and one, by which it knows to say that
    there are others. That works in complete mode, where the state is committed before the
    rows are read. In append mode a limit would count over the whole life of the stream,
    and state partitions that nobody reads to the end are not committed; there the closed
    windows are kept on the executors and the first rows taken from them.
    """
    writer = _writer(
        frame.limit(num_rows + 1) if mode == "complete" else frame,
        mode, name, checkpoint, every, once,
    )
    if mode == "complete":
        console = writer.format("console").option("truncate", False)
        return console.option("numRows", num_rows).start()

    def show_first(closed: DataFrame, batch_id: int) -> None:
        kept = closed.persist()
        try:
            print(f"{name}, batch {batch_id}, rows: {kept.count()}")
            kept.show(num_rows, truncate=False)
        finally:
            kept.unpersist()

    return writer.foreachBatch(show_first).start()


def start_parquet(
    frame: DataFrame,
    path: str,
    checkpoint: str,
    name: str,
    every: str = "30 seconds",
    files: int | None = None,
    partition_by: Sequence[str] = (),
    once: bool = False,
) -> StreamingQuery:
    """Append closed windows to a Parquet table, exactly once.

    Without ``files`` each trigger writes one file per non-empty state partition. With many
    state partitions that makes small files; ``files`` spreads the finished rows evenly
    over that many writers, whatever the key distribution, at the price of one shuffle of
    the result rows.
    """
    table = frame if files is None else frame.repartition(files)
    writer = _writer(table, "append", name, checkpoint, every, once).format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.option("path", path).start()


def start_snapshot(
    frame: DataFrame,
    path: str,
    checkpoint: str,
    name: str,
    every: str = "30 seconds",
    once: bool = False,
    keep: int | None = 2,
) -> StreamingQuery:
    """Write the whole complete-mode result at each trigger, to a folder of its own.

    The executors write it; when it is whole, a pointer is set to it, so a batch that fails
    half-way is never seen, nor one that is repeated. Then all but the ``keep`` newest results
    are removed, except those that :func:`hold_snapshot` holds: the disk used does not grow with
    the number of triggers.
    """
    spark = frame.sparkSession

    def write(result: DataFrame, batch_id: int) -> None:
        version = versions.new_version(batch_id)
        result.write.parquet(f"{path}/{version}")
        versions.publish(spark, path, version, keep)

    return _writer(frame, "complete", name, checkpoint, every, once).foreachBatch(write).start()


def read_snapshot(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest whole result that :func:`start_snapshot` has written; empty before any.

    It is read when the frame is: a frame that outlives ``keep`` triggers may find its files
    gone. :func:`hold_snapshot` keeps them for as long as they are needed.
    """
    return _version(spark, path, versions.current(spark, path), schema)


@contextmanager
def hold_snapshot(spark: SparkSession, path: str, schema: StructType) -> Iterator[DataFrame]:
    """:func:`read_snapshot` whose files stay while the block runs, whatever is written meanwhile."""
    with versions.held(spark, path) as version:
        yield _version(spark, path, version, schema)


def _version(spark: SparkSession, path: str, version: str | None, schema: StructType) -> DataFrame:
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{version}")


def write_events_kafka(
    events: DataFrame,
    servers: str,
    topic: str,
    checkpoint: str | None = None,
    name: str = "events_to_kafka",
    every: str | None = None,
) -> StreamingQuery | None:
    """Send events as JSON to a topic; starts a query for a stream, writes a batch at once."""
    target = {"kafka.bootstrap.servers": servers, "topic": topic}
    encoded = encode_events(events)
    if not events.isStreaming:
        encoded.write.format("kafka").options(**target).save()
        return None
    writer = _writer(encoded, "append", name, checkpoint, every, once=False)
    return writer.format("kafka").options(**target).start()
