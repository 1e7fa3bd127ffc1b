"""One ingest for many queries: the topic is read and parsed once, into a typed table by day.

Without it every query of the application reads and parses the whole topic for itself. The
landing stream keeps each record once, exactly, with all its fields; the other queries are
streams over its files and read the columns they need, nothing else.

Records that cannot count anywhere, because they are no JSON object or have no readable time,
are kept too: with their text, in the partition of no day.
"""

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from basketflow import folders
from basketflow.schema import DAY, EVENT_SCHEMA
from basketflow.sources.codec import with_event_time
from basketflow.streaming.sinks import start_parquet

#: Text of a record that was refused; null for all others.
REJECTED = "rejected"
#: Why: one of the values of :func:`landed`.
REASON = "reason"

LANDED_SCHEMA = T.StructType(
    [
        *EVENT_SCHEMA.fields,
        T.StructField(REJECTED, T.StringType()),
        T.StructField(REASON, T.StringType()),
        T.StructField(DAY, T.DateType()),
    ]
)

NO_OBJECT, NO_TIME = "no JSON object", "no readable time"


def landed(raw: DataFrame) -> DataFrame:
    """Raw records (``value``, binary or string) -> rows of :data:`LANDED_SCHEMA`.

    No record is dropped. One without a time is refused, since no window can hold it; a field
    of the wrong type is a null in that field and nothing more. A null value is no JSON object.
    """
    text = F.col("value").cast("string")
    # Opened with ``inline``, so that later filters do not copy the parser.
    record = F.struct(F.from_json(text, EVENT_SCHEMA).alias("event"), text.alias("text"))
    found = raw.select(F.inline(F.array(record)))
    refused = F.col("event.timestamp").isNull()
    # Text that is no JSON parses to nulls, as does an object without a field that can be read;
    # only refused records are looked at once more to tell them apart.
    kind = F.schema_of_variant(F.try_parse_json("text"))
    is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    reason = F.when(refused, F.when(is_object, NO_TIME).otherwise(NO_OBJECT))
    return found.select(
        *[F.col(f"event.{name}") for name in EVENT_SCHEMA.names],
        F.when(refused, F.coalesce(F.col("text"), F.lit(""))).alias(REJECTED),
        reason.alias(REASON),
        F.to_date("event.timestamp").alias(DAY),
    )


def counted(frame: DataFrame, name: str = "landing") -> DataFrame:
    """Note with each batch how many records came and how many were refused, and why."""

    def number(reason: str) -> Column:
        return F.count_if(F.col(REASON) == reason)

    return frame.observe(
        name, F.count("*").alias("records"),
        number(NO_OBJECT).alias("no_object"), number(NO_TIME).alias("no_time"),
    )


def start_landing(
    raw: DataFrame,
    path: str,
    checkpoint: str,
    name: str = "landing",
    every: str = "10 seconds",
    files: int | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Append all records of ``raw`` to the landed table, exactly once."""
    return start_parquet(
        counted(landed(raw), name), path, checkpoint, name, every, files, [DAY], once
    )


def _columns(fields: Iterable[str] | None) -> Sequence[str]:
    wanted = None if fields is None else {"timestamp", *fields}
    return [name for name in EVENT_SCHEMA.names if wanted is None or name in wanted]


def stream_landed(
    spark: SparkSession, path: str, delay: str = "2 minutes", fields: Iterable[str] | None = None
) -> DataFrame:
    """Typed, watermarked events as a stream over the landed table.

    Takes the place of ``parse_events`` over the topic: same columns, same rows but for the
    refused ones, which count in no window. ``fields`` limits what is read of the files.
    """
    folders.make(spark, path)
    stored = spark.readStream.schema(LANDED_SCHEMA).parquet(path)
    return with_event_time(stored.where(f"{DAY} IS NOT NULL").select(*_columns(fields)), delay)


def read_landed(spark: SparkSession, path: str, delay: str = "2 minutes") -> DataFrame:
    """The same events as a batch."""
    stored = spark.read.schema(LANDED_SCHEMA).parquet(path)
    return with_event_time(stored.where(f"{DAY} IS NOT NULL").select(*EVENT_SCHEMA.names), delay)


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """``rejected, reason`` of the refused records; only their partition is read."""
    stored = spark.read.schema(LANDED_SCHEMA).parquet(path)
    return stored.where(f"{DAY} IS NULL").select(REJECTED, REASON)
