"""Kafka topics as streaming frames.

Needs the Kafka connector on the class path
(``--packages org.apache.spark:spark-sql-kafka-0-10_2.13:<spark version>``).
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: source defaults --------------------------------------------
DEFAULT_SERVERS = "localhost:9092"
DEFAULT_TOPIC = "stream_in"
DEFAULT_MAX_PER_TRIGGER = 1000

#: "As the form of the source has it": one topic from the latest offset is read in steps of
#: DEFAULT_MAX_PER_TRIGGER, several topics or a start from the earliest offset without a cap.
BY_FORM = -1


def kafka_options(
    servers: str = DEFAULT_SERVERS,
    topics: str | Sequence[str] = DEFAULT_TOPIC,
    starting: str = "latest",
    max_per_trigger: int | None = BY_FORM,
    min_partitions: int | None = None,
    fail_on_data_loss: bool = False,
) -> dict[str, str]:
    """Options of the ``kafka`` source.

    One topic or several, from the ``latest`` or ``earliest`` offsets. A single topic read
    from the latest offset has a cap of 1000 offsets per micro-batch unless
    ``max_per_trigger`` says otherwise; the other forms have none, and ``None`` lifts it.
    ``min_partitions`` splits large topic partitions over more tasks. Offsets that have
    expired are passed over unless ``fail_on_data_loss``.
    """
    names = [topics] if isinstance(topics, str) else list(topics)
    if not names:
        raise ValueError("at least one topic is needed")
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(names),
        "startingOffsets": starting,
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }
    if max_per_trigger == BY_FORM:
        single = len(names) == 1 and starting == "latest"
        max_per_trigger = DEFAULT_MAX_PER_TRIGGER if single else None
    if max_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    if min_partitions is not None:
        options["minPartitions"] = str(min_partitions)
    return options


def read_events_kafka(spark: SparkSession, **settings) -> DataFrame:
    """Stream of raw records; ``settings`` as for :func:`kafka_options`."""
    return spark.readStream.format("kafka").options(**kafka_options(**settings)).load()
