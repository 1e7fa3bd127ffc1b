"""The continuous application: six console metrics and the roll-up tables."""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from basketflow import folders
from basketflow import operators as op
from basketflow.sources import parse_events, read_events_kafka
from basketflow.sources.kafka import BY_FORM, DEFAULT_SERVERS, DEFAULT_TOPIC
from basketflow.operators import totals
from basketflow.operators.totals import Total
from basketflow.schema import DAY
from basketflow.sources import stored_days, with_day
from basketflow.streaming import (
    Account, refuse_changes, refuse_lost_checkpoint, start_console, start_landing, start_parquet,
    start_totals, stream_landed,
)
from basketflow.streaming.guard import describe

_POOL = "spark.scheduler.pool"


@dataclass(frozen=True)
class Settings:
    """What the application reads, computes and writes.

    ``landing`` reads and parses the topics once, into a table that all queries stream from.
    ``running_totals`` keeps the three metrics without a watermark as partial results and not as
    state. ``parts`` stores the mergeable columns of the roll-ups; ``by_day`` lays new tables out
    by day.
    """

    base_path: str
    checkpoint_root: str | None = None
    servers: str = DEFAULT_SERVERS
    topics: str = DEFAULT_TOPIC
    starting: str = "latest"
    max_per_trigger: int | None = BY_FORM
    min_partitions: int | None = None
    fail_on_data_loss: bool = False
    delay: str = "2 minutes"
    metric_width: str = "1 minute"
    table_width: str = "5 minutes"
    metric_every: str = "10 seconds"
    table_every: str = "30 seconds"
    top_n: int = 5
    peak_threshold: int = 10
    sales_table: bool = True
    table_files: int | None = 4
    landing: bool = False
    running_totals: bool = False
    parts: bool = False
    by_day: bool = True


@dataclass(frozen=True)
class Job:
    """One streaming query. ``table`` names its folder; without one it prints."""

    name: str
    operator: Callable[..., DataFrame]
    arguments: dict = field(default_factory=dict)
    mode: str = "complete"
    num_rows: int = 20
    table: str | None = None
    total: Total | None = None


def jobs(settings: Settings) -> list[Job]:
    """The queries of the application."""
    minute = {"width": settings.metric_width}
    window = {"width": settings.table_width} | ({"parts": True} if settings.parts else {})

    def total(made: Total) -> Total | None:
        return made if settings.running_totals else None

    listed = [
        Job("sales_per_minute", op.sales_per_minute, minute),
        Job(
            "top_viewed_products", op.top_viewed_products, {"n": settings.top_n},
            total=total(totals.views_per_product(settings.top_n)),
        ),
        Job(
            "average_ticket_per_user", op.average_ticket_per_user, num_rows=10,
            total=total(totals.ticket_per_user()),
        ),
        Job("conversion_rate", op.conversion_rate, minute),
        Job(
            "visits_by_category", op.visits_by_category, minute,
            total=total(totals.visits_per_category(settings.metric_width)),
        ),
        Job(
            "demand_peaks",
            op.demand_peaks,
            minute | {"threshold": settings.peak_threshold},
            mode="append",
        ),
        Job("aggregate_by_user", op.aggregate_by_user, window, table="users"),
        Job("aggregate_by_category", op.aggregate_by_category, window, table="categories"),
        Job("aggregate_by_product", op.aggregate_by_product, window, table="products"),
    ]
    if settings.sales_table:
        unordered = minute | {"ordered": False}
        listed.append(
            Job("sales_table", op.sales_per_minute, unordered, table="sales_per_minute")
        )
    return listed


def _topics(spark: SparkSession, settings: Settings) -> DataFrame:
    return read_events_kafka(
        spark,
        servers=settings.servers,
        topics=settings.topics.split(","),
        starting=settings.starting,
        max_per_trigger=settings.max_per_trigger,
        min_partitions=settings.min_partitions,
        fail_on_data_loss=settings.fail_on_data_loss,
    )


def _checkpoint_root(spark: SparkSession, settings: Settings) -> str:
    """Given in the settings or for the session's streams, or beside the tables it belongs to.

    The default stays the same from one start to the next, so that a stream resumes, and is
    another for each base path.
    """
    return (
        settings.checkpoint_root
        or spark.conf.get("spark.sql.streaming.checkpointLocation", None)
        or f"{settings.base_path.rstrip('/')}/_checkpoints"
    ).rstrip("/")


def start(
    spark: SparkSession, settings: Settings, raw: DataFrame | None = None, once: bool = False
) -> list[StreamingQuery]:
    """Start every job, each parsing only the fields its operator reads.

    ``raw`` replaces the Kafka topics by another stream with a JSON ``value`` column.
    ``once`` processes what is there and ends. If one job cannot start, those already
    running are stopped. Each job has a scheduler pool of its own, so that under
    ``spark.scheduler.mode=FAIR`` a long batch of one does not hold up the others.

    A checkpoint that was made with other settings, or with another number of state
    partitions, is refused before its job starts.
    """
    raw = _topics(spark, settings) if raw is None else raw
    base, root = settings.base_path.rstrip("/"), _checkpoint_root(spark, settings)
    running: list[StreamingQuery] = []
    try:
        if settings.landing:
            spark.sparkContext.setLocalProperty(_POOL, "landing")
            refuse_lost_checkpoint(spark, f"{base}/landed", f"{root}/landing")
            running.append(
                start_landing(
                    raw, f"{base}/landed", f"{root}/landing", every=settings.metric_every,
                    files=settings.table_files, once=once,
                )
            )
            if once:  # the others end with what has been landed
                running[0].awaitTermination()
        for job in jobs(settings):
            spark.sparkContext.setLocalProperty(_POOL, job.name)
            fields = job.operator.fields
            if settings.landing:
                events = stream_landed(spark, f"{base}/landed", settings.delay, fields)
            else:
                events = parse_events(raw, settings.delay, fields)
            running.append(_start_job(spark, settings, job, events, f"{root}/{job.name}", once))
    except BaseException:
        stop(running)
        raise
    finally:
        spark.sparkContext.setLocalProperty(_POOL, None)
    return running


def _start_job(
    spark: SparkSession, settings: Settings, job: Job, events: DataFrame, checkpoint: str, once: bool
) -> StreamingQuery:
    base = settings.base_path.rstrip("/")
    result = job.operator(events, **job.arguments)
    plan = describe(job.operator.__name__, job.arguments, result)
    if job.total is not None:
        plan["operator"] = job.total.name
        refuse_changes(spark, checkpoint, plan)
        return start_totals(
            events, job.total, f"{base}/_totals/{job.name}", checkpoint, settings.metric_every,
            once, name=job.name, num_rows=job.num_rows,
        )
    refuse_changes(spark, checkpoint, plan)
    if job.table is None:
        return start_console(
            result, job.name, job.mode, settings.metric_every, job.num_rows, checkpoint, once
        )
    path = f"{base}/{job.table}"
    refuse_lost_checkpoint(spark, path, checkpoint)
    by_day = settings.by_day and not _is_flat(spark, path)
    return start_parquet(
        with_day(result, job.table) if by_day else result, path, checkpoint, job.name,
        settings.table_every, settings.table_files, [DAY] if by_day else [], once,
    )


def _is_flat(spark: SparkSession, path: str) -> bool:
    """A table keeps the layout it was begun with."""
    begun = any(name.endswith(".parquet") for name in folders.names(spark, path))
    return begun and not stored_days(spark, path)


def stop(queries: list[StreamingQuery]) -> None:
    """Stop the queries that still run; one that cannot be stopped does not keep the others.

    The first failure is raised at the end.
    """
    failures = []
    for query in queries:
        try:
            if query.isActive:
                query.stop()
        except Exception as failure:
            failures.append(failure)
    if failures:
        raise failures[0]


def run(spark: SparkSession, settings: Settings, raw: DataFrame | None = None) -> None:
    """Run until one query ends or fails, then stop the others and the session.

    Prints the schema of the parsed events first, and at the end what each query read, dropped
    as late and refused. A failure is raised to the caller.
    """
    queries: list[StreamingQuery] = []
    account = Account()
    try:
        spark.streams.addListener(account)
        spark.streams.resetTerminated()
        raw = _topics(spark, settings) if raw is None else raw
        parse_events(raw, settings.delay).printSchema()
        queries = start(spark, settings, raw)
        spark.streams.awaitAnyTermination()
    finally:
        try:
            stop(queries)
        finally:
            for name, sums in account.report().items():
                print(f"{name}: " + ", ".join(f"{number} {what}" for what, number in sums.items()))
            spark.stop()
