"""Every operator as a query over the test tables: ``name -> f(spark, sf_dir)``."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from basketflow import operators as op
from basketflow.plans.retail_view import retail_view
from basketflow.plans.session import apply_settings
from basketflow.operators import totals
from basketflow.operators.totals import Total
from basketflow.schema import DAY, table_schema
from basketflow.sources import (
    encode_events, parse_events, read_events_files, read_newest_day, read_result, with_day,
    with_event_time,
)
from basketflow.streaming import (
    Account, compact, merge_totals, read_rejected, read_snapshot, read_totals, start_landing, start_parquet,
    start_snapshot, start_totals, stream_landed, workspace,
)

Query = Callable[[SparkSession, str], DataFrame]

# In the test data a minute, category and city never see more than ten events; a day does.
_PEAK_WIDTH = "1 day"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = apply_settings(spark).read.parquet(f"{sf_dir}/events.parquet")
    return with_event_time(retail_view(table))


def _retail_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A glob, because a streaming source takes the path of a folder but not of a file. All
    # files go into one batch: they are not in the order of event time, and with a cap the
    # rows of later files would come late.
    schema = apply_settings(spark).read.parquet(f"{sf_dir}/events.parquet").schema
    return retail_view(spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet"))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_event_time(_retail_stream(spark, sf_dir))


def _plain(frame: DataFrame) -> DataFrame:
    """Timestamps without a zone, the type the SQL side yields."""
    stamps = [f.name for f in frame.schema if isinstance(f.dataType, TimestampType)]
    return frame.withColumns({name: F.col(name).cast("timestamp_ntz") for name in stamps})


def _batch(operator: Callable[..., DataFrame], **arguments) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plain(operator(_events(spark, sf_dir), **arguments))

    return query


def _stream_complete(operator: Callable[..., DataFrame], **arguments) -> Query:
    """The operator over a stream of the table, run to its end, in complete mode."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = operator(_event_stream(spark, sf_dir), **arguments)
        place = workspace(spark, operator.__name__)
        name = f"{operator.__name__}_complete"
        run = start_snapshot(result, f"{place}/table", f"{place}/checkpoint", name, once=True)
        run.awaitTermination()
        return _plain(read_snapshot(spark, f"{place}/table", result.schema))

    return query


def _closed_windows(spark: SparkSession, result: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream to its end; the Parquet table it leaves."""
    place = workspace(spark, name)
    run = start_parquet(result, f"{place}/table", f"{place}/checkpoint", name, once=True)
    run.awaitTermination()
    return _plain(spark.read.schema(result.schema).parquet(f"{place}/table"))


def _stream_append(operator: Callable[..., DataFrame], **arguments) -> Query:
    """The operator over a stream of the table, its closed windows kept as Parquet."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = operator(_event_stream(spark, sf_dir), **arguments)
        return _closed_windows(spark, result, f"{operator.__name__}_append")

    return query


def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON text and parsed again, the location flattened."""
    raw = encode_events(_events(spark, sf_dir))
    return _plain(parse_events(raw).select("*", "location.*").drop("location"))


def sales_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales per minute from JSON text, of which only the needed fields are parsed."""
    raw = encode_events(_events(spark, sf_dir))
    return _plain(op.sales_per_minute(parse_events(raw, fields=op.sales_per_minute.fields)))


def stream_sales_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored sales table from a stream of JSON text."""
    raw = encode_events(_retail_stream(spark, sf_dir))
    events = parse_events(raw, fields=op.sales_per_minute.fields)
    sales = op.sales_per_minute(events, ordered=False)
    return _closed_windows(spark, sales, "sales_from_json_append")


def _resumed(operator: Callable[..., DataFrame], slices: list[str]) -> Query:
    """The operator over JSON files that arrive in slices, its closed windows kept as Parquet.

    ``slices`` are predicates over the table, with ``share`` for the place of a row's time
    between the first and the last, 0 to 1000. For each the stream is started anew on the same
    checkpoint and ends, so state is carried over restarts and dropped as windows close.
    """

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = apply_settings(spark).read.parquet(f"{sf_dir}/events.parquet")
        seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
        first, last = table.agg(F.min(seconds), F.max(seconds)).first()
        share = F.floor((seconds - F.lit(first)) * 1000 / F.lit(max(1, last - first)))
        placed = table.withColumn("share", share)
        place = workspace(spark, f"{operator.__name__}-resumed")
        for number, rows in enumerate(slices):
            events = retail_view(placed.where(rows).drop("share"))
            encode_events(events).write.text(f"{place}/landing/slice-{number:03d}")
            arrived = read_events_files(spark, f"{place}/landing/slice-*")
            result = operator(parse_events(arrived, fields=operator.fields))
            name = f"{operator.__name__}_resumed"
            run = start_parquet(result, f"{place}/table", f"{place}/checkpoint", name, once=True)
            run.awaitTermination()
        return _plain(spark.read.schema(result.schema).parquet(f"{place}/table"))

    return query


# In the order of time; and with every tenth row of the first half after the second half.
_IN_ORDER = [f"share DIV 251 = {n}" for n in range(4)]
_LATE = ["share < 500 AND event_id % 10 <> 0", "share >= 500", "share < 500 AND event_id % 10 = 0"]


def sales_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = op.sales_per_minute(_events(spark, sf_dir), ordered=False)
    return _plain(op.sales_series(sales))


def latest_category_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The report reads its table twice, so the table is written first and the events are
    # scanned once.
    path = f"{workspace(spark, 'categories')}/table"
    op.aggregate_by_category(_events(spark, sf_dir)).write.parquet(path)
    return op.latest_category_activity(read_result(spark, path, "categories"))


def user_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.user_behaviour(op.aggregate_by_user(_events(spark, sf_dir)))


def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.top_products(op.aggregate_by_product(_events(spark, sf_dir)))


def _stored_by_day(spark: SparkSession, sf_dir: str, operator: Callable, table: str) -> str:
    """The stream of closed windows as a table laid out by day, with its mergeable columns."""
    place = workspace(spark, f"{operator.__name__}-by-day")
    result = with_day(operator(_event_stream(spark, sf_dir), parts=True), table)
    name = f"{operator.__name__}_by_day"
    run = start_parquet(
        result, f"{place}/table", f"{place}/checkpoint", name, partition_by=[DAY], once=True
    )
    run.awaitTermination()
    return f"{place}/table"


def latest_category_activity_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest window, of whose table only the newest day is read."""
    path = f"{workspace(spark, 'categories')}/table"
    categories = op.aggregate_by_category(_events(spark, sf_dir))
    with_day(categories, "categories").write.partitionBy(DAY).parquet(path)
    return op.latest_category_activity(read_newest_day(spark, path, "categories"))


def _coarser(operator: Callable, table: str, *widths: str) -> Query:
    """Hours or days from the stored five minutes, step by step, and not from the events."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{workspace(spark, table)}/table"
        operator(_events(spark, sf_dir), parts=True).write.parquet(path)
        found = read_result(spark, path, table, parts=True)
        for width in widths:
            found = op.coarsen(found, table, width, parts=True)
        return _plain(found.select(table_schema(table).names))

    return query


def stored_sales_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales over time from a stored stream, its closed days compacted."""
    place = workspace(spark, "sales-by-day")
    sales = op.sales_per_minute(_event_stream(spark, sf_dir), ordered=False)
    run = start_parquet(
        with_day(sales, "sales_per_minute"), f"{place}/table", f"{place}/checkpoint",
        "sales_by_day", partition_by=[DAY], once=True,
    )
    run.awaitTermination()
    compact(spark, f"{place}/table", "sales_per_minute")
    return _plain(op.sales_series(read_result(spark, f"{place}/table", "sales_per_minute")))


def stored_user_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _stored_by_day(spark, sf_dir, op.aggregate_by_user, "users")
    compact(spark, path, "users")
    return op.user_behaviour(read_result(spark, path, "users"))


def stored_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _stored_by_day(spark, sf_dir, op.aggregate_by_product, "products")
    return op.top_products(read_result(spark, path, "products"))


def stored_days_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from a stored stream of five minutes, closed days compacted first."""
    path = _stored_by_day(spark, sf_dir, op.aggregate_by_category, "categories")
    compact(spark, path, "categories")
    days = op.coarsen(read_result(spark, path, "categories", parts=True), "categories", "1 day")
    return _plain(days)


def _landing(spark: SparkSession, sf_dir: str, raw: DataFrame) -> str:
    place = workspace(spark, "landing")
    start_landing(raw, f"{place}/table", f"{place}/checkpoint", once=True).awaitTermination()
    return f"{place}/table"


def _landed(operator: Callable[..., DataFrame], **arguments) -> Query:
    """The operator as a stream over the landed table of one ingest of JSON text."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _landing(spark, sf_dir, encode_events(_retail_stream(spark, sf_dir)))
        events = stream_landed(spark, path, fields=operator.fields)
        return _closed_windows(spark, operator(events, **arguments), f"{operator.__name__}_landed")

    return query


def _torn(events: DataFrame) -> DataFrame:
    """Events as text, those of stores that end in 7 without a time, those in 3 cut short."""
    odd = events.withColumn("timestamp", F.when(~F.col("store_id").endswith("7"), F.col("timestamp")))
    event = F.struct(*[F.col(name) for name in events.columns])
    text = F.to_json(event, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    cut = F.left("value", F.length("value") - 1)
    torn = F.when(F.col("store_id").endswith("3"), cut).otherwise(F.col("value"))
    return odd.select("store_id", text.alias("value")).select(torn.alias("value"))


def landed_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused records by reason, where a tenth of the texts is torn and a tenth has no time."""
    refused = read_rejected(spark, _landing(spark, sf_dir, _torn(_retail_stream(spark, sf_dir))))
    return refused.groupBy("reason").agg(F.count("*").alias("records"))


def _running(total: Total) -> Query:
    """A running total from partial results of four batches, two of them merged."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        place = workspace(spark, total.name)
        table = apply_settings(spark).read.parquet(f"{sf_dir}/events.parquet")
        for number in range(4):
            retail_view(table.where(F.col("event_id") % 4 == number)).write.parquet(f"{place}/landing/slice-{number}")
            arrived = spark.readStream.schema(retail_view(table).schema).parquet(f"{place}/landing/slice-*")
            run = start_totals(
                arrived, total, f"{place}/table", f"{place}/checkpoint", once=True, merge_every=None
            )
            run.awaitTermination()
            if number == 1:
                merge_totals(spark, total, f"{place}/table")
        return _plain(read_totals(spark, total, f"{place}/table"))

    return query


def binary_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed from bytes, as topics hold them."""
    raw = encode_events(_events(spark, sf_dir)).select(F.col("value").cast("binary"))
    return _plain(parse_events(raw).select("*", "location.*").drop("location"))


def _application(spark: SparkSession, sf_dir: str, **settings) -> tuple[str, list]:
    """The whole application over the events as JSON text, run to their end."""
    from basketflow.plans.application import Settings, start

    base = workspace(spark, "application")
    raw = encode_events(_retail_stream(spark, sf_dir))
    queries = start(spark, Settings(base, **settings), raw, once=True)
    for query in queries:
        query.awaitTermination()
    return base, queries


def _application_table(table: str, **settings) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        base, _ = _application(spark, sf_dir, **settings)
        return _plain(read_result(spark, f"{base}/{table}", table))

    return query


def application_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What runs, by name, and how many records each query has read."""
    _, queries = _application(spark, sf_dir)
    rows = [(q.name, sum(p["numInputRows"] for p in q.recentProgress)) for q in queries]
    return spark.createDataFrame(rows, "name string, input_rows long")


def landing_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records taken in and refused, as the progress reports of one ingest add up."""
    account = Account.open(spark)
    try:
        place = workspace(spark, "account")
        run = start_landing(
            _torn(_retail_stream(spark, sf_dir)), f"{place}/table", f"{place}/checkpoint", "account", once=True
        )
        run.awaitTermination()
        account.settle([run])
    finally:
        account.close(spark)
    found = account.report()["account"]
    names = ["records", "no_object", "no_time"]
    return spark.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} long" for n in names))


def all_queries() -> dict[str, Query]:
    """The catalog; see :func:`basketflow.plans.oracles.all_oracles` for the same in SQL."""
    return {
        "parse_events": parsed_events,
        "sales_from_json": sales_from_json,
        "sales_per_minute": _batch(op.sales_per_minute),
        "top_viewed_products": _batch(op.top_viewed_products),
        "average_ticket_per_user": _batch(op.average_ticket_per_user),
        "conversion_rate": _batch(op.conversion_rate),
        "visits_by_category": _batch(op.visits_by_category),
        "demand_peaks": _batch(op.demand_peaks, width=_PEAK_WIDTH),
        "demand_peaks_per_minute": _batch(op.demand_peaks, threshold=1),
        "aggregate_by_user": _batch(op.aggregate_by_user),
        "aggregate_by_category": _batch(op.aggregate_by_category),
        "aggregate_by_product": _batch(op.aggregate_by_product),
        "sales_series": sales_series,
        "latest_category_activity": latest_category_activity,
        "user_behaviour": user_behaviour,
        "top_products": top_products,
        "stream_sales_per_minute": _stream_complete(op.sales_per_minute, ordered=False),
        "stream_top_viewed_products": _stream_complete(op.top_viewed_products),
        "stream_average_ticket_per_user": _stream_complete(
            op.average_ticket_per_user, ordered=False
        ),
        "stream_conversion_rate": _stream_complete(op.conversion_rate, ordered=False),
        "stream_visits_by_category": _stream_complete(op.visits_by_category),
        "stream_demand_peaks": _stream_append(op.demand_peaks, width=_PEAK_WIDTH),
        "stream_aggregate_by_user": _stream_append(op.aggregate_by_user),
        "stream_aggregate_by_category": _stream_append(op.aggregate_by_category),
        "stream_aggregate_by_product": _stream_append(op.aggregate_by_product),
        "stream_visits_by_category_append": _stream_append(
            op.visits_by_category, time_col="event_time"
        ),
        "stream_sales_table": _stream_append(op.sales_per_minute, ordered=False),
        "stream_sales_from_json": stream_sales_from_json,
        "stream_resumed_by_user": _resumed(op.aggregate_by_user, _IN_ORDER),
        "stream_resumed_by_product": _resumed(op.aggregate_by_product, _IN_ORDER),
        "stream_late_by_category": _resumed(op.aggregate_by_category, _LATE),
        "latest_category_activity_by_day": latest_category_activity_by_day,
        "hours_by_user": _coarser(op.aggregate_by_user, "users", "1 hour"),
        "days_by_category": _coarser(op.aggregate_by_category, "categories", "1 hour", "1 day"),
        "hours_by_product": _coarser(op.aggregate_by_product, "products", "30 minutes", "1 hour"),
        "stored_sales_series": stored_sales_series,
        "stored_user_behaviour": stored_user_behaviour,
        "stored_top_products": stored_top_products,
        "stored_days_by_category": stored_days_by_category,
        "landed_by_user": _landed(op.aggregate_by_user),
        "landed_by_product": _landed(op.aggregate_by_product),
        "landed_demand_peaks": _landed(op.demand_peaks, width=_PEAK_WIDTH),
        "landed_rejected": landed_rejected,
        "landing_account": landing_account,
        "binary_events": binary_events,
        "application_products": _application_table("products"),
        "application_users_with_landing": _application_table("users", landing=True, running_totals=True, parts=True),
        "application_queries": application_queries,
        "running_top_viewed_products": _running(totals.views_per_product()),
        "running_average_ticket_per_user": _running(totals.ticket_per_user(ordered=False)),
        "running_visits_by_category": _running(totals.visits_per_category()),
    }
