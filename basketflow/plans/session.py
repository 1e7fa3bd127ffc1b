"""Session settings the library relies on."""

from pyspark.sql import SparkSession

# Aggregation state is kept in RocksDB, off the heap and on local disk, with change logs in
# the checkpoint folder: state without a watermark (views per product, ticket per user)
# grows with the number of keys. All stores of an executor, many when ten queries run side
# by side, share one memory budget (500 MB unless ``rocksdb.maxMemoryUsageMB`` says more).
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Read and bucket times in UTC, and set the state settings that are not set yet."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for key, value in STATE_SETTINGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def build_session(
    app_name: str = "basketflow", master: str | None = None, settings: dict | None = None
) -> SparkSession:
    """A session with the library's settings; those of spark-submit go before them.

    Master, executor sizes and ``spark.sql.shuffle.partitions`` are left to spark-submit.
    The latter also fixes the number of state partitions for the life of a checkpoint, so
    size it for the largest state the query will hold.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in (settings or {}).items():
        builder = builder.config(key, value)
    return apply_settings(builder.getOrCreate())
