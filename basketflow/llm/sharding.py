"""Contiguous shards of nearly equal bytes."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketflow.llm.common import saved

#: Bytes a row costs besides its text.
ROW_BYTES = 8


def shard_by_bytes(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
    partitions: int | None = None,
) -> DataFrame:
    """Give every row a shard so that shards are contiguous in ``id_col`` and near equal in bytes.

    Only (id, size, checksum) of a row is shuffled, never its text. Rows are dealt out by
    range, each partition adds up its sizes, and the exclusive prefix sums of the partition
    totals turn positions within a partition into positions in the whole table. A row goes to
    the shard in which the middle of its byte range falls, so a shard is off its target by
    one row at most.

    Returns ``doc_id, size, text_crc32, shard, slot``: size is the UTF-8 length plus
    ``ROW_BYTES``, slot counts from 0 without gaps within a shard.

    Null texts count as empty; null ids come first. Repeated ids and rows are kept, in the
    order of checksum and size; equal rows are interchangeable. A frequent id is split over
    partitions, since ranges go by the read order last. An empty table gives an empty result,
    fewer rows than shards leave shards empty. Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("read_order"),
    )
    order = ["doc_id", "text_crc32", "size", "read_order"]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written, because a range partitioning that is computed twice samples twice.
    ranged = saved(
        narrow.repartitionByRange(n, *order)
        .withColumn("part", F.spark_partition_id())
        .sortWithinPartitions(*order),
        "shards",
    )
    # One row for each partition: small enough for a single task at any size of the table.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ranged.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.sum("bytes").over(Window.partitionBy()).alias("bytes_all"),
        )
    )
    within = Window.partitionBy("part").orderBy(*order)
    placed = (
        ranged.join(F.broadcast(totals), "part")
        .withColumn("end", F.col("bytes_before") + F.sum("size").over(within))
        .withColumn("middle2", 2 * F.col("end") - F.col("size"))  # twice, to stay integral
        .withColumn(
            "shard",
            F.expr(f"cast(least({shards - 1}, (middle2 * {shards}) div (2 * bytes_all)) AS int)"),
        )
    )
    placed = placed.withColumn(
        "rank", F.row_number().over(Window.partitionBy("part", "shard").orderBy(*order)) - 1
    )
    # Rows that earlier partitions put into the same shard: partitions and shards both ascend,
    # so this has at most partitions + shards rows.
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("part", "shard")
        .count()
        .select("part", "shard", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("first"))
    )
    return placed.join(F.broadcast(starts), ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("first") + F.col("rank")).cast("long").alias("slot"),
    )
