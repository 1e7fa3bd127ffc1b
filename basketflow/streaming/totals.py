"""Keep running totals as partial results: a folder for each batch, merged now and then.

The stream has no state at all. A batch writes its partial rows, few as its own keys; a merge
adds up what has been written into one folder, and a pointer says which batches it holds.
"""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from basketflow import folders
from basketflow.operators.totals import Total
from basketflow.schema import EVENT_SCHEMA
from basketflow.streaming.sinks import _writer

_POINTER = "_merged"


def start_totals(
    events: DataFrame,
    total: Total,
    path: str,
    checkpoint: str,
    every: str = "10 seconds",
    once: bool = False,
    merge_every: int | None = 100,
    name: str | None = None,
    num_rows: int | None = None,
) -> StreamingQuery:
    """Write each batch's partial rows to a folder of its own; merge them every so many batches.

    With ``num_rows`` the first rows of the result so far are printed after each batch.

    A repeated batch writes its folder anew, so no event counts twice. Events need no watermark:
    late ones count, as in complete mode.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        merged = _merged(spark, path)
        if batch_id > merged["upto"]:  # else it has been merged, and is repeated now
            total.partial(batch).write.mode("overwrite").parquet(_batch(path, batch_id))
        if merge_every and (batch_id + 1) % merge_every == 0:
            merge_totals(spark, total, path, upto=batch_id)
        if num_rows is not None:
            print(f"{label}, batch {batch_id}")
            read_totals(spark, total, path).show(num_rows, truncate=False)

    label = name or total.name
    return _writer(events, "append", label, checkpoint, every, once).foreachBatch(write).start()


def merge_totals(spark: SparkSession, total: Total, path: str, upto: int | None = None) -> int:
    """Add up all batches so far into one folder; returns the last batch in it, -1 before any.

    The number of files and rows then depends on the keys, no longer on the number of batches.
    The folders that went into the one before are removed at the next merge, so that a reader
    has until then to finish.
    """
    merged = _merged(spark, path)
    batches = [n for n in _batches(spark, path) if n > merged["upto"] and (upto is None or n <= upto)]
    if not batches:
        return merged["upto"]
    folder = f"upto={batches[-1]:012d}"
    total.merged(_read(spark, total, _paths(path, merged, batches))).write.mode("overwrite").parquet(f"{path}/{folder}")
    pointer = {"upto": batches[-1], "folder": folder, "spent": [f"batch={n:012d}" for n in batches]}
    if merged["folder"]:
        pointer["spent"].append(merged["folder"])
    folders.replace_text(spark, f"{path}/{_POINTER}", json.dumps(pointer))
    for name in merged["spent"]:
        folders.remove(spark, f"{path}/{name}")
    return batches[-1]


def read_totals(spark: SparkSession, total: Total, path: str) -> DataFrame:
    """The public result over all batches that have been written; empty before any."""
    merged = _merged(spark, path)
    paths = _paths(path, merged, [n for n in _batches(spark, path) if n > merged["upto"]])
    return total.result(_read(spark, total, paths))


def _merged(spark: SparkSession, path: str) -> dict:
    found = folders.read_text(spark, f"{path}/{_POINTER}")
    return json.loads(found) if found else {"upto": -1, "folder": None, "spent": []}


def _batch(path: str, number: int) -> str:
    return f"{path}/batch={number:012d}"


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Batches whose folders are complete."""
    return [
        int(name.removeprefix("batch="))
        for name in folders.names(spark, path)
        if name.startswith("batch=") and folders.exists(spark, f"{path}/{name}/_SUCCESS")
    ]


def _paths(path: str, merged: dict, batches: list[int]) -> list[str]:
    found = [_batch(path, n) for n in batches]
    return found + ([f"{path}/{merged['folder']}"] if merged["folder"] else [])


def _read(spark: SparkSession, total: Total, paths: list[str]) -> DataFrame:
    schema = total.partial(spark.createDataFrame([], EVENT_SCHEMA)).schema
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
