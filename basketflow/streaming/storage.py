"""Where checkpoints and intermediate tables go."""

import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where the setting is missing, a local master gets a temporary folder and any other
    master an error: a folder of one machine is lost with it.
    """
    root = spark.conf.get(_SETTING, None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="basketflow-")
    raise ValueError(f"{_SETTING} must name a folder that all executors share")


def refuse_lost_checkpoint(spark: SparkSession, table: str, checkpoint: str) -> None:
    """Raise if a stored table has a sink log but its checkpoint has no offsets.

    The sink would take the batches of the new checkpoint, counted from 0 again, for those it
    has already written, and silently leave them out.
    """
    jvm = spark.sparkContext._jvm
    configuration = spark.sparkContext._jsc.hadoopConfiguration()

    def filled(path: str) -> bool:
        place = jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(configuration)
        return files.exists(place) and len(files.listStatus(place)) > 0

    if filled(f"{table}/_spark_metadata") and not filled(f"{checkpoint}/offsets"):
        raise ValueError(
            f"table {table} was written by a stream whose checkpoint is not {checkpoint};"
            " give that stream's checkpoint or another table"
        )


def workspace(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_root(spark)}/basketflow/{label}-{uuid4().hex}"
