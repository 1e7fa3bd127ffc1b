"""Small steps on shared folders, through the file system Spark itself uses."""

from uuid import uuid4

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _place(spark, path)
    return files.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies directly in a folder, in order; nothing where there is none."""
    return [name for name, _ in entries(spark, path)]


def entries(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names directly in a folder, in order, and when they were last changed (milliseconds)."""
    place, files = _place(spark, path)
    if not files.exists(place):
        return []
    return sorted((s.getPath().getName(), s.getModificationTime()) for s in files.listStatus(place))


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    place, files = _place(spark, path)
    return files.getContentSummary(place).getLength() if files.exists(place) else 0


def make(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.mkdirs(place)


def remove(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.delete(place, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The whole of a small file; None where there is none."""
    place, files = _place(spark, path)
    if not files.exists(place):
        return None
    opened = files.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
    finally:
        opened.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in place in one step: a reader sees the old one or the new one."""
    jvm = spark.sparkContext._jvm
    target, files = _place(spark, path)
    draft, _ = _place(spark, f"{target.getParent()}/_draft-{uuid4().hex}")
    out = files.create(draft, True)
    try:
        jvm.org.apache.commons.io.IOUtils.write(text, out, "UTF-8")
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        files.getUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, target, overwrite)
