"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Where the session names none, a temporary one is made and set if the
    master is local (tests, a laptop); on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stowage-")
        spark.conf.set("spark.checkpoint.dir", base)
    return qualified(spark, base.rstrip("/"))


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI, so that tasks which open it by themselves reach the
    same store as Spark does."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return uri if "://" in uri else uri.replace("file:/", "file:///", 1)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of rows that a Python worker is handed, and holds, at a time (one row may be more).
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most, by
    `spark.sql.execution.arrow.maxBytesPerBatch` unless it is less already: a
    worker's memory then doesn't depend on the table's size or the rows'."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def stretches(sizes: Iterable[int], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of stretches of rows whose `sizes` come to `limit` at
    most together; a larger row is a stretch of its own."""
    start = end = total = 0
    for n in sizes:
        if end > start and total + n > limit:
            yield start, end - start
            start, total = end, 0
        end, total = end + 1, total + n
    if end > start:
        yield start, end - start


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: its lineage ends there,
    and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes the files of a table that `written` returned and that no result
    refers to any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
