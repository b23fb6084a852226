"""Places for what a job writes between its steps, and bounds for what it broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_tables: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where it is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="plumbline-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the application ends, or by clear()."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(place)  # what isn't there yet can't be marked for deletion
    fs.deleteOnExit(place)
    _tables.append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete all that was written so far; results that have not been stored elsewhere can't be read any more. Returns how many tables."""
    n = len(_tables)
    while _tables:
        place = spark._jvm.org.apache.hadoop.fs.Path(_tables.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return n


def drop(spark: SparkSession, path: str) -> None:
    """Delete one of the tables before the application ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def setting(spark: SparkSession, **conf: str):
    """Settings of the session for the jobs that run within; names with _ for dots."""
    names = {k: k.replace("_", ".") for k in conf}
    before = {k: spark.conf.get(n, None) for k, n in names.items()}
    for k, n in names.items():
        spark.conf.set(n, conf[k])
    try:
        yield
    finally:
        for k, n in names.items():
            spark.conf.unset(n) if before[k] is None else spark.conf.set(n, before[k])


def shuffles_dropped(spark: SparkSession):
    """What the jobs within shuffle is deleted with their end, not when the driver happens to collect its garbage."""
    return setting(spark, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true")


def _write(df: DataFrame, path: str, mode: str, partition_by: tuple[str, ...] = (), **options: str) -> None:
    with shuffles_dropped(df.sparkSession):
        writer = df.write.mode(mode).options(compression="zstd", **options)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_to(df: DataFrame, path: str) -> None:
    """df appended to a kept table."""
    _write(df, path, "append")


def written(df: DataFrame, name: str, *partition_by: str, **options: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{fresh(spark, name)}/table"
    _write(df, path, "errorifexists", partition_by, **options)
    return spark.read.schema(df.schema).parquet(path)
