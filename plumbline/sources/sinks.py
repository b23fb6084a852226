"""Sinks: staged rewrites, counted shards, files written once, reports and kept verdicts.

Paths may lie in any file system that Spark reaches; swaps are renames within one folder. No rows give an empty table.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def rewrite(df: DataFrame, path: str) -> None:
    """Replace the table at path by df, which may be read from it: written beside it, then swapped by renames; a failed write changes nothing."""
    spark, stamp = df.sparkSession, uuid.uuid4().hex
    new, old = f"{path.rstrip('/')}.new-{stamp}", f"{path.rstrip('/')}.old-{stamp}"
    df.write.parquet(new)
    target, fs = _path(spark, path)
    if fs.exists(target) and not fs.rename(target, _path(spark, old)[0]):
        raise OSError(f"{path} could not be moved away")
    if not fs.rename(_path(spark, new)[0], target):
        raise OSError(f"{new} could not take the place of {path}")
    fs.delete(_path(spark, old)[0], True)


def write_shards(df: DataFrame, path: str, key: str, shards: int) -> int:
    """df in numbered shards by a hash of key, with their counts beside them; returns the number of rows."""
    placed = df.withColumn("shard", F.pmod(F.xxhash64(F.col(key)), F.lit(shards)).cast("int"))
    placed.repartition(shards, "shard").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/data")
    written = df.sparkSession.read.schema(placed.schema).parquet(f"{path}/data").groupBy("shard").agg(F.count("*").alias("n"))
    written.coalesce(1).write.mode("overwrite").json(f"{path}/state")
    return sum(r.n for r in df.sparkSession.read.schema("shard int, n long").json(f"{path}/state").collect())  # a row for each shard


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards; an error if any holds other than the stated number of rows, or is missing."""
    data = spark.read.parquet(f"{path}/data")
    stated = spark.read.schema("shard int, n long").json(f"{path}/state")
    found = data.groupBy("shard").agg(F.count("*").alias("found"))
    wrong = stated.join(found, "shard", "full").where("not (n <=> found)").limit(5).collect()
    if wrong:
        raise ValueError(f"shards hold other numbers of rows than stated: {wrong}")
    return data


def write_files_once(df: DataFrame, path: str, name: str = "name", content: str = "content") -> DataFrame:
    """Binary content under its name, each name once and never again; returns name and bytes of what was added."""
    spark = df.sparkSession
    first = df.where(F.col(name).isNotNull() & F.col(content).isNotNull()).groupBy(name).agg(F.min(content).alias(content))
    try:
        known = spark.read.parquet(path).select(name)
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], f"`{name}` string")
    fresh = first.join(known, name, "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh.select(name, F.octet_length(content).alias("bytes"))


def write_report(summary: DataFrame, path: str) -> dict:
    """A table of one row as one JSON object in a file; returns it."""
    row = summary.limit(2).toJSON().collect()
    if len(row) != 1:
        raise ValueError("a report is made of exactly one row")
    spark = summary.sparkSession
    target, fs = _path(spark, path)
    out = fs.create(target, True)
    out.write(json.dumps(json.loads(row[0]), ensure_ascii=False, indent=2).encode())
    out.close()
    return json.loads(row[0])


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small table as Markdown, in the order it has; a larger one than most rows is refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    cell = lambda v: "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


VERDICT = "ts double, run string, all_pass boolean, gates string"


def keep_verdict(gates: DataFrame, path: str, run: str) -> DataFrame:
    """Append the verdict of gates (name, value, cmp, bar, passed); earlier ones stay. Returns all, latest first."""
    spark = gates.sparkSession
    row = gates.agg(  # a row for each gate
        F.bool_and("passed").alias("all_pass"),
        F.to_json(F.array_sort(F.collect_list(F.struct("name", "value", "cmp", "bar", "passed")))).alias("gates")
    )
    row.select(
        F.lit(time.time()).alias("ts"), F.lit(run).alias("run"), F.coalesce("all_pass", F.lit(True)).alias("all_pass"), "gates"
    ).write.mode("append").json(path)
    return spark.read.schema(VERDICT).json(path).orderBy(F.desc("ts"))
