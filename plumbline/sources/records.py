"""Reading and writing record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "row_id string, primitive string, state string, instructions string, criteria string, label int, meta struct<options: array<string>, attribute: string, family: string, level: string, genre: string>, source string, split string"
PASS = "row_id string, qtype string, kind string, key string, pos int, target double, weight double, gold double, soft double, text string"
SOFT = "row_id string, p double, std double, weight double, k_ok int"


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str | T.StructType, torn: str = "FAILFAST") -> DataFrame:
    """One JSON object a line, blank lines skipped; torn='DROPMALFORMED' skips broken lines. No file at all is an error."""
    df = spark.read.schema(schema).option("mode", torn).json(paths)
    if not df.inputFiles():
        raise FileNotFoundError(f"nothing matches {paths}")
    return df


def with_ordinals(tables: list[DataFrame]) -> DataFrame:
    """Tables of equal columns one after another, each row with the number of its table; none at all is an error."""
    if not tables:
        raise FileNotFoundError("no tables to put together")
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn("ordinal", F.lit(i))
        out = t if out is None else out.unionByName(t, True)
    return out


def read_maps(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files that hold one JSON object each, as rows (key, value as JSON text); of equal keys that of the last file holds."""
    files = [spark.read.option("wholetext", True).text(p).select(F.explode(F.from_json("value", "map<string,variant>"))) for p in paths]
    return last_wins(with_ordinals([f.select("key", F.to_json("value").alias("value")) for f in files]), ["key"], "ordinal").drop("ordinal")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def last_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key: the last in the given order; nulls in order come first. One shuffle, aggregated before it."""
    others = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__last"))
    return picked.select(*keys, *[F.col("__last")[c].alias(c) for c in others]).select(*df.columns)


def first_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__first"))
    return picked.select(*keys, *[F.col("__first")[c].alias(c) for c in others]).select(*df.columns)


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in order; 0 stands for all."""
    return df.orderBy(order).limit(n) if n else df


def not_yet(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are not in done; null keys are equal (to resume an append)."""
    done = done.select(*keys).distinct()
    condition = None
    for k in keys:
        c = df[k].eqNullSafe(done[k])
        condition = c if condition is None else condition & c
    return df.join(done, condition, "left_anti")


def append_new(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append to a parquet folder what it lacks; returns what was appended."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path)
    except Exception as e:  # no such folder yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = spark.createDataFrame([], df.schema)
    fresh = not_yet(df, done, keys)
    fresh.write.mode("append").parquet(path)
    return fresh


def source_name(row_id):
    """The source a row belongs to, from its id."""
    return F.regexp_replace(row_id, "-[0-9]+$", "")
