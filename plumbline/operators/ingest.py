"""Shaping labelled sources into rows: filters, deduplication, dense numbers, unpivoting, replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import hashing

from . import ranks


def distinct_first(df: DataFrame, text: str, order: str) -> DataFrame:
    """Trimmed, non-empty texts, of equal ones the first in order; columns order and text."""
    cleaned = df.select(F.col(order), F.trim(text).alias(text)).where(F.col(text) != "")
    return cleaned.groupBy(text).agg(F.min(order).alias(order)).select(order, text)


def dense_numbers(df: DataFrame, order: str, name: str, group: str | None = None) -> DataFrame:
    """Numbers 0, 1, 2, ... in order, within groups or over all rows: by buckets and their offsets, so neither all rows nor a large group is one task."""
    return ranks.dense(df, order, name, *([group] if group else []))


def first_n_per_group(df: DataFrame, group: str, order: str | list[Column], n: int) -> DataFrame:
    """The first n rows of each group. Large groups are cut down in salted parts before one window ends it."""
    order = [F.col(order)] if isinstance(order, str) else order
    salt = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in df.columns]), F.lit(64))
    partial = df.withColumn("__salt", salt).withColumn(
        "__rn", F.row_number().over(Window.partitionBy(group, "__salt").orderBy(*order))
    ).where(F.col("__rn") <= n)
    return partial.withColumn("__rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__rn") <= n).drop("__salt", "__rn")


def unpivot(df: DataFrame, keys: list[str], values: list[str], name: str = "attribute", value: str = "value") -> DataFrame:
    """A row for each value that is not null."""
    return df.unpivot(keys, values, name, value).where(F.col(value).isNotNull())


def oversample(df: DataFrame, times: Column) -> DataFrame:
    """Each row so many times, numbered from 1; none for null or less than 1."""
    return df.withColumn("copy", F.explode(F.when(times >= 1, F.sequence(F.lit(1), times.cast("int"))).otherwise(F.array().cast("array<int>"))))


def split(df: DataFrame, frac: int = 10, id_col: str = "row_id") -> DataFrame:
    return df.withColumn("is_val", hashing.is_val(F.col(id_col), frac))


def shuffled(df: DataFrame, seed: str, *keys: str) -> DataFrame:
    """In an order that depends on seed and keys alone."""
    return df.withColumn("rank", hashing.content_hash(F.lit(seed), *map(F.col, keys))).orderBy("rank")


def equal_chunks(df: DataFrame, order: str, size: int, name: str = "chunk") -> DataFrame:
    return dense_numbers(df, order, "__n").withColumn(name, F.floor(F.col("__n") / size)).drop("__n")
