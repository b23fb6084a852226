"""Parameter tables and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def average(df: DataFrame, group: str, vector: str) -> DataFrame:
    """The mean of each entry of a group's vectors: group, pos, mean. Partial sums are made before the shuffle."""
    e = df.select(group, F.posexplode(vector).alias("pos", "x"))
    return e.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def mismatched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two parameter tables has."""
    left, right = a.select(key).distinct().withColumn("__a", F.lit(True)), b.select(key).distinct().withColumn("__b", F.lit(True))
    return left.join(right, key, "full").where("__a is null or __b is null").select(key)
