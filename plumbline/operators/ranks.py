"""Ranks over all rows without one task for all: rows go to ordered buckets with fixed bounds, counts of buckets give offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Values taken to find the bounds; the bounds are at most the number of shuffle partitions.
SAMPLE = 20_000


def bucket(df: DataFrame, order: str) -> Column:
    """The ordered bucket of a value. The bounds are literals, so every use of the expression agrees, whatever is computed again."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = df.count()
    some = df.select(order).where(F.col(order).isNotNull())
    values = sorted(r[0] for r in (some.sample(min(1.0, SAMPLE / total), seed=3) if total > SAMPLE else some).collect())
    bounds = sorted({values[i * len(values) // n] for i in range(1, n)}) if values else []
    if not bounds:
        return F.lit(0)
    array = F.array(*[F.lit(b) for b in bounds])
    return F.when(F.col(order).isNull(), -1).otherwise(F.size(F.filter(array, lambda b: F.col(order) >= b)))


def dense(df: DataFrame, order: str, name: str, *by: str) -> DataFrame:
    """Numbers 0, 1, 2, ... in order, nulls first, over all rows or within groups (a null group is one)."""
    placed = df.withColumn("__bucket", bucket(df, order))
    counts = placed.groupBy(*[F.col(b).alias(f"__{b}") for b in by], F.col("__bucket").alias("__b")).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*([f"__{b}" for b in by] or [F.lit(0)])).orderBy("__b")  # a row per bucket
    before = counts.select(*[f"__{b}" for b in by], "__b", (F.sum("__c").over(w) - F.col("__c")).alias("__before"))
    local = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy(order)) - 1
    condition = F.col("__bucket") == F.col("__b")
    for b in by:
        condition = condition & F.col(b).eqNullSafe(F.col(f"__{b}"))
    return placed.withColumn("__local", local).join(before, condition).withColumn(
        name, (F.col("__local") + F.col("__before")).cast("long")
    ).select(*df.columns, name)


def nearest(df: DataFrame, value: str, q: float, *by: str) -> DataFrame:
    """The entry at place floor(n q) of the sorted values of each group, without interpolation. Null values are left out.

    Equal values are counted first; then only the bucket that holds the place is sorted.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    placed = counts.withColumn("__bucket", bucket(df.select(value), value))
    sums = placed.groupBy(*by, "__bucket").agg(F.sum("__c").alias("__s"))
    w = Window.partitionBy(*(by or [F.lit(0)]))  # a row per bucket
    sums = sums.withColumn(
        "__upto", F.sum("__s").over(w.orderBy("__bucket"))
    ).withColumn("__n", F.sum("__s").over(w)).withColumn("__at", F.floor(F.col("__n") * q))
    hit = sums.where((F.col("__upto") > F.col("__at")) & (F.col("__upto") - F.col("__s") <= F.col("__at"))).select(
        *[F.col(b).alias(f"__{b}") for b in by], F.col("__bucket").alias("__b"), (F.col("__upto") - F.col("__s")).alias("__before"), "__at"
    )
    condition = F.col("__bucket") == F.col("__b")
    for b in by:
        condition = condition & F.col(b).eqNullSafe(F.col(f"__{b}"))
    rest = placed.join(hit, condition)
    rest = rest.withColumn("__upto", F.col("__before") + F.sum("__c").over(w.orderBy(value)))
    return rest.where((F.col("__upto") > F.col("__at")) & (F.col("__upto") - F.col("__c") <= F.col("__at"))).select(*by, value)
