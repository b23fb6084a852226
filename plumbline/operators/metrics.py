"""Evaluation: reliability, calibration error, accuracy, ranks, composite scores. Null inputs are left out by callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bin_of(p: Column, bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.floor(p * bins).cast("int"))


def reliability(df: DataFrame, p: str, t: str, bins: int, *by: str) -> DataFrame:
    """Per non-empty bin: mean probability, mean target, count."""
    return df.where(F.col(p).isNotNull() & F.col(t).isNotNull()).groupBy(*by, bin_of(F.col(p), bins).alias("bin")).agg(
        F.avg(p).alias("conf"), F.avg(t).alias("freq"), F.count("*").alias("n")
    )


def ece(df: DataFrame, p: str, t: str, bins: int, *by: str) -> DataFrame:
    """Expected calibration error, over all or by columns; soft targets allowed. No rows give null (or no group)."""
    r = reliability(df, p, t, bins, *by)
    return r.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("freq"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


# Fixed values of the benchmark's axes: what chance reaches per tier, and the tiers' weights.
CHANCE = {"easy": 0.2840277778, "standard": 0.3166666667, "hard": 0.3364393939}
TIER_WEIGHT = {"easy": 0.14, "standard": 0.28, "hard": 0.30}


def composite(df: DataFrame) -> DataFrame:
    """Axes and composite of rows with easy, standard, hard (accuracies), ece, p50, p95 (seconds) and usd_per_1k."""
    tier = lambda k: 100 * (F.col(k) - CHANCE[k]) / (1 - CHANCE[k])
    intelligence = sum((tier(k) * w for k, w in TIER_WEIGHT.items()), F.lit(0.0)) / sum(TIER_WEIGHT.values())
    out = df.withColumn("intelligence", intelligence).withColumn("calibration", 100 * (1 - 2 * F.col("ece")))
    out = out.withColumn("speed", 80 - 10 * (F.log10(2 * F.col("p50")) + F.log10(2 * F.col("p95")))).withColumn("cost", 10 - 30 * F.log10("usd_per_1k"))
    low = F.least(F.lit(1.0), F.pow(F.col("intelligence") / 50, F.lit(2.0)))
    axes = [F.col(c) for c in ("intelligence", "calibration", "speed", "cost")]
    mean = F.pow(axes[0] * axes[1] * axes[2] * axes[3], F.lit(0.25)) * low
    return out.withColumn("composite", F.when(F.least(*axes) > 0, mean))  # an axis at or below 0 leaves no geometric mean


def running_drop(df: DataFrame, group: str, step: str, acc: str, most: float = 0.10) -> DataFrame:
    """Each step with the best accuracy of its slice so far, and whether it fell by more than most."""
    w = Window.partitionBy(group).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("best", F.max(acc).over(w)).withColumn("abort", F.col("best") - F.col(acc) > most)


def verdicts(measured: DataFrame, gates: DataFrame) -> DataFrame:
    """Each gate (name, cmp, bar) with what was measured and whether it passed; an unmeasured gate passes only if optional."""
    j = gates.join(measured, "name", "left")
    ok = F.when(F.col("cmp") == ">=", F.col("value") >= F.col("bar")).otherwise(F.col("value") <= F.col("bar"))
    return j.withColumn("passed", F.coalesce(ok, F.lit(False)))
