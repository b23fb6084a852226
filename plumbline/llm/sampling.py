"""A sample that is the same on every run and only ever grows: stratified thresholds on a salted hash of the key.

A row_id is in the sample if the first 32 bits of sha256(salt | row_id) lie below its stratum's threshold. Rates are fixed
per stratum and do not depend on the data, so neither reruns, partitions nor new rows change the choice; a kept table of
thresholds is only ever raised, so earlier selections remain when rates change.

The stratum is the source named by the row_id, which redelivery cannot change. Null row_ids are left out, repeated ones count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import source_of

SALT = "stable-sample-1"
DEFAULT_RATE = 0.1
#: Small sources have higher rates. Part of the sampling plan, not fitted to any table.
RATES = {"fiscore": 0.5, "zhnli": 0.25, "nlipair": 0.25, "zhintent": 0.25, "zhsynth": 0.2, "moodtag": 0.2, "fieldlog": 0.2}
RANGE = 1 << 32


def key_hash(row_id, salt: str = SALT):
    """The first 32 bits of the salted hash."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt + "|"), row_id), 256), 1, 8), 16, 10).cast("long")


def raise_thresholds(kept: DataFrame | None, wanted: DataFrame) -> DataFrame:
    """stratum, threshold: of each stratum the larger one of both tables."""
    both = wanted.select("stratum", "threshold")
    if kept is not None:
        both = both.unionByName(kept.select("stratum", "threshold"))
    return both.groupBy("stratum").agg(F.max("threshold").alias("threshold"))


def thresholds(spark, rates: dict[str, float] = RATES) -> DataFrame:
    return spark.createDataFrame([(s, int(min(1.0, max(0.0, r)) * RANGE)) for s, r in rates.items()], "stratum string, threshold long")


def kept_thresholds(spark: SparkSession, path: str, rates: dict[str, float] = RATES) -> DataFrame:
    """The table of thresholds at path after raising it to the rates; a stratum whose rate was lowered keeps its threshold. Each call adds what it raised."""
    wanted = thresholds(spark, rates)
    try:
        kept = spark.read.schema("stratum string, threshold long").parquet(path)
    except Exception as e:  # the first call
        if "PATH_NOT_FOUND" not in str(e):
            raise
        kept = spark.createDataFrame([], "stratum string, threshold long")
    known = kept.groupBy("stratum").agg(F.max("threshold").alias("kept"))
    raised = wanted.join(known, "stratum", "left").where("kept is null or threshold > kept").select("stratum", "threshold")
    raised.coalesce(1).write.mode("append").parquet(path)
    return raise_thresholds(spark.read.schema("stratum string, threshold long").parquet(path), wanted)


def stable_sample(rows: DataFrame, kept: DataFrame | None = None, rates: dict[str, float] = RATES, default_rate: float = DEFAULT_RATE, salt: str = SALT) -> DataFrame:
    """row_id, stratum, key_hash, threshold. The table of thresholds has a row per stratum, so it is small."""
    table = raise_thresholds(kept, thresholds(rows.sparkSession, rates))
    hashed = rows.where("row_id is not null").select("row_id", source_of(F.col("row_id")).alias("stratum"), key_hash(F.col("row_id"), salt).alias("key_hash"))
    joined = hashed.join(table, "stratum", "left").withColumn("threshold", F.coalesce("threshold", F.lit(int(default_rate * RANGE))))
    return joined.where("key_hash < threshold").select("row_id", "stratum", "key_hash", "threshold").distinct()
