"""The queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding, history, leaks, mixture, overlap, packing, sampling, sentences, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(table(spark, sf_dir, "passes"), table(spark, sf_dir, "mix_targets"))


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.shares(table(spark, sf_dir, "passes"), table(spark, sf_dir, "mix_targets"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.repeated_feedback(table(spark, sf_dir, "feedback_records"))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "passes"), table(spark, sf_dir, "documents"))


def p3_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_totals(p3_counts(spark, sf_dir))


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stable_sample(table(spark, sf_dir, "row_examples"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.item_leaks(table(spark, sf_dir, "eval_items"), table(spark, sf_dir, "row_examples"), table(spark, sf_dir, "passes"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.split_overlaps(table(spark, sf_dir, "row_examples"), table(spark, sf_dir, "passes"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split and per source of either side."""
    rows = table(spark, sf_dir, "row_examples").where("row_id is not null").groupBy("row_id").agg(F.max("split").alias("split"))
    rows = rows.select("row_id", "split", tokens.source_of(F.col("row_id")).alias("source"))
    pairs = p6_found(spark, sf_dir)
    for x in "ab":
        pairs = pairs.join(
            rows.select(F.col("row_id").alias(f"row_id_{x}"), F.col("split").alias(f"split_{x}"), F.col("source").alias(f"source_{x}")), f"row_id_{x}"
        )
    first = F.col("split_a") != "train"
    pick = lambda c, ev: F.when(first if ev else ~first, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
    pairs = pairs.select(
        pick("split", True).alias("eval_split"), pick("source", True).alias("eval_source"), pick("source", False).alias("train_source"),
        pick("row_id", True).alias("ev"), pick("row_id", False).alias("tr")
    )
    return pairs.groupBy("eval_split", "eval_source", "train_source").agg(
        F.count("*").alias("pairs"), F.count_distinct("ev").alias("eval_rows"), F.count_distinct("tr").alias("train_rows")
    )


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_containers(packing.document_sizes(table(spark, sf_dir, "documents")), table(spark, sf_dir, "window_sizes"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, sf_dir), table(spark, sf_dir, "window_sizes"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        f.__name__: f for f in (
            p1_mixture, p1_shares, p2_found, p3_counts, p3_totals, p4_sample, p5_found, p6_found, p6_report, p7_ids, p8_containers, p8_fill, p9_found
        )
    }


def oracle_sql() -> dict[str, str]:
    rates = ", ".join(f"('{s}', {int(r * sampling.RANGE)})" for s, r in sampling.RATES.items())
    return {
        "p4_sample": f"""
            with t(stratum, threshold) as (values {rates}),
            h as (select distinct row_id, regexp_replace(row_id, '-[0-9]+$', '') as stratum,
                  cast(cast('0x' || substr(sha256('{sampling.SALT}|' || row_id), 1, 8) as ubigint) as bigint) as key_hash
                  from row_examples where row_id is not null)
            select row_id, h.stratum, key_hash, cast(coalesce(t.threshold, {int(sampling.DEFAULT_RATE * sampling.RANGE)}) as bigint) as threshold
            from h left join t on h.stratum = t.stratum
            where key_hash < coalesce(t.threshold, {int(sampling.DEFAULT_RATE * sampling.RANGE)})""",
    }
