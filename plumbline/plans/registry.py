"""Queries by name, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import hashing
from plumbline.sources import records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a table reader under its own name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def latest_rows(t) -> DataFrame:
    return records.last_wins(t("row_examples"), ["row_id"], "ingested_at", "snapshot_no")


def latest_passes(t) -> DataFrame:
    return records.last_wins(t("passes").drop("text"), ["row_id", "kind", "key"], "expanded_at")


def scored(t) -> DataFrame:
    """The passes with a number u from their content hash and the score z made of it."""
    return latest_passes(t).withColumn("u", hashing.unit(F.lit("demo"), "row_id", "kind", "key")).withColumn("z", (F.col("u") - 0.5) * 8)


def grouped(t) -> DataFrame:
    """Per choice or score row: keys, scores, second scores and targets in the order of their places, and the gold place (-1 if none)."""
    s = scored(t).where("qtype <> 'noul'").withColumn("v", hashing.unit(F.lit("second"), "row_id", "kind", "key"))
    g = s.groupBy("row_id", "qtype").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "z", "v", "target", "weight"))).alias("x"))
    return g.select(
        "row_id", "qtype", F.col("x.key").alias("keys"), F.col("x.z").alias("z"), F.transform("x.v", lambda v: (v - 0.5) * 6).alias("y"),
        F.col("x.target").alias("t"), (F.array_position("x.target", 1.0) - 1).cast("int").alias("gold")
    )


ROWS = """rows_ as (select * exclude (rn) from (select *, row_number() over (partition by row_id order by ingested_at desc, snapshot_no desc) as rn from row_examples) where rn = 1)"""


def unit_sql(*parts: str) -> str:
    """A number from 0 to 1 from the first 64 bits of a content hash."""
    return f"cast('0x' || substr(sha256(concat_ws(chr(31), {', '.join(parts)})), 1, 16) as ubigint)::double / 18446744073709551616.0"


SCORED = f"""p_ as (select * exclude (rn) from
  (select *, row_number() over (partition by row_id, kind, key order by expanded_at desc) as rn from passes) where rn = 1),
s_ as (select *, {unit_sql("'demo'", "row_id", "kind", "key")} as u, {unit_sql("'second'", "row_id", "kind", "key")} as v from p_)"""
GROUPED = SCORED + """,
g_ as (select row_id, qtype, list(key order by pos, key) as keys, list((u - 0.5) * 8 order by pos, key) as z, list((v - 0.5) * 6 order by pos, key) as y,
  list(target order by pos, key) as t, coalesce(list_position(list(target order by pos, key), 1.0), 0) - 1 as gold from s_ where qtype <> 'noul' group by row_id, qtype)"""


def softmax_sql(z: str, temperature: float = 1.0) -> str:
    e = f"list_transform({z}, lambda x: exp((x - list_max({z})) / {temperature}))"
    return f"list_transform({e}, lambda w: w / list_sum({e}))"


#: From p (a list of probabilities) the rounded r; CTEs that follow one named by {0} with a column p.
ROUNDED = """r1_ as (select *, list_position(p, list_max(p)) as k, list_transform(p, lambda x: round(x, 4)) as r0 from {0}),
r2_ as (select * exclude (r0), list_transform(r0, lambda x, i: case when i = k then round(x + (1.0 - list_sum(r0)), 4) else x end) as ra from r1_),
r3_ as (select * exclude (ra), list_transform(ra, lambda x: least(1.0, greatest(0.0, x))) as rb from r2_),
r4_ as (select * exclude (rb), case when abs(list_sum(rb) - 1.0) > 1e-9 then list_transform(rb, lambda x, i: case when i = k then round(1.0 - (list_sum(rb) - x), 4) else x end) else rb end as r from r3_)"""
CONFIDENCE = "case when len(r) <= 1 then 1.0 else greatest(0.0, round(1.0 + list_sum(list_transform(r, lambda x: case when x > 0 then x * ln(x) else 0.0 end)) / ln(len(r)), 4)) end"
