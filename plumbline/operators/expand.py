"""Rows into passes (one per question, option or level) and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import hashing, text


def kept_options(row_id: Column, options: Column, label: Column, most: int, seed: str = "options") -> Column:
    """The places of the options to expand: all for held-out rows and short lists, else gold and the first distractors by a hash of row and place."""
    places = F.sequence(F.lit(0), F.size(options) - 1)
    ranked = F.array_sort(
        F.transform(
            F.filter(places, lambda i: i != F.coalesce(label, F.lit(-1))),
            lambda i: F.struct(F.sha2(F.concat_ws("|", F.lit(seed), row_id, i.cast("string")), 256).alias("h"), i.alias("i"))
        )
    )
    chosen = F.slice(F.transform(ranked, lambda x: x["i"]), 1, most - 1)
    few = hashing.is_val(row_id) | (F.size(options) <= most)
    return F.when(few, places).otherwise(F.filter(places, lambda i: (i == label) | F.array_contains(chosen, i)))


def seeded_subset(row_id: Column, options: Column, label: Column, most: int, seed: str) -> Column:
    """Gold and the first others by a hash of row and place, in the order of the list: struct(options, gold), gold being the place among those kept."""
    places = F.sequence(F.lit(0), F.size(options) - 1)
    ranked = F.array_sort(
        F.transform(
            F.filter(places, lambda i: i != label),
            lambda i: F.struct(F.sha2(F.concat_ws("|", F.lit(seed), row_id, i.cast("string")), 256).alias("h"), i.alias("i"))
        )
    )
    chosen = F.slice(F.transform(ranked, lambda x: x["i"]), 1, most - 1)
    kept = F.when(F.size(options) <= most, places).otherwise(F.filter(places, lambda i: (i == label) | F.array_contains(chosen, i)))
    return F.struct(F.transform(kept, lambda i: F.element_at(options, i + 1)).alias("options"), (F.array_position(kept, label) - 1).cast("int").alias("gold"))


def matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with its match in right, a small table with a row for each key; a key that right lacks is an error."""
    told = F.concat(F.lit(f"no {key} "), F.coalesce(F.col(key).cast("string"), F.lit("(null)")))
    joined = left.join(right.withColumn("__there", F.lit(True)), key, "left")
    return joined.withColumn(key, F.when(F.col("__there"), F.col(key)).otherwise(F.raise_error(told))).drop("__there")


def expand(rows: DataFrame, descriptions: DataFrame, levels: DataFrame, soft: DataFrame, most: int = 24, with_text: bool = True) -> DataFrame:
    """Passes: row_id, qtype, kind, key, pos, target, weight, gold, soft and text.

    Held-out rows have gold targets and weight 1; others take soft targets where there are some. descriptions and levels
    are small fixed tables; options without a description stand alone, score rows without levels are an error in
    the data and give no passes. Null labels give null gold and all-zero one-hot targets.
    """
    base = rows.select(
        "row_id", "primitive", "state", "instructions", "criteria", F.col("label").cast("double").alias("gold"), "label", "meta.options",
        "meta.attribute"
    )
    if with_text:
        base = base.withColumn("instructions", text.instructions_text("instructions"))
    val = hashing.is_val(F.col("row_id"))
    noul = base.where("primitive = 'noul'").join(soft.select("row_id", "p", F.col("weight").alias("w")), "row_id", "left")
    noul = noul.select(
        "row_id", F.lit("noul").alias("qtype"), F.lit("noul").alias("kind"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("pos"),
        F.when(
            ~val & F.col("p").isNotNull(), F.col("p")
        ).otherwise(F.col("gold")).alias("target"), F.when(~val, F.coalesce("w", F.lit(1.0))).otherwise(1.0).alias("weight"), "gold", F.col("p").alias("soft"),
        *([text.noul_pass(F.col("state"), F.col("instructions"), F.col("criteria")).alias("text")] if with_text else []),
    )
    one_hot = F.when(F.col("pos") == F.col("label"), 1.0).otherwise(0.0)
    options = base.where("primitive = 'choice' and size(options) > 0").withColumn(
        "pos", F.explode(kept_options(F.col("row_id"), F.col("options"), F.col("label"), most))
    )
    options = options.withColumn("key", F.element_at("options", F.col("pos") + 1)).join(
        descriptions.select(F.col("name").alias("key"), "description"), "key", "left"
    )
    choice = options.select(
        "row_id", F.lit("choice").alias("qtype"), F.lit("choice_opt").alias("kind"), "key", F.col("pos").cast("int").alias("pos"), one_hot.alias("target"), F.lit(1.0).alias("weight"), "gold", F.lit(None).cast("double").alias("soft"),
        *([text.option_pass(F.col("state"), F.col("instructions"), F.col("key"), F.col("description")).alias("text")] if with_text else []),
    )
    levelled = base.where("primitive = 'score'").join(levels, "attribute").select("*", F.posexplode("levels").alias("pos", "level"))
    score = levelled.select(
        "row_id", F.lit("score").alias("qtype"), F.lit("score_lvl").alias("kind"), F.col("pos").cast("string").alias("key"), "pos", one_hot.alias("target"), F.lit(1.0).alias("weight"), "gold", F.lit(None).cast("double").alias("soft"),
        *([text.level_pass(F.col("state"), F.col("instructions"), F.col("pos"), F.size("levels"), F.col("level")).alias("text")] if with_text else []),
    )
    return noul.unionByName(choice).unionByName(score)


def regroup(passes: DataFrame) -> DataFrame:
    """Passes into rows: targets and weights as arrays in the order of pos."""
    g = passes.groupBy("row_id", "qtype").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "target", "weight"))).alias("x"))
    return g.select("row_id", "qtype", F.col("x.key").alias("keys"), F.col("x.target").alias("target"), F.col("x.weight").alias("weight"))
