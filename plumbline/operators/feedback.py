"""A store of reviewed feedback as tables: validation, review, redaction, retention, export, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values
KINDS = ["correction", "confirmation", "outcome", "rejection"]
STATES = ["pending", "confirmed", "rejected"]
TYPES = ["noul", "choice", "score"]


def errors():
    """The rules a record breaks, in order, as an array of field names."""
    q = "question"
    rules = [
        ("kind", ~F.coalesce(F.col("kind").isin(KINDS), F.lit(False))),
        ("served_as", F.coalesce(F.col("served_as"), F.lit("")) == ""),
        ("question", F.col(q).isNull()),
        ("question.type", ~F.coalesce(F.col(f"{q}.type").isin(TYPES), F.lit(False))),
        ("question.instructions", F.col(f"{q}.instructions").isNull()),
        ("question.options", (F.col(f"{q}.type") == "choice") & (F.coalesce(F.size(f"{q}.options"), F.lit(0)) <= 0)),
        ("question.levels", (F.col(f"{q}.type") == "score") & (F.coalesce(F.size(f"{q}.levels"), F.lit(0)) <= 0)),
        ("state_sha256", F.coalesce(F.length("state_sha256"), F.lit(0)) != 64),
        ("feedback.answer", F.col("feedback.answer").isNull()),
        ("privacy.retention_days", F.col("privacy").isNotNull() & F.col("privacy.retention_days").isNull()),
        ("review.status", F.col("review").isNotNull() & ~F.coalesce(F.col("review.status").isin(STATES), F.lit(False))),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]), lambda x: x.isNotNull())


def review(store: DataFrame, decisions: DataFrame) -> DataFrame:
    """The store after reviews (id, status, reviewer, note, reviewed_ts); ids that are not in the store are reported by unknown()."""
    d = decisions.select("id", F.struct("status", "reviewer", "note", "reviewed_ts").alias("__new"))
    return store.join(d, "id", "left").withColumn("review", F.coalesce("__new", "review")).drop("__new").select(*store.columns)


def unknown(store: DataFrame, decisions: DataFrame) -> DataFrame:
    return decisions.join(store.select("id"), "id", "left_anti")


def redact(store: DataFrame, keys: list[str]) -> DataFrame:
    """Object states whose top-level keys of the list read <redacted>, privacy.redacted being set; all other values, the hash and plain texts stay."""
    fields = F.from_json("state", "map<string,variant>")
    hidden = F.transform_values(fields, lambda k, v: F.when(k.isin(keys), F.parse_json(F.lit('"<redacted>"'))).otherwise(v))
    is_object = (F.substring(F.ltrim("state"), 1, 1) == "{") & F.try_parse_json("state").isNotNull()
    privacy = F.coalesce(F.col("privacy"), F.lit(None).cast(store.schema["privacy"].dataType))
    marked = F.when(privacy.isNull(), F.from_json(F.lit("{}"), store.schema["privacy"].dataType.json())).otherwise(privacy).withField("redacted", F.lit(True))
    out = store.withColumn("__object", F.coalesce(is_object, F.lit(False)))
    out = out.withColumn("state", F.when(F.col("__object"), F.to_json(hidden)).otherwise(F.col("state")))
    return out.withColumn("privacy", F.when(F.col("__object"), marked).otherwise(F.col("privacy"))).drop("__object")


def add(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with new records; an id that is there already, or twice among the new ones, is an error."""
    twice = new.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id").unionByName(new.join(store.select("id"), "id", "left_semi").select("id"))
    if bad := [r.id for r in twice.limit(5).collect()]:
        raise ValueError(f"ids that are not unique: {bad}")
    return store.unionByName(new, True)


def review_strictly(store: DataFrame, decisions: DataFrame) -> DataFrame:
    """review, but a decision on an id that is not in the store is an error."""
    if bad := [r.id for r in unknown(store, decisions).limit(5).collect()]:
        raise KeyError(f"no such records: {bad}")
    return review(store, decisions)


def prune(store: DataFrame, cutoff_ts: float) -> DataFrame:
    """What is younger than the cutoff or confirmed."""
    return store.where((F.col("ts") >= cutoff_ts) | (F.coalesce(F.col("review.status"), F.lit("")) == "confirmed"))


def removed(store: DataFrame, cutoff_ts: float) -> DataFrame:
    """How many records prune keeps and how many it removes: kept, removed."""
    stays = F.coalesce((F.col("ts") >= cutoff_ts) | (F.coalesce(F.col("review.status"), F.lit("")) == "confirmed"), F.lit(False))
    return store.agg(F.coalesce(F.count_if(stays), F.lit(0)).alias("kept"), F.coalesce(F.count_if(~stays), F.lit(0)).alias("removed"))


def export(store: DataFrame, respect_opt_out: bool = True) -> DataFrame:
    """Confirmed records as training rows; those who opted out are left out unless told otherwise."""
    kept = store.where("review.status = 'confirmed'")
    if respect_opt_out:
        kept = kept.where(~F.coalesce(F.col("privacy.opt_out"), F.lit(False)))
    return kept.select(
        F.concat(F.lit("feedback-"), "id").alias("row_id"), F.col("question.type").alias("primitive"), "state", F.col("question.instructions").alias("instructions"), F.col("feedback.answer").alias("answer"),
        F.when(F.col("question.type") == "choice", F.array_position("question.options", F.col("feedback.answer")) - 1)
        .when(F.col("question.type") == "score", F.array_position("question.levels", F.col("feedback.answer")) - 1).cast("int").alias("label"), "license",
    )


def duplicates(store: DataFrame) -> DataFrame:
    return store.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def stats(store: DataFrame) -> DataFrame:
    """Counts by kind, by review status, by model, and over all: dimension, value, n."""
    s = store.select("kind", F.coalesce("review.status", F.lit("none")).alias("status"), "served_as")
    s = s.groupBy("kind", "status", "served_as").count()
    pick = F.explode(
        F.array(
            *[F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in (("kind", F.col("kind")), ("status", F.col("status")), ("served_as", F.col("served_as")), ("all", F.lit("all")))]
        )
    )
    return s.select(pick.alias("x"), "count").groupBy("x.dimension", "x.value").agg(F.sum("count").alias("n"))
