"""Builders of labelled rows from public source tables, by name.

A builder takes a table with its source's own columns and an order column `ord` (0, 1, 2, ... the place in the source) and gives rows of one
schema: row_id, primitive, state (struct as JSON), instructions, criteria (JSON or null), label, options, attribute. n counts rows as each
source does: of the source before filters, or of what is left. Where numbers count what is left, places are found by buckets, never in one task.
Null texts give rows with null parts where the source has no filter; null labels are left out where a label decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import ingest

SCHEMA = ("row_id", "primitive", "state", "instructions", "criteria", "label", "options", "attribute")
RESPONSE_CHARS = 1200
BUILDERS: dict[str, Callable[..., DataFrame]] = {}


def builder(f):
    BUILDERS[f.__name__] = f
    return f


def _rows(df: DataFrame, row_id: Column, primitive: str, state: Column, instructions: Column, label: Column, criteria: Column | None = None, options: Column | None = None, attribute: Column | None = None) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    return df.select(
        row_id.alias("row_id"), F.lit(primitive).alias("primitive"), F.to_json(
            state, {"ignoreNullFields": "false"}
        ).alias("state"), instructions.alias("instructions"),
        (none("string") if criteria is None else criteria).alias("criteria"), label.cast("int").alias("label"),
        (none("array<string>") if options is None else options).alias("options"), (none("string") if attribute is None else attribute).alias("attribute"),
    )


def _sides(true: str, false: str) -> Column:
    return F.to_json(F.struct(F.lit(true).alias("true"), F.lit(false).alias("false")))


def _id(name: str, number: Column) -> Column:
    return F.concat(F.lit(f"{name}-"), number.cast("string"))


@builder
def reading(df: DataFrame, n: int, name: str = "reading") -> DataFrame:
    """Yes-or-no questions on a passage (passage, question, label 1 = yes): the first n of the source."""
    ask = F.concat(F.lit("Does `passage` answer `"), "question", F.lit("` with yes?"))
    sides = _sides("the passage answers the question with yes", "the passage does not support a yes answer")
    return _rows(df.where(F.col("ord") < n), _id(name, F.col("ord")), "noul", F.struct("passage"), ask, F.col("label"), sides)


@builder
def claims(df: DataFrame, n: int, name: str = "claims") -> DataFrame:
    """Claims and evidence (label 0 = supported): trimmed, empty ones dropped, of equal claims the first; n of what is left, numbered anew."""
    cut = lambda c: F.btrim(F.col(c), F.lit(" \t\n\x0b\x0c\r")).alias(c)
    t = df.select("ord", cut("claim"), cut("evidence"), "label").where("claim <> '' and evidence <> ''")
    first = t.groupBy("claim").agg(F.min_by(F.struct("ord", "evidence", "label"), "ord").alias("x")).select("claim", "x.*")
    kept = ingest.dense_numbers(first, "ord", "i").where(F.col("i") < n)
    sides = _sides("the claim is supported by the evidence", "the claim is contradicted by or unrelated to the evidence")
    return _rows(
        kept, _id(name, F.col("i")), "noul", F.struct("claim", "evidence"), F.lit("Is `claim` supported by `evidence`?"),
        F.when(F.col("label") == 0, 1).otherwise(0), sides
    )


@builder
def entailment(df: DataFrame, n: int, name: str = "entailment") -> DataFrame:
    """Premise and hypothesis (label 0 = entailed, -1 = none): of the first n of the source those with a label, under their place in it."""
    kept = df.where((F.col("ord") < n) & (F.col("label") != -1))
    ask = F.concat(F.lit("Is `hypothesis` true given `premise`? Hypothesis: "), "hypothesis")
    sides = _sides("the hypothesis is entailed by the premise", "the hypothesis is not entailed by the premise")
    return _rows(kept, _id(name, F.col("ord")), "noul", F.struct("premise"), ask, F.when(F.col("label") == 0, 1).otherwise(0), sides)


@builder
def intents(df: DataFrame, n: int, names: list[str], name: str = "intents") -> DataFrame:
    """Queries with an intent number: the dictionary of names goes with every row."""
    options = F.array(*map(F.lit, names))
    return _rows(
        df.where(F.col("ord") < n), _id(name, F.col("ord")), "choice", F.struct(F.col("text").alias("query")),
        F.lit("What is the customer's intent?"), F.col("label"), options=options
    )


@builder
def ratings(df: DataFrame, n: int, attributes: list[str], name: str = "ratings") -> DataFrame:
    """Rated responses, a column for each attribute: a row for each rating that is there, the response cut to RESPONSE_CHARS."""
    t = df.where(F.col("ord") < n).select("ord", "prompt", F.substring("response", 1, RESPONSE_CHARS).alias("response"), *attributes)
    t = ingest.unpivot(t, ["ord", "prompt", "response"], attributes, "attr", "rating")
    ask = F.concat(F.lit("How would you rate `response` on "), "attr", F.lit("?"))
    return _rows(
        t, F.concat(_id(name, F.col("ord")), F.lit("-"), "attr"), "score", F.struct("prompt", "response"), ask, F.col("rating"),
        attribute=F.col("attr")
    )


@builder
def emotions(df: DataFrame, n: int, names: list[str], name: str = "emotions") -> DataFrame:
    """Comments with lists of labels: rows without any are dropped, the first label holds; n of what is left, numbered anew."""
    kept = ingest.dense_numbers(df.where("size(labels) > 0"), "ord", "i").where(F.col("i") < n)
    return _rows(
        kept, _id(name, F.col("i")), "choice", F.struct(F.col("text").alias("comment")), F.lit("Which emotion does `comment` most express?"),
        F.element_at("labels", 1), options=F.array(*map(F.lit, names))
    )


@builder
def entailment_zh(df: DataFrame, n: int, name: str = "entailment_zh") -> DataFrame:
    """Chinese premise and hypothesis (label text, - = none): the first n that have a label, under their place in the source."""
    kept = ingest.dense_numbers(df.where("label <> '-'"), "ord", "i").where(F.col("i") < n)
    ask = F.concat(F.lit("前提是否蕴含以下假设？假设："), "hypothesis")
    return _rows(
        kept, _id(name, F.col("ord")), "noul", F.struct("premise"), ask, F.when(F.col("label") == "entailment", 1).otherwise(0),
        _sides("前提蕴含该假设", "前提不蕴含该假设")
    )


def build(name: str, df: DataFrame, n: int, **options) -> DataFrame:
    """Rows of a registered builder; an unknown name is an error."""
    if name not in BUILDERS:
        raise KeyError(f"no builder {name}; there are {sorted(BUILDERS)}")
    return BUILDERS[name](df, n, **options)
