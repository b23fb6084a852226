"""Validation of requests: each failure names the first field that breaks a rule."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits of a question.
OPTIONS, LEVELS = (2, 255), (2, 10)


def first_error(state: Column, kind: Column, instructions: Column, options: Column, levels: Column) -> Column:
    """The path of the first broken field; null if the question is valid."""
    n = F.coalesce(F.size(options), F.lit(-1))
    m = F.coalesce(F.size(levels), F.lit(-1))
    return (
        F.when(state.isNull(), "state")
        .when(~F.coalesce(kind.isin("noul", "choice", "score"), F.lit(False)), "type")
        .when(F.coalesce(instructions, F.lit("")) == "", "instructions")
        .when((kind == "choice") & ~n.between(*OPTIONS), "criteria")
        .when((kind == "choice") & F.exists(options, lambda o: F.coalesce(o, F.lit("")) == ""), "criteria.option")
        .when((kind == "score") & ~m.between(*LEVELS), "criteria")
    )


def image_tokens(width: Column, height: Column) -> Column:
    """Tokens of an image: sides in steps of 16 rounded up to even numbers, a quarter of their product; larger ones are first scaled to the cap of pixels, in whole pixels."""
    most = 16_777_216.0
    scale = F.sqrt(F.lit(most) / (width * height))
    whole = lambda x: F.when(width * height > most, F.floor(x * scale)).otherwise(x)
    side = lambda x: F.ceil(F.ceil(whole(x) / 16) / 2) * 2
    return (side(width) * side(height) / 4).cast("long")


def bounded_size(width: Column, height: Column, edge: int = 640) -> Column:
    """The size an image is brought to: its longer side at most edge, whole pixels, halves to the even one; smaller ones stay."""
    scale = F.lit(float(edge)) / F.greatest(width, height)
    side = lambda x: F.when(scale < 1, F.greatest(F.lit(1.0), F.bround(x * scale))).otherwise(x).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def _broken(q, at: str) -> str | None:
    """The first path of a question that breaks a rule of the contract."""
    told = lambda v: isinstance(v, (str, dict, list))
    if not isinstance(q, dict):
        return at
    kind, criteria = q.get("type"), q.get("criteria")
    if kind not in ("noul", "choice", "score"):
        return f"{at}.type"
    if not told(q.get("instructions")):
        return f"{at}.instructions"
    path = f"{at}.criteria"
    if kind == "noul":
        if criteria is None:
            return None
        if not isinstance(criteria, dict):
            return path
        return next((f"{path}.{s}" for s in ("true", "false") if s in criteria and not told(criteria[s])), None)
    if kind == "choice":
        if not isinstance(criteria, dict) or not OPTIONS[0] <= len(criteria) <= OPTIONS[1]:
            return path
        for name, meaning in criteria.items():
            if not name:
                return path
            if meaning is not None and not told(meaning):
                return f"{path}.{name}"
        return None
    if not isinstance(criteria, list) or not LEVELS[0] <= len(criteria) <= LEVELS[1]:
        return path
    return next((f"{path}.{i}" for i, level in enumerate(criteria) if not told(level)), None)


@F.pandas_udf(T.StringType())
def request_error(body: pd.Series) -> pd.Series:
    """The first field of a request (JSON text) that breaks the contract: body, state, model, questions or a path below; null if it is valid."""

    def one(text):
        try:
            r = json.loads(text) if text is not None else None
        except ValueError:
            r = None
        if not isinstance(r, dict):
            return "body"
        if not isinstance(r.get("state"), (str, dict, list)):
            return "state"
        if not isinstance(r.get("model"), str) or not r["model"]:
            return "model"
        asked = r.get("questions")
        if not isinstance(asked, dict) or not asked or "" in asked:
            return "questions"
        return next((e for e in (_broken(q, f"questions.{k}") for k, q in asked.items()) if e), None)

    return body.map(one)
