"""Text of records: serialised passes, tokens and shingles, prompts. Column expressions unless said otherwise."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: a word of lower-case letters and digits, or one character of the CJK range.
TOKEN = r"([a-z0-9]+|[㐀-鿿])"


def tokens(text: Column) -> Column:
    """Lower-case words and single CJK characters; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1)), F.array().cast("array<string>"))


def shingles(words: Column, n: int = 8) -> Column:
    """The distinct runs of n words, joined by a space; none if there are fewer words."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.when(F.size(words) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """A JSON text with sorted keys and the separators ", " and ": "; other text as a JSON string. Null stays null."""

    def one(x):
        if x is None:
            return None
        try:
            return json.dumps(json.loads(x), sort_keys=True, ensure_ascii=False)
        except ValueError:
            return json.dumps(x, ensure_ascii=False)

    return text.map(one)


@F.pandas_udf(T.StringType())
def instructions_text(text: pd.Series) -> pd.Series:
    """Structured instructions: the question, and other fields as JSON on the next line; plain ones as they are."""

    def one(x):
        if not x or x.lstrip()[:1] != "{":
            return x
        try:
            fields = json.loads(x)
        except ValueError:
            return x
        if "question" not in fields:
            return json.dumps(fields, ensure_ascii=False)
        question = fields.pop("question")
        line = question if isinstance(question, str) else json.dumps(question, ensure_ascii=False)
        return f"{line}\n{json.dumps(fields, ensure_ascii=False)}" if fields else line

    return text.map(one)


FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)


@F.pandas_udf(T.StringType())
def loose_json(text: pd.Series) -> pd.Series:
    """The JSON object in an answer that may be fenced or surrounded by prose; null if there is none."""

    def one(x):
        if not x:
            return None
        fenced = FENCE.search(x)
        for part in (fenced[1] if fenced else x, x[x.find("{") : x.rfind("}") + 1]):
            try:
                found = json.loads(part)
            except ValueError:
                continue
            return json.dumps(found, ensure_ascii=False) if isinstance(found, dict) else None
        return None

    return text.map(one)


def criteria_pair(criteria: Column) -> Column:
    """"true: a | false: b" of a JSON object, without what it lacks; empty for null."""
    part = lambda k: F.concat(F.lit(f"{k}: "), F.get_json_object(criteria, f"$.{k}"))
    return F.concat_ws(" | ", part("true"), part("false"))


def noul_pass(state: Column, instructions: Column, criteria: Column) -> Column:
    pair = criteria_pair(criteria)
    return F.concat(state, F.lit("\n\n[noul] "), instructions, F.when(pair != "", F.concat(F.lit("\ncriteria - "), pair)).otherwise(""), F.lit("\nanswer:"))


def option_pass(state: Column, instructions: Column, option: Column, description: Column) -> Column:
    return F.concat(
        state, F.lit("\n\n[choice] "), instructions, F.lit("\noption - "), option, F.coalesce(F.concat(F.lit(": "), description), F.lit("")),
        F.lit("\nanswer:")
    )


def level_pass(state: Column, instructions: Column, pos: Column, n: Column, level: Column) -> Column:
    return F.concat(
        state, F.lit("\n\n[score] "), instructions, F.lit("\nlevel "), (pos + 1).cast("string"), F.lit(" of "), n.cast("string"), F.lit(" - "), level,
        F.lit("\nanswer:")
    )


def surface(*parts: Column) -> Column:
    """All non-empty parts joined by a space."""
    return F.concat_ws(" ", *[F.when(p != "", p) for p in parts])


def lettered_lines(options: Column) -> Column:
    """"A) first", "B) second", ... each on a line of its own."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.char(F.lit(65) + i), F.lit(") "), o)), "\n")


def letter_of(options: Column, value: Column) -> Column:
    """The letter under which a value is offered; null if it is not."""
    at = F.array_position(options, value)
    return F.when(at > 0, F.char(F.lit(64) + at))


@F.pandas_udf(T.StringType())
def packed_json(text: pd.Series) -> pd.Series:
    """A JSON object or array without white space, its fields in the order they stand; other text and null as they are."""

    def one(x):
        if not x or x.lstrip()[:1] not in ("{", "["):
            return x
        try:
            return json.dumps(json.loads(x), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return x

    return text.map(one)


def compact_json(text: Column) -> Column:
    """A JSON text's < > & escaped as they are for a wire format that is embedded in HTML."""
    for c, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        text = F.replace(text, F.lit(c), F.lit(code))
    return text


def judge_prompt(state: Column, instructions: Column, meaning: Column) -> Column:
    """A prompt that asks a teacher for the probability of yes."""
    lead = "Give the probability that the answer is yes, as JSON with one field p between 0 and 1."
    return F.concat(
        F.lit(lead + "\n\nState:\n"), state, F.lit("\n\nQuestion:\n"), instructions,
        F.coalesce(F.concat(F.lit("\n\nYes means: "), meaning), F.lit(""))
    )


def money(cents: Column, sign: str) -> Column:
    """Cents as $12.05."""
    return F.concat(F.lit(sign), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def mail_domain(sender: Column) -> Column:
    """What stands after the first @; null if nothing does."""
    return F.when(F.contains(sender, F.lit("@")), F.split_part(sender, F.lit("@"), F.lit(2)))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 11th."""
    tail = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), tail)


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters."""
    return F.floor(F.length(text) / 4)


def pass_cost(text: Column, with_image: Column) -> Column:
    """Estimated tokens of a pass, a margin of 24, and 399 for an image."""
    return estimated_tokens(text) + F.when(with_image, F.lit(399 + 24)).otherwise(F.lit(24))


def clock(minutes: Column) -> Column:
    """Minutes of the day as HH:MM."""
    return F.concat(F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))
