"""Messages that a decision runner renders, and prompts with lettered options. Column expressions.

Candidates are an array of structs (code, value, description) with codes from A; a message has 2 to 26 of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact_json, packed_json

CANDIDATE = "array<struct<code: string, value: string, description: string>>"


def _code(i: Column) -> Column:
    return F.char(F.lit(65) + i)


def json_string(text: Column) -> Column:
    """A string as JSON."""
    body = F.to_json(F.struct(text.alias("x")))
    return F.substring(body, F.lit(6), F.length(body) - 6)


def quoted(text: Column) -> Column:
    """A string as JSON with < > & escaped."""
    return compact_json(json_string(text))


def content(value: Column) -> Column:
    """Text as it is; a JSON object or array in its compact form, < > & escaped."""
    packed = packed_json(value)
    return F.when(F.substring(F.ltrim(value), 1, 1).isin("{", "["), compact_json(packed)).otherwise(value)


def candidates(kind: Column, criteria: Column, options: Column, descriptions: Column, levels: Column) -> Column:
    """No and yes, the options with their descriptions (themselves where there is none), or the levels by number."""
    side = lambda key, default: F.coalesce(F.get_json_object(criteria, f"$.{key}"), F.lit(default))
    one = lambda code, value, text: F.struct(code.alias("code"), value.alias("value"), text.alias("description"))
    noul = F.array(one(F.lit("A"), F.lit("false"), side("false", "No")), one(F.lit("B"), F.lit("true"), side("true", "Yes")))
    choice = F.transform(options, lambda o, i: one(_code(i), o, F.coalesce(F.element_at(descriptions, o), o)))
    score = F.transform(levels, lambda x, i: one(_code(i), i.cast("string"), x))
    found = F.when(kind == "noul", noul).when(kind == "choice", choice).when(kind == "score", score)
    return F.when(F.size(found).between(2, 26), found)


def field(name: Column, instructions: Column, found: Column) -> Column:
    """One field of a message's schema as compact JSON."""
    value = lambda c: F.when(c["value"].isin("true", "false") & (F.size(found) == 2), c["value"]).otherwise(quoted(c["value"]))
    each = F.transform(
        found,
        lambda c: F.concat(F.lit('{"code":'), quoted(c["code"]), F.lit(',"value":'), value(c), F.lit(',"description":'), quoted(c["description"]), F.lit("}")),
    )
    return F.concat(
        F.lit('{"name":'), quoted(name), F.lit(',"description":'), quoted(content(instructions)), F.lit(',"choices":['), F.array_join(each, ","),
        F.lit("]}")
    )


def message(state: Column, name: Column, schema: Column) -> Column:
    """The user message for one field; schema: the fields as a JSON array."""
    return F.concat(F.lit('{"context":'), quoted(content(state)), F.lit(',"schema":'), schema, F.lit("}\n\nRequested field: "), quoted(name))


def kind_of(found: Column) -> Column:
    """The question type that candidates show: two booleans, numbers, or options."""
    values = F.transform(found, lambda c: c["value"])
    booleans = (F.size(values) == 2) & F.forall(values, lambda v: v.isin("true", "false"))
    return F.when(booleans, "noul").when(F.forall(values, lambda v: v.rlike("^[0-9]+$")), "score").otherwise("choice")


def letter_index(found: Column, target: Column) -> Column:
    """The place of the candidate with a value, from 0; null if there is none."""
    at = F.array_position(F.transform(found, lambda c: c["value"]), target)
    return F.when(at > 0, (at - 1).cast("int"))


def lettered_prompt(state: Column, kind: Column, instructions: Column, criteria: Column, options: Column) -> Column:
    """State, question and at most 16 options on lines "A. first"; null where there are none or more."""
    side = lambda key: F.coalesce(F.get_json_object(criteria, f"$.{key}"), F.lit(""))
    noul = F.concat(F.lit("[noul] "), instructions, F.lit("\ncriteria - true: "), side("true"), F.lit(" | false: "), side("false"))
    lines = F.array_join(F.transform(options, lambda o, i: F.concat(_code(i), F.lit(". "), o)), "\n")
    other = F.when(F.size(options).between(1, 16), F.concat(F.lit("["), kind, F.lit("] "), instructions, F.lit("\n"), lines))
    return F.concat(state, F.lit("\n\n"), F.when(kind == "noul", noul).otherwise(other), F.lit("\nanswer:"))


def answer_token(kind: Column, label: Column) -> Column:
    """yes, no, or a blank and the letter."""
    return F.when(kind == "noul", F.when(label == 1, "yes").otherwise("no")).otherwise(F.concat(F.lit(" "), _code(label)))
