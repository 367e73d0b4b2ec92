"""JSON in free text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip


@F.pandas_udf(T.BooleanType())
def is_json_exact(s: pd.Series) -> pd.Series:
    """Valid as Python's reader sees it, NaN and repeated keys included."""

    def ok(x: str | None) -> bool:
        try:
            json.loads(x or "")
        except ValueError:
            return False
        return True

    return s.map(ok)


def shaped(c: Column) -> Column:
    """One value and nothing beside it, by its outer form."""
    return c.rlike(r"(?s)^\s*(\{.*\}|\[.*\]|\"(?:[^\"\\]|\\.)*\"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)\s*$")


def is_json(c: Column) -> Column:
    """Valid JSON, natively: it parses, and nothing follows a first value."""
    return F.coalesce(F.try_parse_json(c).isNotNull() & shaped(c), F.lit(False))


def fenced(c: Column) -> Column:
    return strip(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1))


#: Repairs in order; what the pattern matches becomes the text beside it.
REPAIRS = [(r",\s*\}", "}"), (r",\s*\]", "]"), ("'", '"'), (r"([{,]\s*)(\w+)(\s*:)", '$1"$2"$3'), (r"//.*?\n", "\n"), (r"(?s)/\*.*?\*/", "")]


def repair(c: Column) -> Column:
    """The text after common repairs, if it is then valid, else null."""
    out = strip(c)
    for pattern, to in REPAIRS:
        out = F.regexp_replace(out, pattern, to)
    return F.when(is_json(out), out)


def _longest(c: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    keyed = F.transform(F.filter(found, is_json), lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))
    return F.try_element_at(F.array_sort(keyed), F.lit(1))["x"]


def extract(c: Column) -> Column:
    """The text if it is JSON, else a fenced block, the longest flat array or object, the repaired text, or the text as it is."""
    text = F.coalesce(c, F.lit(""))
    inside = fenced(text)
    return F.coalesce(F.when(is_json(text), strip(text)), F.when(text.contains("```") & is_json(inside), inside), _longest(text, r"(\[[^\[\]]*\])"), _longest(text, r"(\{[^{}]*\})"), repair(text), text)


def confidence(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return F.when(is_json(text), 1.0).when(text.contains("```json"), 0.9).when(text.rlike(r"[{\[]"), 0.7).otherwise(0.5)


def with_json(df: DataFrame, text: str, name: str, confidence_name: str | None = None) -> DataFrame:
    """df with extract (and confidence) of a text column: each form is tried once, and only for texts that the forms before leave open."""
    c = F.col(text)
    out = df.withColumn("x_valid", F.when(c.rlike(r"^\s*[\[{\"\-\dtfn]"), is_json(c)).otherwise(F.lit(False)))
    out = out.withColumn("x_inside", F.when(~F.col("x_valid") & c.contains("```"), fenced(c)))
    out = out.withColumn("x_found", F.when(F.col("x_valid"), strip(c)).when(F.col("x_inside").isNotNull() & is_json(F.col("x_inside")), F.col("x_inside")))
    for pattern, opening in ((r"(\[[^\[\]]*\])", "["), (r"(\{[^{}]*\})", "{")):
        out = out.withColumn("x_found", F.coalesce("x_found", F.when(F.col("x_found").isNull() & c.contains(opening), _longest(c, pattern))))
    fixed = strip(c)
    for pattern, to in REPAIRS:
        fixed = F.regexp_replace(fixed, pattern, to)
    out = out.withColumn("x_fixed", F.when(F.col("x_found").isNull() & c.rlike(r"[\[{\"'\d/]|true|false|null"), fixed))
    out = out.withColumn(name, F.coalesce("x_found", F.when(F.col("x_fixed").isNotNull() & is_json(F.col("x_fixed")), F.col("x_fixed")), c))
    if confidence_name:
        value = F.when(F.col("x_valid"), 1.0).when(c.contains("```json"), 0.9).when(c.rlike(r"[{\[]"), 0.7).otherwise(0.5)
        out = out.withColumn(confidence_name, F.when(c.isNotNull(), value))
    return out.drop("x_valid", "x_inside", "x_found", "x_fixed")


def call_name(c: Column) -> Column:
    """The function that a call object names, in any of its forms."""
    name = F.coalesce(F.get_json_object(c, "$.name"), F.get_json_object(c, "$.function"))
    keys = F.json_object_keys(c)
    return F.when(is_json(c), F.coalesce(name, F.when(F.size(keys) == 1, keys[0])))


def call_arguments(c: Column) -> Column:
    alone = F.when(F.size(F.json_object_keys(c)) == 1, F.call_function("get_json_object", c, F.concat(F.lit("$."), F.json_object_keys(c)[0])))
    return F.when(is_json(c), F.coalesce(F.get_json_object(c, "$.arguments"), F.get_json_object(c, "$.args"), F.get_json_object(c, "$.parameters"), alone))
