"""Text normalisation and small text helpers as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space at both ends; trim() knows the space only."""
    return F.regexp_replace(c, SPACE, "")


def preprocess(c: Column, lower: bool = False, limit: int | None = None) -> Column:
    out = strip(F.coalesce(c, F.lit("")))
    out = F.lower(out) if lower else out
    return F.left(out, F.lit(limit)) if limit else out


def clean_text(c: Column) -> Column:
    """Without fence marks and quotes at the ends of lines."""
    for pattern in (r"(?m)^\s*```\w*\s*", r"(?m)\s*```\s*$", r"(?m)^\s*[\"']+", r"(?m)[\"']+\s*$"):
        c = F.regexp_replace(c, pattern, "")
    return strip(c)


def extract_between(c: Column, start: str, end: str, inclusive: bool = False) -> Column:
    """The first shortest span between two literals; null without one."""
    quoted = rf"(?s)\Q{start}\E(.*?)\Q{end}\E"
    return F.when(c.rlike(quoted), F.regexp_extract(c, quoted, 0 if inclusive else 1))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, which has no built-in function."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normalise(c: Column, case: bool = True, trim: bool = True, punctuation: bool = False, compatibility: bool = False, custom: Callable[[Column], Column] | None = None) -> Column:
    """A comparable form of a text. White space always collapses and the ends are always stripped; null is ''."""
    out = F.coalesce(c, F.lit(""))
    out = nfkc(out) if compatibility else out
    out = strip(out) if trim else out
    out = F.regexp_replace(out, r"(?U)[^\w\s]", "") if punctuation else out
    out = F.lower(out) if case else out
    out = F.regexp_replace(out, r"(?U)\s+", " ")
    return strip(custom(out) if custom else out)


def exact_match(a: Column, b: Column, **options) -> Column:
    return normalise(a, **options) == normalise(b, **options)


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(F.coalesce(c, F.lit(""))) / 4).cast("long")


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_")


#: Words that tell what a question is about.
INTENTS = {
    "speed": ["fast", "latency", "throughput", "realtime", "real-time", "ttft"],
    "coding": ["code", "coding", "python", "developer", "humaneval"],
    "reasoning": ["reason", "reasoning", "hellaswag", "multiple choice"],
    "tool": ["function", "tool", "bfcl", "agent"],
    "memory": ["memory", "ram", "cheap", "small", "efficient"],
}


def intents(c: Column) -> dict[str, Column]:
    low = F.lower(c)
    return {k: F.exists(F.array(*map(F.lit, v)), lambda w: F.contains(low, w)) for k, v in INTENTS.items()}


def hardware(c: Column) -> Column:
    """cpu, ram and gpu numbers that a message mentions."""
    low = F.lower(c)
    number = lambda p: F.regexp_extract(low, p, 1).try_cast("int")
    return F.struct(number(r"(\d+)\s*(?:cpu|core|vcpu|processor)").alias("cpu"), number(r"(\d+)\s*(?:gb|gigabytes?)\s*(?:ram|memory)").alias("ram"), number(r"(\d+)\s*(?:gpu|rtx|a100|h100)").alias("gpu"))


def key_values(c: Column) -> Column:
    """'a=1,b' as a map; a bare key is 'true'."""
    return F.transform_values(F.str_to_map(c, F.lit(","), F.lit("=")), lambda _, v: F.coalesce(v, F.lit("true")))
