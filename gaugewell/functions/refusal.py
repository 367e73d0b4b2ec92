"""Refusals and empty answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import any_of, found
from .text import strip

#: Patterns over lower-cased text with their confidence, in order of trial.
PATTERNS = [
    (r"\b(i cannot|i can't|i am unable to|i'm unable to)\b", 0.95),
    (r"\b(i'm not able to|i am not able to)\b", 0.95),
    (r"\b(i will not|i won't)\b", 0.95),
    (r"\b(i'm not comfortable|i am not comfortable)\b", 0.95),
    (r"\b(i refuse to|i'm refusing to)\b", 0.95),
    (r"\b(violates|against|violating)\s+(my|the)\s+(policy|guidelines|rules|terms)\b", 0.95),
    (r"\b(not appropriate|inappropriate)\b", 0.9),
    (r"\b(not ethical|unethical)\b", 0.9),
    (r"\b(not allowed|disallowed)\b", 0.9),
    (r"\b(cannot assist|can't assist|unable to assist)\b", 0.95),
    (r"\b(cannot help|can't help|unable to help)\b", 0.95),
    (r"^sorry[,\s]", 0.85),
    (r"\b(i don't know|i do not know)\b", 0.7),
    (r"\b(i'm not sure|i am not sure)\b", 0.7),
    (r"\b(i don't understand|i do not understand)\b", 0.7),
    (r"\b(i'm not familiar|i am not familiar)\b", 0.7),
    (r"\b(beyond my|outside my)\s+(capabilities|abilities|knowledge)\b", 0.75),
    (r"\b(i don't have|i do not have)\s+(the ability|access to)\b", 0.75),
    (r"\b(i would need|i'd need)\s+more\s+information\b", 0.5),
    (r"\b(i can't provide|i cannot provide)\s+(specific|detailed)\b", 0.6),
    (r"\b(i'm not able to|i am not able to)\s+provide\b", 0.7),
    (r"\b(i cannot generate|i can't generate)\s+code\b", 0.95),
    (r"\b(i will not generate|i won't generate)\s+code\b", 0.95),
    (r"\b(code generation|generating code)\s+is\s+not\s+(allowed|permitted)\b", 0.95),
]
#: Answers that hold nothing.
EMPTY = [(r"^\s*$", 0.9), (r"^\s*\.\.\.\s*$", 0.9), (r"^\s*\[\s*\]\s*$", 0.8), (r"^\s*\{\s*\}\s*$", 0.8), (r"^\s*null\s*$", 0.8), (r"^\s*none\s*$", 0.8), (r"^\s*n/a\s*$", 0.8)]
#: Words that make a short answer a refusal.
KEYWORDS = ["no", "sorry", "apologize", "cannot", "can't", "unable"]


def _plain(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def _any(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _told(c: Column, text: Column, threshold: float, custom: list[tuple[str, float]] | None, without: tuple[str, ...]) -> tuple[Column, Column]:
    """(whether a text refuses, by two alternations at most; the struct of the rule that tells it)."""
    kept = [(p, v) for p, v in [*PATTERNS, *(custom or [])] if v >= threshold and p not in without]
    short = (F.length(text) < 20) & text.rlike("|".join(KEYWORDS))
    yes = (F.coalesce(c, F.lit("")) == "") | text.rlike(_any([p for p, _ in EMPTY])) | short
    yes = yes | any_of(text, [p for p, _ in kept])
    verdict = lambda is_, pattern, p: F.struct(F.lit(is_).alias("is_refusal"), F.lit(pattern).cast("string").alias("pattern_matched"), F.lit(p).alias("confidence"))
    chain = F.when(~yes, verdict(False, None, 0.0)).when(F.coalesce(c, F.lit("")) == "", verdict(True, "empty_input", 1.0))
    chain = reduce(lambda w, r: w.when(text.rlike(r[0]), verdict(True, r[0], r[1])), [*EMPTY, *kept], chain)
    return yes, chain.otherwise(verdict(True, "short_refusal", 0.6))


def detect(c: Column, threshold: float = 0.7, custom: list[tuple[str, float]] | None = None, without: tuple[str, ...] = ()) -> Column:
    """struct(is_refusal, pattern_matched, confidence); custom patterns come last, those in without are left out."""
    return _told(c, _plain(c), threshold, custom, without)[1]


def detected(df: DataFrame, text: str, name: str = "refusal", threshold: float = 0.7, custom: list[tuple[str, float]] | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """df with detect's struct, the plain text in a column of its own first, so that no rule makes it again."""
    return df.withColumn("x_plain", _plain(F.col(text))).withColumn(name, _told(F.col(text), F.col("x_plain"), threshold, custom, without)[1]).drop("x_plain")


def is_refusal(c: Column, threshold: float = 0.7) -> Column:
    return _told(c, _plain(c), threshold, None, ())[0]


def reason(c: Column, threshold: float = 0.7) -> Column:
    """The rule that tells a refusal; null for an answer."""
    return detect(c, threshold)["pattern_matched"]


def analysis(c: Column) -> Column:
    """struct(matches, n_chars, preview): every pattern that occurs, the length, and the first 200 characters."""
    return F.struct(all_matches(c).alias("matches"), F.length(F.coalesce(c, F.lit(""))).cast("long").alias("n_chars"), F.left(F.coalesce(c, F.lit("")), F.lit(200)).alias("preview"))


def all_matches(c: Column) -> Column:
    """Every pattern that occurs, also those below the threshold."""
    return found(_plain(c), [p for p, _ in PATTERNS])


def analysed(df: DataFrame, text: str, name: str = "analysis") -> DataFrame:
    """df with analysis's struct, the plain text in a column of its own first."""
    out = df.withColumn("x_plain", _plain(F.col(text)))
    c = F.coalesce(text, F.lit(""))
    told = F.struct(found(F.col("x_plain"), [p for p, _ in PATTERNS]).alias("matches"), F.length(c).cast("long").alias("n_chars"), F.left(c, F.lit(200)).alias("preview"))
    return out.withColumn(name, told).drop("x_plain")
