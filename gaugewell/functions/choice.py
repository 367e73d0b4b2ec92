"""Multiple-choice letters from free text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns over upper-cased text, with the confidence of each, in order of trial.
PATTERNS = [
    (r"(?i)\banswer\s*[:=]\s*([A-E])", 1.0),
    (r"(?i)\bthe answer is\s*[:=]?\s*([A-E])\b", 1.0),
    (r"(?i)\bcorrect answer\s*[:=]?\s*([A-E])\b", 1.0),
    (r"(?i)\boption\s*[:=]?\s*([A-E])\b", 1.0),
    (r"(?i)\*\*([A-E])\*\*", 0.95),
    (r"(?i)`([A-E])`", 0.95),
    (r"(?i)\[([A-E])\]", 0.9),
    (r"(?i)\(([A-E])\)", 0.9),
    (r"(?i)([A-E])\)", 0.85),
    (r"(?i)([A-E])\.", 0.85),
    (r"(?i)(?:^|\s)([A-E])(?:\s|$|\.|,)", 0.7),
    (r"(?i)(?:answer|option|choice)\s*:?\s*([A-E])", 0.5),
]
CHOICES = ("A", "B", "C", "D", "E")


def _last(text: Column, pattern: str) -> Column:
    """The last letter that a pattern finds in an upper-cased text: one of A to E."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def extract(c: Column, choices: tuple[str, ...] = CHOICES) -> Column:
    """The last letter of the first pattern that gives an allowed one, else a standalone choice, else the last A to E, else ''."""
    text = F.upper(F.coalesce(c, F.lit("")))
    found = [_last(text, p) for p, _ in PATTERNS]
    ladder = found if set(choices) >= set(CHOICES) else [F.when(x.isin(*choices), x) for x in found]
    ladder += [F.when(text.rlike(rf"\b{x}\b"), F.lit(x)) for x in reversed(choices)]
    return F.coalesce(*ladder, F.regexp_extract(text, r"(?s).*([ABCDE])", 1))


def confidence(c: Column, letter: Column) -> Column:
    """Of the first pattern that occurs, whichever gave the letter; 0.3 for a fallback, 0 without a letter."""
    text = F.upper(F.coalesce(c, F.lit("")))
    chain = reduce(lambda w, p: w.when(text.rlike(p[0]), F.lit(p[1])), PATTERNS, F.when(letter == "", F.lit(0.0)))
    return chain.otherwise(0.3)


def alternatives(c: Column, top: int = 3) -> Column:
    """Different letters of all patterns by confidence, first seen first."""
    text = F.upper(F.coalesce(c, F.lit("")))

    def found(k: int, pattern: str, v: float) -> Column:
        letters = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        return F.transform(letters, lambda x, i: F.struct(F.lit(-v).alias("w"), F.lit(k).alias("k"), i.alias("i"), F.upper(x).alias("x")))

    parts = [found(k, p, v) for k, (p, v) in enumerate(PATTERNS)]
    ordered = F.array_sort(F.concat(*parts))
    return F.slice(F.array_distinct(F.transform(ordered, lambda s: s["x"])), 1, top)


def reasoning(c: Column, letter: Column) -> Column:
    """The text without the patterns that state the answer."""
    out = c
    for before, after in ((r"\banswer\s*[:=]\s*", ""), (r"\bthe answer is\s*[:=]?\s*", ""), (r"\*\*", r"\*\*"), ("`", "`"), (r"\[", r"\]"), (r"\(", r"\)")):
        out = F.regexp_replace(out, F.concat(F.lit("(?i)" + before), letter, F.lit(after)), F.lit(""))
    return F.regexp_replace(F.when(letter == "", c).otherwise(out), r"^\s+|\s+$", "")


def normalise(c: Column) -> Column:
    """A choice letter of a longer answer: the first valid letter, else the first character."""
    x = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))
    first = F.regexp_extract(x, "([ABCD])", 1)
    return F.when(F.length(x) > 1, F.when(first != "", first).otherwise(F.left(x, F.lit(1)))).otherwise(x)


def is_valid(c: Column, choices: tuple[str, ...] = CHOICES) -> Column:
    return F.upper(F.trim(c)).isin(*choices)
