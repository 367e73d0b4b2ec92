"""One answer from free text by several parsers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import choice, code, jsons, refusal
from .text import strip


BUILT_IN = ("code", "mc", "json")


@dataclass(frozen=True)
class Chain:
    """Parsers in order of trial, by name; own ones are functions of a text column to struct(content, confidence, parser_used)."""

    order: tuple[str, ...] = BUILT_IN
    own: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    least: float = 0.5

    def __post_init__(self) -> None:
        unknown = [p for p in self.order if p not in BUILT_IN and p not in self.own]
        if unknown or not self.order or len(set(self.order)) < len(self.order):
            raise ValueError(f"unknown, repeated or no parsers: {', '.join(unknown or self.order) or 'none'}; known: {', '.join([*BUILT_IN, *self.own])}")

    def add(self, name: str, parser: Callable[[Column], Column], at: int | None = None) -> Chain:
        """With one more parser, at a place or last; a name that is there is replaced."""
        left = [p for p in self.order if p != name]
        left.insert(len(left) if at is None else at, name)
        return replace(self, order=tuple(left), own=self.own | {name: parser})

    def without(self, name: str) -> Chain:
        return replace(self, order=tuple(p for p in self.order if p != name), own={k: v for k, v in self.own.items() if k != name})

    def ordered(self, *names: str) -> Chain:
        return replace(self, order=names)


def _result(content: Column, confidence: Column, parser: str) -> Column:
    return F.struct(content.alias("content"), confidence.alias("confidence"), F.lit(parser).alias("parser_used"))


def attempts(c: Column) -> dict[str, Column]:
    """Every parser's own result."""
    letter = choice.extract(c)
    return {
        "code": _result(code.extract(c), code.confidence(c), "code"),
        "mc": _result(letter, choice.confidence(c, letter), "mc"),
        "json": _result(jsons.extract(c), jsons.confidence(c), "json"),
    }


def parse(c: Column, order: tuple[str, ...] = ("code", "mc", "json"), least: float = 0.5) -> Column:
    """A refusal keeps its text; else the first parser that is confident enough, else the most confident, else the text."""
    found = attempts(c)
    ladder = [F.when(found[p]["confidence"] >= least, found[p]) for p in order]
    # by confidence, then by the parsers' order
    best = F.array_sort(F.array(*[F.struct((-found[p]["confidence"]).alias("w"), F.lit(i).alias("i"), found[p].alias("r")) for i, p in enumerate(order)]))[0]["r"]
    refused = _result(strip(F.coalesce(c, F.lit(""))), F.lit(0.3), "refusal_fallback")
    return F.when(refusal.is_refusal(c), refused).otherwise(F.coalesce(*ladder, best))


def parsed(df: DataFrame, text: str, order: tuple[str, ...] = BUILT_IN, least: float = 0.5, chain: Chain | None = None) -> DataFrame:
    """df with content, confidence and parser_used as parse gives them, by a chain's parsers or the built-in ones in an order.

    Each step is a column of its own, computed once and only for rows that no step before has settled; where the last is
    reached and none was confident, the most confident one counts.
    """
    chain = chain or Chain(tuple(order), least=least)
    order, least = chain.order, chain.least
    names = df.columns
    at = {p: f"x_own_{i}" if p in chain.own else f"x_{p}" for i, p in enumerate(order)}
    out = df.withColumn("x_refused", refusal.is_refusal(F.col(text))).withColumn("x_open", F.when(~F.col("x_refused"), F.coalesce(text, F.lit(""))))
    for p in order:
        c = F.col("x_open")
        if p in chain.own:
            out = out.withColumn("x_given", F.when(c.isNotNull(), chain.own[p](c)))
            out = out.withColumn(at[p], F.col("x_given.content")).withColumn(f"{at[p]}_conf", F.when(c.isNotNull(), F.coalesce(F.col("x_given.confidence").cast("double"), F.lit(0.0))))
        elif p == "code":
            out = code.with_blocks(out, "x_open", "x_blocks")
            out = out.withColumn("x_code", code.pick(c, F.col("x_blocks"))).withColumn("x_code_conf", F.when(c.isNotNull(), code.confidence_of(c, F.col("x_blocks"))))
        elif p == "mc":
            out = out.withColumn("x_mc", F.when(c.isNotNull(), choice.extract(c)))
            out = out.withColumn("x_mc_conf", F.when(c.isNotNull(), choice.confidence(c, F.col("x_mc"))))
        else:
            out = jsons.with_json(out, "x_open", "x_json", "x_json_conf")
        out = out.withColumn("x_open", F.when(F.col(f"{at[p]}_conf") < least, c))
    ladder = [F.when(F.col(f"{at[p]}_conf") >= least, F.struct(F.col(at[p]).alias("content"), F.col(f"{at[p]}_conf").cast("double").alias("confidence"), F.lit(p).alias("parser_used"))) for p in order]
    best = F.array_sort(F.array(*[F.struct((-F.col(f"{at[p]}_conf")).cast("double").alias("w"), F.lit(i).alias("i"), F.struct(F.col(at[p]).alias("content"), F.col(f"{at[p]}_conf").cast("double").alias("confidence"), F.lit(p).alias("parser_used")).alias("r")) for i, p in enumerate(order)]))[0]["r"]
    refused = _result(strip(F.coalesce(text, F.lit(""))), F.lit(0.3), "refusal_fallback")
    out = out.withColumn("x_result", F.when(F.col("x_refused"), refused).otherwise(F.coalesce(*ladder, best)))
    return out.select(*names, "x_result.content", "x_result.confidence", "x_result.parser_used")
