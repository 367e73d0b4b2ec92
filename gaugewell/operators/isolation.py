"""Parsers and metrics that a user writes in Python for one row: what raises is that row's failure and nobody else's."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JUDGED = "content string, confidence double, parser_used string, score double, error string"


@dataclass(frozen=True)
class RowParser:
    """parse takes a text (a null one is empty) to its content, or to (content, confidence); pre changes the text before and post the content after."""

    parse: Callable[[str], object]
    name: str = "custom"
    pre: Callable[[str], str] | None = None
    post: Callable[[object], object] | None = None

    def __call__(self, text: str) -> tuple[str | None, float]:
        got = self.parse(self.pre(text) if self.pre else text)
        content, confidence = got if isinstance(got, tuple) else (got, 1.0)
        content = self.post(content) if self.post and content is not None else content
        return None if content is None else str(content), float(confidence) if content is not None else 0.0


@dataclass(frozen=True)
class RowMetric:
    """score takes (content, reference), either of which may be null, to a number or a boolean; 1 or more passes."""

    score: Callable[[str | None, str | None], float | bool]


def _fault(step: str, e: Exception) -> str:
    return f"{step}: {type(e).__name__}: {e}".strip().removesuffix(":")


def judged(df: DataFrame, text: str, reference: str, parser: RowParser | None, metric: RowMetric | None, name: str = "x_judged", where: Column | None = None) -> DataFrame:
    """df with a struct of JUDGED, made row by row in one vectorised pass.

    A row whose parser or metric raises has null content, confidence and score 0 and what went wrong as error; that a score is no number is
    such a fault too. Without a parser the columns content, confidence and parser_used are taken as they are; without a metric score is null. Rows for which where
    doesn't hold are passed over, with null fields.
    """

    def row(own: str | None, content: str | None, confidence: float, used: str | None, ref: str | None) -> tuple:
        step = "parser"
        try:
            if parser:
                content, confidence = parser(own or "")
                used = parser.name
            score = None
            if metric:
                step = "metric"
                score = float(metric.score(content, ref))
                if score != score:
                    raise ValueError("the score is no number")
        except Exception as e:  # noqa: BLE001  any failure of a user's function is its row's failure
            return None, 0.0, parser.name if parser else used, 0.0, _fault(step, e)
        return content, confidence, used, score, None

    @F.pandas_udf(JUDGED)
    def run(wanted: pd.Series, own: pd.Series, content: pd.Series, confidence: pd.Series, used: pd.Series, ref: pd.Series) -> pd.DataFrame:
        none = lambda x: None if isinstance(x, float) and x != x else x
        rows = [row(*(none(v) for v in r)) if w else (None,) * 5 for w, *r in zip(wanted, own, content, confidence, used, ref, strict=True)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in JUDGED.split(", ")]).astype({"confidence": "Float64", "score": "Float64"})

    held = [F.col(c) if parser is None else F.lit(None).cast(kind) for c, kind in (("content", "string"), ("confidence", "double"), ("parser_used", "string"))]
    ref = F.col(reference).cast("string") if reference in df.columns else F.lit(None).cast("string")
    wanted = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return df.withColumn(name, run(wanted, F.col(text).cast("string"), *held, ref))
