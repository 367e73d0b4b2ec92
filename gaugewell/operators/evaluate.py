"""The evaluator: samples to prompts, generated text, parsed answers, refusal flags and scores, one column after another."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calls, choice, code, jsons, refusal, robust, scoring
from ..sources import runlog
from . import execution, resume
from .isolation import RowMetric, RowParser, judged

PARSED = "struct<content:string,confidence:double,parser_used:string>"


def _parsed(content: Column, confidence: Column, name: str) -> Column:
    return F.struct(content.alias("content"), confidence.cast("double").alias("confidence"), F.lit(name).alias("parser_used"))


def _letter(c: Column) -> Column:
    letter = choice.extract(c)
    return _parsed(letter, choice.confidence(c, letter), "mc")


#: Parsers by name: a text to struct(content, confidence, parser_used).
PARSERS: dict[str, Callable[[Column], Column]] = {
    "robust": robust.parse,
    "code": lambda c: _parsed(code.extract(c), code.confidence(c), "code"),
    "mc": _letter,
    "json": lambda c: _parsed(jsons.extract(c), jsons.confidence(c), "json"),
    "raw": lambda c: _parsed(c, F.when(c.isNull(), 0.0).otherwise(1.0), "raw"),
}


#: Metrics by name: (content, reference) to a score or a boolean. pass_at_k and function_call_match need more than these two.
RULES: dict[str, Callable[[Column, Column], Column]] = {
    "multiple_choice": scoring.choice,
    "json_validity": lambda p, r: scoring.json_validity(p),
    "exact_match": scoring.equal,
    "composite": scoring.equal,
    "default": scoring.equal,
}
METRICS = (*RULES, "pass_at_k", "function_call_match")
Parser = str | robust.Chain | RowParser | Callable[[Column], Column]
Metric = str | RowMetric | Callable[[Column, Column], Column]


def known_parser(parser: Parser) -> Parser:
    """The parser, if it is one; an unknown name is an error before anything runs."""
    if isinstance(parser, str) and parser not in PARSERS:
        raise ValueError(f"unknown parser {parser}; known: {', '.join(PARSERS)}")
    return parser


def known_metric(metric: Metric) -> Metric:
    if isinstance(metric, str) and metric not in METRICS:
        raise ValueError(f"unknown metric {metric}; known: {', '.join(METRICS)}")
    return metric


def parsed(df: DataFrame, text: str, parser: str | robust.Chain | Callable[[Column], Column] = "robust") -> DataFrame:
    """df with content, confidence, parser_used and refusal_detected of a text column, each computed once. A chain takes parsers of one's own into the robust one."""
    known_parser(parser)
    if parser == "robust" or isinstance(parser, robust.Chain):
        df = robust.parsed(df, text, chain=parser) if isinstance(parser, robust.Chain) else robust.parsed(df, text)
    elif parser == "json":
        df = jsons.with_json(df.withColumn("x_text", F.coalesce(text, F.lit(""))), "x_text", "content", "confidence").withColumn("parser_used", F.lit("json")).drop("x_text")
    else:
        build = parser if callable(parser) else PARSERS[parser]
        df = df.withColumn("x_parsed", build(F.col(text))).select("*", "x_parsed.content", "x_parsed.confidence", "x_parsed.parser_used").drop("x_parsed")
    return df.withColumn("refusal_detected", refusal.is_refusal(F.col(text)))


def scored(df: DataFrame, metric: str | Callable[[Column, Column], Column], reference: str = "reference", tests: str = "test", entry_point: str = "entry_point", timeout: float = 5.0) -> DataFrame:
    """df, which has content, with score and passed.

    metric: pass_at_k (content and tests run in the sandbox; rows with null tests compare with the reference), multiple_choice,
    exact_match, composite and default (the content equals the reference), json_validity, function_call_match (reference as JSON), or a function of (content, reference)
    to a score, of which 1 passes. Rows to run without code, or without an entry point for a check(), are not passed and say why. Execution adds success, output, error, return_code, execution_time and timed_out.
    """
    pred, ref = F.col("content"), F.col(reference)
    if metric == "pass_at_k":
        parts = pred, F.col(tests), F.col(entry_point)
        fault = F.when(F.col(tests).isNotNull(), execution.script_fault(*parts))
        script = F.when(fault.isNull(), execution.test_script(*parts))
        ran = execution.sandbox(df.drop("error", "execution_time").withColumn("x_fault", fault).withColumn("x_script", script), "x_script", timeout)
        passed = F.when(F.col(tests).isNull(), scoring.equal(pred, ref)).otherwise(F.col("success") & F.col("x_fault").isNull())
        ran = ran.withColumn("error", F.coalesce("x_fault", "error")).withColumn("passed", F.coalesce(passed, F.lit(False)))
        return ran.withColumn("score", F.col("passed").cast("double")).drop("x_script", "x_fault")
    if metric == "function_call_match":
        out = calls.with_match(df, pred, ref, "score")
        return out.withColumn("passed", F.col("score") > 0)
    rule = metric if callable(metric) else RULES[known_metric(metric)]
    out = df.withColumn("score", F.coalesce(rule(pred, ref).cast("double"), F.lit(0.0)))
    return out.withColumn("passed", F.col("score") >= 1)


def evaluate(samples: DataFrame, metric: Metric, parser: Parser = "robust", client: Callable[[str], tuple[str, int, str]] | None = None, prompt: str = "prompt", text: str = "text", **options: object) -> DataFrame:
    """Samples to results: generate with client (or read the text that samples have), parse, flag refusals, score.

    A refusal only flags a row. A row whose generation failed (finish_reason error), or whose RowParser or RowMetric
    raised, is an error row: content is null, score 0, not passed, with an error text. Rows fail alone; none is dropped.
    """
    known_parser(parser), known_metric(metric)
    df = execution.generate(samples, client, prompt) if client else samples
    failed = F.coalesce(F.col("finish_reason") == "error", F.lit(False)) if "finish_reason" in df.columns else F.lit(False)
    df = df.withColumn("x_failed", failed)
    fault = F.when(F.col("x_failed"), F.coalesce("error", F.lit("generation failed")) if "error" in df.columns else F.lit("generation failed"))
    own_parser, own_metric = (x if isinstance(x, kind) else None for x, kind in ((parser, RowParser), (metric, RowMetric)))
    if not own_parser:
        df = parsed(df, text, parser)
    if own_parser or own_metric:
        df = judged(df, text, str(options.get("reference", "reference")), own_parser, own_metric)
        if own_parser:
            df = df.select("*", "x_judged.content", "x_judged.confidence", "x_judged.parser_used", refusal.is_refusal(F.col(text)).alias("refusal_detected"))
        fault = F.coalesce(fault, F.col("x_judged.error"))
    df = df.withColumn("x_wrong", fault)
    for c, kept in (("content", F.col("x_wrong").isNull()), ("confidence", ~F.col("x_failed")), ("parser_used", ~F.col("x_failed"))):
        df = df.withColumn(c, F.when(kept, F.col(c)))
    if own_metric:
        out = df.withColumn("score", F.coalesce("x_judged.score", F.lit(0.0))).withColumn("passed", F.col("score") >= 1)
    else:
        out = scored(df, metric, **options)
    error = F.col("error") if "error" in out.columns else F.lit(None).cast("string")
    right = F.col("x_wrong").isNull()
    out = out.withColumn("error", F.coalesce("x_wrong", error)).withColumn("score", F.when(right, F.col("score")).otherwise(0.0)).withColumn("passed", F.col("passed") & right)
    return out.drop("x_failed", "x_wrong", "x_judged")


def quick_choice_accuracy(df: DataFrame, text: str, reference: str) -> DataFrame:
    """One call: the accuracy of the letters in a text column."""
    out = scored(parsed(df, text, "mc"), "multiple_choice", reference)
    return out.agg(F.avg(F.col("passed").cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("correct"))


def run(samples: DataFrame, evaluate_rows: Callable[[DataFrame], DataFrame], root: str, task: str, model: str, every: int = 1000, key: str = "idx", metadata: dict | None = None) -> DataFrame:
    """All results of a run that may have been interrupted: what its log has, and the rest in steps of about every samples.

    Each step is appended to the run's log (see runlog), so a run writes each result once, and a crash loses the step it was in. Samples are
    told by key, a number from 0; those with a result are not evaluated again. A step that can't be saved is a warning: its results are in what is returned
    and will be evaluated again by the next run. The driver loops over steps, of which there are as many as key ranges with samples left, and holds no row.
    """
    log = runlog.RunLog(samples.sparkSession, root, task, model)
    done = log.rows(key)
    left = resume.remaining(samples, done, key) if done is not None else samples
    steps = [r[0] for r in left.select(F.floor(F.col(key) / every).alias("step")).distinct().orderBy("step").collect()]
    unsaved = []
    for step in steps:
        new = evaluate_rows(left.where(F.floor(F.col(key) / every) == step))
        try:
            log.append(new, metadata)
        except Exception as e:  # noqa: BLE001  whatever a store may raise; results don't depend on it
            warnings.warn(f"step {step} of {task}, {model} is not saved: {type(e).__name__}: {e}", stacklevel=2)
            unsaved.append(new)
    if not unsaved and steps:
        log.finish(metadata)
    done = log.rows(key)
    parts = ([] if done is None else [done]) + unsaved
    return reduce(resume.combine, parts) if parts else evaluate_rows(samples)
