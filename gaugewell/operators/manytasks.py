"""Many tasks in one plan: each row is parsed and scored as its task asks, over one scan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calls, refusal, robust
from . import evaluate
from .isolation import RowMetric, RowParser, judged

Plan = Mapping[str, tuple[evaluate.Parser, evaluate.Metric]]


def _groups(tasks: Plan, at: int) -> list[tuple[object, list[str]]]:
    """Parsers (at 0) or metrics (at 1), each once, with the tasks that use them."""
    found: list[tuple[object, list[str]]] = []
    for name, pair in tasks.items():
        own = next((names for x, names in found if x is pair[at] or isinstance(x, str) and x == pair[at]), None)
        if own is None:
            found.append((pair[at], [name]))
        else:
            own.append(name)
    return found


def evaluate_tasks(samples: DataFrame, tasks: Plan, task: str = "task", text: str = "text", reference: str = "reference", tests: str = "test", entry_point: str = "entry_point", timeout: float = 5.0) -> DataFrame:
    """samples with content, confidence, parser_used, refusal_detected, score, passed and error, as evaluate gives them for each row's task.

    tasks: name to (parser, metric), which may be any that evaluate takes; what has no such name is an error before anything runs. Each parser and
    each metric is one branch of the plan that other tasks' rows pass by, so the input is read once and nothing is shuffled, however many
    tasks there are. A row of no task here is an error row. Rows whose finish_reason is error are failures, as in evaluate.
    """
    for parser, metric in tasks.values():
        evaluate.known_parser(parser), evaluate.known_metric(metric)
    names = samples.columns
    of = lambda own: F.coalesce(F.col(task).isin(own), F.lit(False))
    df = samples.withColumn("x_failed", F.coalesce(F.col("finish_reason") == "error", F.lit(False)) if "finish_reason" in names else F.lit(False))
    df = df.withColumn("x_known", of(list(tasks))).withColumn("x_run", F.col("x_known") & ~F.col("x_failed"))
    fault = F.when(F.col("x_failed"), F.coalesce("error", F.lit("generation failed")) if "error" in names else F.lit("generation failed"))
    fault = F.coalesce(fault, F.when(~F.col("x_known"), F.concat(F.lit("no task "), F.coalesce(F.col(task), F.lit("null")))))

    parsed: Column | None = None
    for i, (parser, own) in enumerate(_groups(tasks, 0)):
        mine = of(own) & F.col("x_run")
        df = df.withColumn(f"x_text{i}", F.when(mine, F.coalesce(F.col(text), F.lit(""))))
        if isinstance(parser, RowParser):
            df = judged(df, f"x_text{i}", reference, parser, None, f"x_parsed{i}", mine)
            fault = F.coalesce(fault, F.col(f"x_parsed{i}.error"))
        else:
            if parser == "robust" or isinstance(parser, robust.Chain):
                step = robust.parsed(df, f"x_text{i}", chain=parser if isinstance(parser, robust.Chain) else None)
                df = step.withColumn(f"x_parsed{i}", F.struct("content", "confidence", "parser_used")).drop("content", "confidence", "parser_used")
            else:
                build = parser if callable(parser) else evaluate.PARSERS[parser]
                df = df.withColumn(f"x_parsed{i}", build(F.col(f"x_text{i}")))
        held = F.col(f"x_parsed{i}")
        one = F.when(mine, F.struct(*[held[c].cast(kind).alias(c) for c, kind in (("content", "string"), ("confidence", "double"), ("parser_used", "string"))]))
        parsed = one if parsed is None else F.coalesce(parsed, one)
    df = df.withColumn("x_parsed", parsed).withColumn("x_wrong", fault)
    df = df.select("*", F.when(F.col("x_wrong").isNull(), F.col("x_parsed.content")).alias("content"), "x_parsed.confidence", "x_parsed.parser_used", refusal.is_refusal(F.col(text)).alias("refusal_detected"))

    score, more = F.lit(None).cast("double"), F.col("x_wrong")
    for i, (metric, own) in enumerate(_groups(tasks, 1)):
        mine = of(own) & F.col("x_wrong").isNull()
        pred, ref = F.when(mine, F.col("content")), F.col(reference)
        if isinstance(metric, RowMetric):
            df = judged(df, text, reference, None, metric, f"x_judged{i}", mine)
            value, more = F.col(f"x_judged{i}.score"), F.coalesce(more, F.col(f"x_judged{i}.error"))
        elif metric == "pass_at_k":
            kept = [F.col(c) for c in df.columns]
            inner = df.select(*kept).withColumns({f"x_{k}": F.when(mine, F.col(c)) for k, c in (("tests", tests), ("entry", entry_point))})
            ran = evaluate.scored(inner.withColumnRenamed("error", "x_error_before"), metric, reference, "x_tests", "x_entry", timeout)
            df = ran.withColumnsRenamed({"score": f"x_score{i}", "error": f"x_error{i}"}).drop("passed", "success", "output", "return_code", "timed_out", "x_tests", "x_entry")
            df = df.drop("execution_time") if "execution_time" not in names else df
            df = df.withColumnRenamed("x_error_before", "error")
            value, more = F.col(f"x_score{i}"), F.coalesce(more, F.when(mine, F.col(f"x_error{i}")))
        elif metric == "function_call_match":
            df = calls.with_match(df, pred, F.when(mine, ref), f"x_share{i}")
            value = F.col(f"x_share{i}")
        else:
            rule = metric if callable(metric) else evaluate.RULES[metric]
            value = rule(pred, ref).cast("double")
        score = F.coalesce(score, F.when(mine, F.coalesce(value, F.lit(0.0))))
    part = of([n for n, (_, m) in tasks.items() if m == "function_call_match"])
    out = df.withColumn("score", F.coalesce(score, F.lit(0.0))).withColumn("passed", F.when(part, F.col("score") > 0).otherwise(F.col("score") >= 1)).withColumn("x_error", more)
    if any(isinstance(m, RowMetric) for _, m in tasks.values()):  # a metric that raised leaves no content, as everywhere
        raised = F.coalesce(*[F.col(f"x_judged{i}.error") for i, (m, _) in enumerate(_groups(tasks, 1)) if isinstance(m, RowMetric)])
        out = out.withColumn("content", F.when(raised.isNull(), F.col("content")))
    own_error = F.col("error") if "error" in names else F.lit(None).cast("string")
    kept = [c for c in names if c not in ("error", "content", "confidence", "parser_used", "refusal_detected", "score", "passed")]
    return out.select(*kept, "content", "confidence", "parser_used", "refusal_detected", "score", "passed", F.coalesce("x_error", own_error).alias("error"))
