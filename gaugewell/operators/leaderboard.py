"""Leaderboards of models: projections, ranks, upserts, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring

BENCHMARKS = ["humaneval", "hellaswag", "bfcl"]
#: The order of quantisations.
ORDER = {"BF16": 0, "Q8_0": 1, "Q4_K_M": 2, "Q4": 2}
#: Fixed values: (part of a model's name, its display name), in order of trial.
DISPLAY = [("qwen36_27b", "Qwen 3.6 27B"), ("qwen3.6", "Qwen 3.6 35B A3B"), ("qwen3.5", "Qwen 3.5 35B A3B"), ("gemma4", "Gemma 4 26B A4B")]
#: Fixed values: (exported name, our column) of the table export.
EXPORT = [("Rank", "display_rank"), ("Model", "display_name"), ("Quantization", "quantization"), ("HumanEval %", "humaneval"), ("HellaSwag %", "hellaswag"), ("BFCL %", "bfcl"), ("Avg Accuracy %", "avg_accuracy"), ("TTFT (ms)", "ttft_ms"), ("Throughput (tok/s)", "throughput"), ("Memory (GB)", "peak_ram_gb")]


def quantization(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("bf16"), "BF16").when(low.contains("q8"), "Q8_0").otherwise("Q4_K_M")


def display_name(name: Column) -> Column:
    low, out = F.lower(name), name
    for part, shown in reversed(DISPLAY):
        out = F.when(low.contains(part), F.concat(F.lit(f"{shown} ("), quantization(name), F.lit(")"))).otherwise(out)
    return out


def rank_of(quant: Column) -> Column:
    out = F.lit(99)
    for q, r in ORDER.items():
        out = F.when(quant == q, r).otherwise(out)
    return out


def averages(scores: DataFrame, *by: str) -> DataFrame:
    """The mean of a model's positive accuracies, in percent."""
    return scores.groupBy(*by).agg(F.coalesce(F.round(F.avg(F.when(F.col("accuracy") > 0, F.col("accuracy") * 100)), 2), F.lit(0.0)).alias("avg_accuracy"))


def wide(scores: DataFrame, *by: str) -> DataFrame:
    """A row per model with a percent column for each benchmark, 0 where it lacks one; one aggregation."""
    each = [F.coalesce(F.round(F.max(F.when(F.col("benchmark") == b, F.col("accuracy") * 100)), 2), F.lit(0.0)).alias(b) for b in BENCHMARKS]
    average = F.coalesce(F.round(F.avg(F.when(F.col("accuracy") > 0, F.col("accuracy") * 100)), 2), F.lit(0.0))
    return scores.groupBy(*by).agg(*each, average.alias("avg_accuracy"))


def display_rank(models: DataFrame, position: str = "pos") -> DataFrame:
    """Ranked by quantisation; equal ones keep the document's order."""
    return models.withColumn("display_rank", F.row_number().over(Window.orderBy(rank_of(F.col("quantization")), position)))


def ranked(models: DataFrame) -> DataFrame:
    """Ranked by mean accuracy, with medals for the first three."""
    at = F.row_number().over(Window.orderBy(F.desc("avg_accuracy"), "model"))
    out = models.withColumn("rank", at)
    return out.withColumn("medal", F.when(F.col("rank") == 1, "gold").when(F.col("rank") == 2, "silver").when(F.col("rank") == 3, "bronze"))


def score_class(percent: Column) -> Column:
    return F.when(percent >= 70, "high").when(percent >= 50, "medium").otherwise("low")


def status(rate: Column) -> Column:
    return F.when(rate >= 0.8, "good").when(rate >= 0.5, "fair").otherwise("poor")


def recommend(models: DataFrame, benchmark: str | None = None, speed: bool = False, small: bool = False, top: int = 3) -> DataFrame:
    """The top models for a question, by composite score; a sort of the first few only."""
    score = scoring.recommendation(F.col("avg_accuracy"), F.col("throughput"), F.col("ttft_ms"), F.col("peak_ram_gb"), F.col(benchmark) if benchmark else None, speed, small)
    return models.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "pos").limit(top)


def against_baseline(models: DataFrame, family: str, quant: str, size: str, speed: str, baseline: str) -> DataFrame:
    """Each variant beside its family's baseline: speed-up and size saved."""
    base = models.where(F.col(quant) == baseline).groupBy(family).agg(F.avg(speed).alias("base_speed"), F.avg(size).alias("base_size"))
    own = models.where(F.col(quant) != baseline).groupBy(family, quant).agg(F.avg(speed).alias("own_speed"), F.avg(size).alias("own_size"))
    joined = own.join(base, family)
    return joined.select(family, quant, F.round(F.try_divide("own_speed", "base_speed"), 6).alias("speedup"), F.round(1 - F.try_divide("own_size", "base_size"), 6).alias("size_saving"))


def upsert(board: DataFrame, measured: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Measured values over the board's; keys that the board lacks are left out (see skipped)."""
    new = measured.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = board.join(new, key, "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in board.columns])


def skipped(board: DataFrame, measured: DataFrame, key: str) -> DataFrame:
    return measured.join(board, key, "left_anti")


def replace(board: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The board with the rows of new in place of its own."""
    return board.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def totals(scores: DataFrame) -> DataFrame:
    return scores.agg(F.sum("samples").alias("total_samples_evaluated"), F.countDistinct("model").alias("models_compared"))


def export_columns(models: DataFrame) -> DataFrame:
    return models.select(*[F.col(ours).alias(name) for name, ours in EXPORT])


def detail(scores: DataFrame) -> DataFrame:
    """A readable row per model and benchmark."""
    return scores.select("model", "benchmark", F.format_string("%.2f%%", F.col("accuracy") * 100).alias("accuracy_text"), status(F.col("accuracy")).alias("status"))


#: The models that the board shows.
TARGETS = ["qwen3.6-35b-a3b", "qwen3.6-35b-a3b-q8", "qwen3.6-35b-a3b-bf16", "qwen36_27b_q4km", "qwen36_27b_q80", "qwen36_27b_bf16", "qwen3.5-35b-a3b", "qwen3.5-35b-a3b-q8", "qwen3.5-35b-a3b-bf16", "gemma4-26b-a4b-q4", "gemma4-26b-a4b-q8", "gemma4-26b-a4b-bf16"]


def targets(df: DataFrame, model: str = "model", names: list[str] | None = None) -> DataFrame:
    """Rows of the models that the board shows."""
    return df.where(F.col(model).isin(*(TARGETS if names is None else names)))


def measured(models: DataFrame, throughput: str = "throughput") -> DataFrame:
    """Models whose throughput is known."""
    return models.where(F.col(throughput).isNotNull())


def compact(models: DataFrame) -> DataFrame:
    """What an assistant is told of each model."""
    names = {"name": "display_name", "avg_accuracy": "avg_accuracy", "humaneval": "humaneval", "hellaswag": "hellaswag", "bfcl": "bfcl", "throughput_tok_s": "throughput", "ttft_ms": "ttft_ms", "memory_gb": "memory_gb", "model_size_gb": "model_size_gb"}
    return models.select(*[(F.col(old) if old in models.columns else F.lit(None).cast("double")).alias(new) for new, old in names.items()])


def detail_rows(scores: DataFrame) -> DataFrame:
    """A readable row per model and benchmark: accuracy, passed, total, time or N/A, and whether there is a result."""
    time = F.when(F.coalesce("avg_time", F.lit(0.0)) > 0, F.format_string("%.1fs", "avg_time")).otherwise("N/A")
    done = F.when(F.coalesce("accuracy", F.lit(0.0)) > 0, "Complete").otherwise("Pending")
    accuracy = F.format_string("%.2f%%", F.coalesce("accuracy", F.lit(0.0)) * 100)
    return scores.select("model", F.upper("benchmark").alias("benchmark"), accuracy.alias("accuracy"), F.coalesce("passed", F.lit(0)).alias("passed"), F.coalesce("samples", F.lit(0)).alias("total"), time.alias("avg_time"), done.alias("status"))
