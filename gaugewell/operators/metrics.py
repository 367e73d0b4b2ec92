"""Metrics over evaluation results: one aggregation each, partial before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from .running import running_sums


def _n(c: Column) -> Column:
    return F.coalesce(F.count_if(c), F.lit(0)).cast("long")


def core(df: DataFrame, *by: str, passed: str = "passed", time: str = "execution_time") -> DataFrame:
    """accuracy, total, passed, failed and mean time; zeros for an empty input without groups."""
    p = F.col(passed)
    return df.groupBy(*by).agg(
        F.coalesce(F.avg(p.cast("int")), F.lit(0.0)).alias("accuracy"),
        F.count(F.lit(1)).alias("total"),
        _n(p).alias("passed"),
        _n(~p).alias("failed"),
        F.coalesce(F.avg(time), F.lit(0.0)).alias("avg_execution_time"),
    )


def summary(df: DataFrame, *by: str) -> DataFrame:
    """core() with refusals and parsing errors."""
    p = F.col("passed")
    return df.groupBy(*by).agg(
        F.coalesce(F.avg(p.cast("int")), F.lit(0.0)).alias("accuracy"),
        F.count(F.lit(1)).alias("total_samples"),
        _n(p).alias("passed"),
        _n(~p).alias("failed"),
        _n(F.col("refusal_detected")).alias("refusals"),
        _n(F.coalesce(F.col("parse_error"), F.lit("")) != "").alias("parsing_errors"),
    )


def rollup(df: DataFrame, by: str) -> DataFrame:
    """Per group and over all (null)."""
    return df.rollup(by).agg(F.count(F.lit(1)).alias("total"), _n(F.col("passed")).alias("passed"), _n(~F.col("passed")).alias("failed"), F.avg(F.col("passed").cast("int")).alias("accuracy"))


def accuracy(df: DataFrame, match: Column) -> DataFrame:
    return df.agg(F.coalesce(F.avg(match.cast("int")), F.lit(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("total"), _n(match).alias("correct"))


def per_choice(df: DataFrame, ref: str, pred: str) -> DataFrame:
    return df.groupBy(ref).agg(F.avg((F.col(ref) == F.col(pred)).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, ref: str, pred: str) -> DataFrame:
    return df.groupBy(ref, pred).agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, pred: str) -> DataFrame:
    return df.groupBy(pred).agg(F.count(F.lit(1)).alias("n"))


def choice_errors(df: DataFrame, ref: str, pred: str) -> DataFrame:
    """Rows whose raw prediction is not the raw reference."""
    return df.where(~F.col(pred).eqNullSafe(F.col(ref)))


def positional(predictions: DataFrame, references: DataFrame, at: str) -> DataFrame:
    """Predictions beside references by position; both sides must have the same rows."""
    a, b = predictions.count(), references.count()
    if a != b:
        raise ValueError(f"{a} predictions for {b} references")
    return predictions.join(references, at)


def pass_at_k(df: DataFrame, ks: tuple[int, ...] = (1, 10, 100)) -> DataFrame:
    """Ungrouped: n rows, c of them passed."""
    one = df.agg(F.count(F.lit(1)).alias("n"), _n(F.col("passed")).alias("c"))
    return one.select("n", "c", F.explode(F.array(*map(F.lit, ks))).alias("k")).withColumn("pass_at_k", scoring.pass_at_k(F.col("n"), F.col("c"), F.col("k")))


def pass_any(df: DataFrame, by: str) -> DataFrame:
    """Grouped as the reference has it: a group counts 1 if any attempt passed, whatever k."""
    groups = df.groupBy(by).agg(F.max(F.col("passed").cast("int")).alias("any_passed"))
    return groups.agg(F.avg("any_passed").alias("pass_at_k"), F.count(F.lit(1)).alias("total"), F.sum("any_passed").alias("correct"))


def pass_at_k_by(df: DataFrame, by: str, ks: tuple[int, ...]) -> DataFrame:
    """The mean over groups of each group's pass@k."""
    groups = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), _n(F.col("passed")).alias("c"))
    long_ = groups.select("n", "c", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    return long_.groupBy("k").agg(F.avg(scoring.pass_at_k(F.col("n"), F.col("c"), F.col("k"))).alias("pass_at_k"), F.count(F.lit(1)).alias("total"))


def latency(df: DataFrame, *by: str) -> DataFrame:
    """Mean, deviation, least and most of first-token time and throughput; rolled up over by."""
    stats = []
    for c in ("ttft_ms", "throughput"):
        stats += [F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    grouped = df.rollup(*by) if by else df.groupBy()
    return grouped.agg(*stats, F.sum("tokens").alias("tokens_total"), F.count(F.lit(1)).alias("runs"))


def latency_per_prompt(df: DataFrame, by: str, raw: bool = False) -> DataFrame:
    """One row per prompt; raw adds its measurements, which are few per prompt by design."""
    stats = [F.avg("ttft_ms").alias("ttft_mean"), F.coalesce(F.stddev_samp("ttft_ms"), F.lit(0.0)).alias("ttft_std"), F.avg("throughput").alias("throughput_mean"), F.coalesce(F.stddev_samp("throughput"), F.lit(0.0)).alias("throughput_std"), F.avg("tokens").alias("tokens_mean")]
    return df.groupBy(by).agg(*stats, *([F.collect_list("ttft_ms").alias("ttft_raw")] if raw else []))


def peak_memory(df: DataFrame, *by: str) -> DataFrame:
    """The most of loading and of all passes, and its rise over the start."""
    peak = F.greatest(F.max("post_load_gb"), F.max("rss_gb"))
    return df.groupBy(*by).agg(peak.alias("peak_ram_gb"), (peak - F.min("initial_gb")).alias("ram_usage_gb"))


def memory_by_context(df: DataFrame, context: str, memory: str) -> DataFrame:
    return df.groupBy(context).agg(F.max(memory).alias("ram_gb"))


def running_counts(df: DataFrame, partition: str, order: str) -> DataFrame:
    """Passed and failed so far, as a run goes on; order is a number. A run of any length goes to many tasks."""
    return running_sums(df, {"passed_so_far": F.col("passed").cast("int"), "failed_so_far": (~F.col("passed")).cast("int")}, order, partition)


def counters(df: DataFrame) -> DataFrame:
    return df.agg(_n(F.col("finish_reason") == "length").alias("truncated"), _n(F.col("pred") == "").alias("empty_predictions"), F.count(F.lit(1)).alias("total"))


def wide(long_: DataFrame, key: str, name: str, value: str, columns: list[str] | None = None) -> DataFrame:
    """Metrics of different tasks side by side; what a task lacks is N/A. Without columns, all names that occur, sorted."""
    if columns is None:
        columns = [r[0] for r in long_.select(name).distinct().orderBy(name).collect()]
    out = long_.groupBy(key).pivot(name, columns).agg(F.first(value))
    return out.select(key, *[F.when(F.col(c).isNull(), "N/A").otherwise(F.format_string("%.4f", F.col(c))).alias(c) for c in columns])
