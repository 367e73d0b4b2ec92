"""Measurements of inference: documents of metrics, model lists, context scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODELS = "key string, label string, path string"
METRICS = "model_name string, model_size_gb double, timestamp string, summary struct<ttft_ms:double,throughput_tok_s:double,peak_ram_gb:double,model_size_gb:double>"
CONTEXT = "context bigint, ram_gb double"
#: Models by the quantisations that are measured together, as (key, label).
PRESETS = {
    "qwen36_27b": [("qwen36_27b_q4km", "Qwen3.6 27B Q4_K_M"), ("qwen36_27b_q80", "Qwen3.6 27B Q8_0"), ("qwen36_27b_bf16", "Qwen3.6 27B BF16")],
    "gemma4_26b": [("gemma4-26b-a4b-q4", "Gemma4 26B Q4_K_M"), ("gemma4-26b-a4b-q8", "Gemma4 26B Q8_0"), ("gemma4-26b-a4b-bf16", "Gemma4 26B BF16")],
}
DEFAULT_PRESET = "qwen36_27b"


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics documents, one per file: (model_name, model_size_gb, timestamp, and the summary's fields)."""
    docs = spark.read.schema(METRICS).json(path, multiLine=True)
    return docs.select("model_name", "timestamp", "summary.ttft_ms", "summary.throughput_tok_s", "summary.peak_ram_gb", F.coalesce("summary.model_size_gb", "model_size_gb").alias("model_size_gb"))


def write_metrics(stats: DataFrame, path: str) -> None:
    """A document per model, with a summary as read_metrics takes it."""
    summary = F.struct("ttft_ms", "throughput_tok_s", "peak_ram_gb", "model_size_gb")
    stats.select("model_name", "model_size_gb", F.current_timestamp().cast("string").alias("timestamp"), summary.alias("summary")).write.mode("overwrite").json(path)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """A model list from a JSON array of objects; anything else is an error."""
    text = spark.read.text(path, wholetext=True).first()
    if text is None or not text[0].lstrip().startswith("["):
        raise ValueError(f"{path} must hold a JSON array of model objects")
    return spark.read.schema(MODELS).json(path, multiLine=True)


def models(spark: SparkSession, preset: str | None = None, config: str | None = None, path: str | None = None, key: str | None = None, label: str | None = None, folder: str = "models") -> DataFrame:
    """The models to measure: a preset, else a list, else one path, else the default preset."""
    if preset is None and config is not None:
        return read_models(spark, config)
    if preset is None and path is not None:
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        return spark.createDataFrame([(key, label or stem, path)], MODELS)
    return spark.createDataFrame([(k, name, f"{folder}/{k}.gguf") for k, name in PRESETS[preset or DEFAULT_PRESET]], MODELS)


def write_context(df: DataFrame, path: str) -> None:
    df.select("context", "ram_gb").coalesce(1).write.mode("overwrite").json(path)


def read_context(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONTEXT).json(path)


def with_metrics(board: DataFrame, metrics: DataFrame, model: str = "model") -> DataFrame:
    """Models beside their own inference metrics; a model without any has nulls."""
    return board.join(metrics, model, "left")


def run_stats(runs: DataFrame, *by: str) -> DataFrame:
    """Of the successful runs of a benchmark of one prompt: first token time, throughput, memory over the start, tokens."""
    good = runs.where("success")
    stats = [f(c).alias(f"{c}_{n}") for c in ("ttft_ms", "throughput") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    stats += [F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std") for c in ("ttft_ms", "throughput")]
    peak = F.greatest(F.max("post_load_gb"), F.max("ram_gb"))
    memory = [peak.alias("peak_ram_gb"), (peak - F.min("initial_gb")).alias("model_ram_usage_gb"), (F.max("post_load_gb") - F.min("initial_gb")).alias("load_delta_gb")]
    return good.groupBy(*by).agg(*stats, *memory, F.avg("tokens").alias("tokens_mean"), F.sum("tokens").alias("tokens_total"), F.count(F.lit(1)).alias("runs"))


def memory_utilisation(used: Column, whole: Column) -> Column:
    """Percent of memory in use; 0 without memory."""
    return F.when(whole > 0, 100 * used / whole).otherwise(0.0)
