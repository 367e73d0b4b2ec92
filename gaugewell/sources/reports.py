"""Reports and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.leaderboard import export_columns

SCORE = "accuracy double, samples bigint, passed bigint, failed bigint, avg_time_per_sample double, note string, ttft_ms double, throughput_tok_s double, peak_ram_gb double, model_size_gb double, model_ram_usage_gb double, quantization string"
REPORT = f"models map<string,map<string,struct<{', '.join(f'{a}:{b}' for a, b in (x.split() for x in SCORE.split(', ')))}>>>, generated_at string"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(model, pos, benchmark, fields of a score) of a leaderboard document; empty without the file."""
    docs = spark.read.schema(REPORT).json(path, multiLine=True) if exists(spark, path) else spark.createDataFrame([], REPORT)
    models = docs.select(F.posexplode(F.map_entries("models")).alias("pos", "m"))
    return models.select(F.col("m.key").alias("model"), "pos", F.explode("m.value").alias("benchmark", "s")).select("model", "pos", "benchmark", "s.*")


def write_csv(models: DataFrame, path: str) -> None:
    """The table export with its fixed header, in one small file."""
    export_columns(models).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def diagnostics_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("sample_id", "passed", "score", "execution_time", "error"), {"ignoreNullFields": "false"}).alias("json"))


def diagnostics_markdown(summary: dict, categories: list[tuple[str, int]], advice: list[str]) -> str:
    """A report of small collected frames."""
    lines = ["# Diagnostic report", "", *[f"- {k}: {v}" for k, v in summary.items()], "", "| error | count |", "|---|---|"]
    return "\n".join([*lines, *[f"| {k} | {n} |" for k, n in categories], "", *[f"1. {a}" for a in advice], ""])
