"""The dashboard's two tables from two kinds of documents: models' benchmarks, and measurements of inference.

Documents are VARIANT, so those of differing shapes are read side by side: a score may be an object or a number, a measurement may
stand in a summary or under the overall metrics, with a mean or as it is. What a document lacks is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.reports import exists

BENCHMARKS = ("humaneval", "hellaswag", "bfcl")
DOCUMENTS = "source string, doc variant"


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """(source, doc) of each file of some paths, whole; none of a path that isn't there. A file that is no JSON has a null doc."""
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "source string").withColumn("doc", F.lit(None).cast("variant"))
    text = spark.read.text(there, wholetext=True)
    return text.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source"), F.try_parse_json("value").alias("doc"))


def _first(v: Column, kind: str, *paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, p, kind) for p in paths])


def scores(docs: DataFrame) -> DataFrame:
    """(model, source, generated_at, benchmark, accuracy, samples): a row per model and benchmark of each document; of documents that tell the same the newest counts, by generated_at and then by source."""
    models = F.map_entries(F.try_variant_get("doc", "$.models", "map<string,variant>"))
    rows = docs.select("source", _first(F.col("doc"), "string", "$.generated_at", "$.timestamp").alias("generated_at"), F.explode(models).alias("m"))
    rows = rows.select("source", "generated_at", F.col("m.key").alias("model"), F.explode(F.map_entries(F.try_variant_get("m.value", "$", "map<string,variant>"))).alias("b"))
    v = F.col("b.value")
    told = rows.select("model", F.col("b.key").alias("benchmark"), "source", "generated_at", _first(v, "double", "$.accuracy", "$").alias("accuracy"), _first(v, "long", "$.samples", "$.total").alias("samples"))
    order = F.struct(F.coalesce("generated_at", F.lit("")).alias("at"), "source")
    newest = told.groupBy("model", "benchmark").agg(F.max_by(F.struct("source", "generated_at", "accuracy", "samples"), order).alias("x"))
    return newest.select("model", "benchmark", "x.*")


def leaderboard(docs: DataFrame, benchmarks: tuple[str, ...] = BENCHMARKS) -> DataFrame:
    """A row per model: percents and samples of each benchmark (0 where it has none), and the mean of its positive percents."""
    rows = scores(docs)
    one = lambda b, c: F.max(F.when(F.col("benchmark") == b, c))
    columns = [F.coalesce(one(b, F.col("accuracy") * 100), F.lit(0.0)).alias(b) for b in benchmarks]
    counts = [F.coalesce(one(b, F.col("samples")), F.lit(0)).alias(f"{b}_samples") for b in benchmarks]
    positive = F.avg(F.when(F.col("benchmark").isin(*benchmarks) & (F.col("accuracy") > 0), F.col("accuracy") * 100))
    return rows.groupBy("model").agg(*columns, F.coalesce(positive, F.lit(0.0)).alias("avg_accuracy"), *counts)


def measurements(docs: DataFrame) -> DataFrame:
    """(model, ttft_ms, throughput, source): the newest measurement of each model, whatever shape its document has."""
    v = F.col("doc")
    ttft = _first(v, "double", "$.summary.ttft_ms", "$.overall_metrics.ttft_ms.mean", "$.overall_metrics.ttft_ms", "$.ttft_ms")
    rate = _first(v, "double", "$.summary.throughput_tok_s", "$.overall_metrics.throughput_tokens_per_sec.mean", "$.overall_metrics.throughput_tokens_per_sec", "$.throughput")
    rows = docs.select(_first(v, "string", "$.model_name", "$.model", "$.config.model").alias("model"), ttft.alias("ttft_ms"), rate.alias("throughput"), "source", _first(v, "string", "$.timestamp", "$.generated_at").alias("at"))
    order = F.struct(F.coalesce("at", F.lit("")).alias("at"), "source")
    return rows.where("model is not null").groupBy("model").agg(F.max_by(F.struct("ttft_ms", "throughput", F.col("source").alias("measured_in")), order).alias("x")).select("model", "x.*")


def combined(docs: DataFrame, measured: DataFrame, benchmarks: tuple[str, ...] = BENCHMARKS) -> DataFrame:
    """The leaderboard with each model's own first-token time and throughput, and the document they come from; null for a model that nobody measured."""
    return leaderboard(docs, benchmarks).join(measurements(measured), "model", "left")


def histogram(rows: DataFrame, column: str, at: str) -> DataFrame:
    """How often each value occurs, most frequent first, equal ones by where they come first; counted where the rows are."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at")).orderBy(F.desc("n"), "first_at")
