"""Resuming and combining runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def remaining(samples: DataFrame, done: DataFrame, key: str = "idx") -> DataFrame:
    """Samples without a completed result."""
    return samples.join(done.select(key), key, "left_anti")


def combine(restored: DataFrame, new: DataFrame) -> DataFrame:
    return restored.unionByName(new, allowMissingColumns=True)


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; partial maxima go to the shuffle, not all rows."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def newest(df: DataFrame, partition: str, order: str, n: int = 5, tie: str | None = None) -> DataFrame:
    """The newest n of each partition."""
    w = Window.partitionBy(partition).orderBy(F.desc(order), *([tie] if tie else []))
    return df.withColumn("at", F.row_number().over(w)).where(F.col("at") <= n).drop("at")


def first_samples(df: DataFrame, order: str, n: int, valid: str | None = None) -> DataFrame:
    """The first n valid rows in the dataset's order; invalid ones go before the cap."""
    return (df.where(valid) if valid else df).orderBy(order).limit(n)


def left_with_default(questions: DataFrame, answers: DataFrame, key: str, value: str, default: object, order: str) -> DataFrame:
    """Each question with its answer: the last of several, a default without one."""
    last = answers.groupBy(key).agg(F.max_by(value, order).alias(value))
    return questions.join(last, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def completed(df: DataFrame, *by: str, order: str) -> DataFrame:
    """Completed rows of each run and its last one, counted where the results are."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("completed"), F.max(order).alias("timestamp"))
