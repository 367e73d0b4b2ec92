"""Result files as a stream: an extension, as runs append results while they go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_results(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def progress(stream: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Passed and failed per task and window; rows later than late are left out of closed windows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "task").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def first_results(stream: DataFrame, time: str = "ts", late: str = "2 hours") -> DataFrame:
    """The first result of each sample that comes within the watermark; a rerun's repeats go."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["task", "sample_id"])
