"""Token events of requests: time to the first token, throughput and truncation, as a stream or over files that are there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: kind is start, token or end; a token event may have an empty text; the text of end says why a request ended.
EVENTS = "request_id string, kind string, time timestamp, text string"


def _micros(kind: str, f) -> Column:
    return f(F.when(F.col("kind") == kind, F.unix_micros("time")))


def _metrics() -> list[Column]:
    """Of one request, from partial aggregates alone: nothing of it is held but five numbers and a word."""
    start, first, end = _micros("start", F.min), _micros("token", F.min), _micros("end", F.max)
    tokens = F.count_if((F.col("kind") == "token") & (F.coalesce("text", F.lit("")) != ""))
    seconds = (end - start) / 1e6
    return [
        ((first - start) / 1e3).alias("ttft_ms"),
        tokens.alias("tokens"),
        seconds.alias("seconds"),
        F.when(seconds > 0, tokens / seconds).otherwise(0.0).alias("throughput"),
        F.coalesce(F.max(F.when(F.col("kind") == "end", F.col("text") == "length")), F.lit(False)).alias("truncated"),
        end.isNotNull().alias("ended"),
    ]


def requests(events: DataFrame) -> DataFrame:
    """A row per request: ttft_ms (null without a start or a token), tokens with a text, seconds from start to end, throughput in tokens a second
    (0 where that can't be told), truncated (ended for its length) and whether it ended. One shuffle, of partial aggregates."""
    return events.groupBy("request_id").agg(*_metrics())


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_requests(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """The same for a stream, one row for each request once the watermark has passed its last event by gap; state holds open requests only.

    Events later than late are left out and counted (see late_events). A request that is silent for longer than gap is two rows.
    """
    own = F.session_window("time", gap)
    return events.withWatermark("time", late).groupBy(own, "request_id").agg(*_metrics()).drop("session_window")


def late_events(query: StreamingQuery) -> int:
    """Events of a query so far that came after their watermark and were left out."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def summary(requests: DataFrame, *by: str) -> DataFrame:
    """First-token time, throughput and truncation over requests that ended."""
    ended = requests.where("ended")
    rate = F.avg(F.col("truncated").cast("int")).alias("truncated_rate")
    return ended.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), F.avg("ttft_ms").alias("ttft_ms_mean"), F.percentile("ttft_ms", 0.5).alias("ttft_ms_median"), F.sum("tokens").alias("tokens"), F.avg("throughput").alias("throughput_mean"), rate)
