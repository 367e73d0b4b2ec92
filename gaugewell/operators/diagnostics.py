"""Why samples fail: patterns, categories, recommendations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import any_of

#: What each family of errors says, over lower-cased text.
FAMILIES = {
    "syntax_error": [r"syntax\s*error", r"unexpected\s+token", r"invalid\s+syntax", r"indentation\s*error"],
    "timeout": [r"timeout", r"timed\s*out", r"exceeded"],
    "runtime_error": [r"runtime\s*error", r"exception", r"traceback", r"error:\s*"],
    "refusal": [r"i\s+cannot", r"i\s+can't", r"i\s+am\s+unable", r"i'm\s+unable"],
    "empty_output": [r"^\s*$", r"no\s+output", r"empty"],
    "wrong_format": [r"format", r"expected", r"invalid\s+format"],
}
#: Limits of the pass rate and what each means.
ADVICE = [
    (0.3, "CRITICAL: Very low pass rate. Model may not be suitable for this task. Consider using a larger model or fine-tuning."),
    (0.6, "WARNING: Below average performance. Review prompt engineering and consider few-shot examples."),
    (0.8, "MODERATE: Room for improvement. Analyze error patterns for specific issues."),
    (None, "GOOD: Solid performance. Focus on edge cases for further improvement."),
]
#: Advice for an error that occurs, with its count.
ERROR_ADVICE = {
    "syntax_error": ("SYNTAX ERRORS: ", " samples had syntax errors. Consider improving code parser or adding syntax validation."),
    "timeout": ("TIMEOUTS: ", " samples timed out. Consider increasing timeout or optimizing generated code."),
    "refusal": ("REFUSALS: ", " samples were refused. Review safety settings or use a different model."),
    "parsing_error": ("PARSING ERRORS: ", " samples failed to parse. Consider using a more robust parser or adjusting extraction mode."),
}


def failed(df: DataFrame) -> DataFrame:
    return df.where(~F.col("passed"))


def with_errors(df: DataFrame) -> DataFrame:
    """Rows with an error of their own or of the parser; an empty one is none."""
    return df.where((F.coalesce("error", F.lit("")) != "") | (F.coalesce("parse_error", F.lit("")) != ""))


def haystack() -> Column:
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("error", "parse_error", "raw_output")]
    return F.lower(F.concat_ws(" ", *parts))


def hits(text: Column) -> dict[str, Column]:
    return {k: any_of(text, ps) for k, ps in FAMILIES.items()}


def patterns(df: DataFrame) -> DataFrame:
    """Failed rows by family: a row counts once in each family that it has."""
    marked = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in hits(F.col("x_text")).items()]))
    return failed(df).withColumn("x_text", haystack()).select(F.explode(marked).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def category() -> Column:
    """The one kind of a failed row: its error, a refusal, the parser, or a wrong answer."""
    return F.when(F.coalesce("error", F.lit("")) != "", "execution_error").when(F.col("refusal_detected"), "refusal").when(F.coalesce("parse_error", F.lit("")) != "", "parsing_error").otherwise("incorrect_output")


def categories(df: DataFrame) -> DataFrame:
    return failed(df).groupBy(category().alias("category")).agg(F.count(F.lit(1)).alias("n"))


def top_categories(df: DataFrame, n: int = 3) -> DataFrame:
    """The most frequent kinds of failure, by count and then by name."""
    return categories(df).orderBy(F.desc("n"), "category").limit(n)


def summary(df: DataFrame) -> DataFrame:
    """Totals and the counts of each kind of failure, in one pass; the kind is a column of its own, computed once for a row."""
    kinds = ("execution_error", "refusal", "parsing_error", "incorrect_output")
    told = df.withColumn("x_kind", F.when(~F.col("passed"), category()))
    return told.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("passed")).alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.coalesce(F.avg(F.col("passed").cast("int")), F.lit(0.0)).alias("pass_rate"),
        *[F.count_if(F.col("x_kind") == k).alias(k) for k in kinds],
    )


def category_performance(df: DataFrame, members: DataFrame, key: str = "sample_id", order: str = "idx") -> DataFrame:
    """Results by category; categories overlap, and the last row of a sample counts."""
    last = df.groupBy(key).agg(F.max_by("passed", order).alias("passed"))
    return members.join(last, key).groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.avg(F.col("passed").cast("int")).alias("accuracy"))


def recommendations(df: DataFrame) -> DataFrame:
    """(position, recommendation): one line for the pass rate and one for each kind of error that occurs."""
    bad = ~F.col("passed")
    marked = hits(haystack())
    counts = df.agg(
        F.coalesce(F.avg(F.col("passed").cast("int")), F.lit(0.0)).alias("rate"),
        *[F.count_if(bad & marked[k]).alias(k) for k in ("syntax_error", "timeout", "refusal")],
        F.count_if(bad & (category() == "parsing_error")).alias("parsing_error"),
    )
    first = reduce(lambda w, a: w.when(F.col("rate") < a[0], F.lit(a[1])), ADVICE[1:-1], F.when(F.col("rate") < ADVICE[0][0], F.lit(ADVICE[0][1]))).otherwise(ADVICE[-1][1])
    lines = [first, *[F.when(F.col(k) > 0, F.concat(F.lit(a), F.col(k).cast("string"), F.lit(b))) for k, (a, b) in ERROR_ADVICE.items()]]
    return counts.select(F.posexplode(F.array_compact(F.array(*lines))).alias("position", "recommendation"))
