"""Reports of runs: a diagnostic report from one scan of the results, and its text for people."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import diagnostics

KINDS = ("execution_error", "refusal", "parsing_error", "incorrect_output")


@dataclass
class Report:
    """Counts of a run. The frames of details stay frames."""

    total: int = 0
    passed: int = 0
    failed: int = 0
    pass_rate: float = 0.0
    patterns: dict[str, int] = field(default_factory=dict)
    kinds: dict[str, int] = field(default_factory=dict)
    categories: dict[str, dict[str, float]] = field(default_factory=dict)
    advice: list[str] = field(default_factory=list)


def marked(df: DataFrame) -> DataFrame:
    """Results with x_kind and a column for each family of errors, each computed once and null for rows that passed."""
    out = df.withColumn("x_text", F.when(~F.col("passed"), diagnostics.haystack())).withColumn("x_kind", F.when(~F.col("passed"), diagnostics.category()))
    return out.withColumns({f"x_{k}": c for k, c in diagnostics.hits(F.col("x_text")).items()})


def report_row(df: DataFrame) -> DataFrame:
    """All counts of a report in one aggregation over one scan: one row."""
    counts = [F.count_if(F.col(f"x_{k}")).alias(k) for k in diagnostics.FAMILIES]
    kinds = [F.count_if(F.col("x_kind") == k).alias(f"kind_{k}") for k in KINDS]
    rate = F.coalesce(F.avg(F.col("passed").cast("int")), F.lit(0.0)).alias("pass_rate")
    return marked(df).agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), rate, *counts, *kinds)


def advice(rate: float, patterns: dict[str, int], kinds: dict[str, int]) -> list[str]:
    """A line for the pass rate, and one for each kind of error that occurs."""
    found = [next(text for least, text in diagnostics.ADVICE if least is None or rate < least)]
    counts = {k: kinds.get(k, 0) if k == "parsing_error" else patterns.get(k, 0) for k in diagnostics.ERROR_ADVICE}
    return found + [f"{a}{counts[k]}{b}" for k, (a, b) in diagnostics.ERROR_ADVICE.items() if counts[k]]


def analyse(df: DataFrame, members: DataFrame | None = None) -> Report:
    """The diagnostic report of a run: one row from its one scan, and a row per category where members (category, sample_id) are given."""
    row = report_row(df).first().asDict()
    if not row["total"]:
        return Report()
    patterns = {k: row[k] for k in diagnostics.FAMILIES if row[k]}
    kinds = {k: row[f"kind_{k}"] for k in KINDS if row[f"kind_{k}"]}
    by = {}
    if members is not None:
        by = {r["category"]: {k: r[k] for k in ("total", "passed", "failed", "accuracy")} for r in diagnostics.category_performance(df, members).collect()}
    return Report(row["total"], row["passed"], row["failed"], row["pass_rate"], patterns, kinds, by, advice(row["pass_rate"], patterns, kinds))


def wrap(text: str, width: int) -> list[str]:
    """Words in lines: of less than width characters in the first line, of at most width after it; a longer word has a line of its own."""

    def add(lines: list[list[str]], word: str) -> list[list[str]]:
        most = width - (len(lines) == 1 and len(lines[0][0]) < width)
        if lines and len(" ".join([*lines[-1], word])) <= most:
            lines[-1].append(word)
        else:
            lines.append([word])
        return lines

    return [" ".join(x) for x in reduce(add, text.split(), [])]


def by_count(counts: dict[str, int]) -> list[tuple[str, int]]:
    """Most frequent first, then by name."""
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))


def ascii_report(report: Report, width: int = 60) -> str:
    """A report in plain characters, as wide as width."""
    bar = lambda share: "#" * round(share * 20) + "." * (20 - round(share * 20))
    lines = ["=" * width, "EVALUATION REPORT".center(width), "=" * width, f"Total: {report.total}", f"Passed: {report.passed}", f"Failed: {report.failed}", f"Pass rate: [{bar(report.pass_rate)}] {report.pass_rate:.1%}"]
    for title, counts in (("Error patterns", report.patterns), ("Error categories", report.kinds)):
        if counts:
            lines += ["-" * width, title, *(f"  {k:<30}{n:>8}" for k, n in by_count(counts))]
    if report.categories:
        lines += ["-" * width, "Categories", *(f"  {k:<30}{v['accuracy']:>8.1%}" for k, v in sorted(report.categories.items()))]
    lines += ["-" * width, "Recommendations"]
    for text in report.advice:
        lines += [f"  {x}" for x in wrap(text, width - 2)]
    return "\n".join([*lines, "=" * width, ""])


def details(df: DataFrame, order: str = "idx") -> DataFrame:
    """A readable row per result: id, mark, score, time and parser, cut to a table's widths."""
    parser = F.left(F.coalesce("parser_used", F.lit("N/A")), F.lit(20))
    return df.select(order, F.left("sample_id", F.lit(30)).alias("sample_id"), F.when(F.col("passed"), "pass").otherwise("fail").alias("status"), F.format_string("%.2f", "score").alias("score"), F.format_string("%.2f", "execution_time").alias("time"), parser.alias("parser"))


def errors(df: DataFrame, order: str = "idx") -> DataFrame:
    """(order, sample_id, message of at most 200 characters) of rows with an error of their own or of the parser."""
    message = F.coalesce(F.nullif("error", F.lit("")), F.nullif("parse_error", F.lit("")))
    return diagnostics.with_errors(df).select(order, "sample_id", F.left(message, F.lit(200)).alias("message"))


def first_with_more(df: DataFrame, n: int, order: str = "idx") -> tuple[list, int]:
    """(the first n rows, how many more there are); a top-n on the executors and a count."""
    return df.orderBy(order).limit(n).collect(), max(0, df.count() - n)


def console(df: DataFrame, shown: int = 10, wrong: int = 5) -> str:
    """The first results and the first errors of a run as text, with how many more there are."""
    lines = []
    for title, rows, n, what in (("Results", details(df), shown, ""), ("Errors", errors(df), wrong, " errors")):
        found, more = first_with_more(rows, n)
        if found:
            lines += [title, *("  " + "  ".join(str(x) for x in tuple(r)[1:]) for r in found)]
            lines += [f"  ... and {more} more{what}"] if more else []
    return "\n".join([*lines, ""])


def default_confidence(c: Column, kind: str = "string") -> Column:
    """Confidence without a parser's own: 0 of null, 0.8 of a text, 0.9 of a list or object that holds something, else 0.5."""
    some = F.length(c) > 0 if kind == "string" else F.size(c) > 0
    return F.when(c.isNull(), 0.0).when(some, 0.8 if kind == "string" else 0.9).otherwise(0.5)


def valid_result(content: Column, error: Column, refused: Column) -> Column:
    """Whether a parsed result holds something, without an error or a refusal."""
    return ~F.coalesce(refused, F.lit(False)) & content.isNotNull() & error.isNull()
