"""Benchmark items from files: explicit schemas, one prompt per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import templates
from ..operators.running import running_sums
from .runlog import shared_root

HUMANEVAL = "task_id string, prompt string, entry_point string, canonical_solution string, test string"
HELLASWAG = "ind long, ctx string, ctx_a string, ctx_b string, endings array<string>, label string, activity_label string, split_type string"
BFCL = "id string, question variant, function variant, chat_history variant, function_call_type string"
ANSWERS = "id string, ground_truth array<map<string,map<string,array<string>>>>"


def read_split(spark: SparkSession, path: str, schema: str, split: str | None = None, fmt: str = "json") -> DataFrame:
    """A dataset's split: a folder or file of that name below path, or path itself."""
    return spark.read.schema(schema).format(fmt).load(f"{path}/{split}" if split else path)


#: File parts whose first numbers are sent to every task, about 200 bytes each; with more, rows are shuffled to them.
MOST_PARTS = 200_000


def numbered(df: DataFrame, name: str = "idx") -> DataFrame:
    """df with idx, the rows' places from 0 in the order of the files' names and of rows in them.

    Counts by file part give each part its first number, so numbers do not depend on how parts are dealt to tasks, and a row costs
    no shuffle unless there are more than MOST_PARTS parts. A frame that reads no files is written once to a folder that the cluster shares, and numbered
    by its partitions as they are written.
    """
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    try:
        rows = df.select("*", file.alias("x_file"), start.alias("x_start"))
    except AnalysisException:
        path = f"{shared_root(df.sparkSession)}/rows"
        df.write.parquet(path)
        df = df.sparkSession.read.schema(df.schema).parquet(path)
        rows = df.select("*", file.alias("x_file"), start.alias("x_start"))
    at_most = len(df.inputFiles()) + 2 * rows.rdd.getNumPartitions()  # a partition ends in one file and begins in one
    rows = rows.withColumn("x_at", F.monotonically_increasing_id())
    sizes = rows.groupBy("x_file", "x_start").agg(F.min("x_at").alias("x_first"), F.count(F.lit(1)).alias("x_n"))
    before = Window.orderBy("x_file", "x_start").rowsBetween(Window.unboundedPreceding, -1)  # a row per file part
    sizes = sizes.withColumn("x_base", F.coalesce(F.sum("x_n").over(before), F.lit(0))).drop("x_n")
    sizes = sizes.hint("broadcast" if at_most <= MOST_PARTS else "merge")
    return rows.join(sizes, ["x_file", "x_start"]).select(*df.columns, (F.col("x_base") + F.col("x_at") - F.col("x_first")).alias(name))


def samples(df: DataFrame, extract: Callable[[DataFrame], DataFrame], n: int | None = None) -> DataFrame:
    """A dataset's samples: rows are numbered as read (for ids), extracted, those that give no prompt go, and the rest are numbered
    anew (idx, which resuming goes by) before the first n are taken. extract keeps a row's idx, and of each row at most one."""
    kept = extract(numbered(df))
    kept = kept.orderBy("idx").limit(n) if n is not None else kept
    out = running_sums(kept.withColumnRenamed("idx", "x_idx"), {"idx": F.lit(1)}, "x_idx").drop("x_idx")
    return out.withColumn("idx", F.col("idx") - 1)


def mapped(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Standard names from a source's own, or from columns that have them already."""
    pick = lambda new, old: F.col(old) if old in df.columns else F.col(new) if new in df.columns else F.lit(None).cast("string")
    return df.select(*[pick(new, old).alias(new) for new, old in fields.items()])


def humaneval(df: DataFrame) -> DataFrame:
    return df.select("idx", F.coalesce("task_id", F.concat(F.lit("humaneval_"), F.col("idx").cast("string"))).alias("id"), "prompt", F.coalesce("canonical_solution", F.lit("")).alias("reference"), F.coalesce("test", F.lit("")).alias("test"), F.coalesce("entry_point", F.lit("")).alias("entry_point")).where("prompt is not null")


def choice_label(label: Column) -> Column:
    """A letter of a number from 0 or of a letter."""
    return F.when(label.rlike(r"^\d+$"), F.char(F.lit(65) + label.try_cast("int"))).otherwise(F.upper(label))


def hellaswag(df: DataFrame) -> DataFrame:
    context = F.coalesce("ctx", F.concat_ws(" ", "ctx_a", "ctx_b"))
    out = df.select("idx", F.concat(F.lit("hellaswag_"), F.col("idx").cast("string")).alias("id"), templates.choice_prompt(context, F.col("endings")).alias("prompt"), choice_label(F.col("label")).alias("reference"), "activity_label")
    return out.where("prompt is not null")


def bfcl_question(question: Column) -> Column:
    """The first turn's text of a question in any of its shapes."""
    got = lambda p: F.try_variant_get(question, p, "string")
    whole = F.when(F.schema_of_variant(question) == "STRING", got("$"))
    return F.coalesce(got("$[0][0].content"), got("$[0].content"), whole, F.when(F.schema_of_variant(question).like("ARRAY<STRING>%"), got("$[0]")), F.lit(""))


def bfcl_functions(function: Column) -> Column:
    """array<struct(name, description, parameters)> of a function's schema, a list of them, or either as JSON text; parameters as JSON."""
    text = F.try_variant_get(function, "$", "string")
    v = F.when(F.schema_of_variant(function) == "STRING", F.try_parse_json(F.nullif(F.trim(text), F.lit("")))).otherwise(function)
    items = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).when(F.schema_of_variant(v).startswith("OBJECT"), F.array(v))
    get = lambda x, k: F.try_variant_get(x, f"$.{k}", "string")
    each = F.transform(F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT")), lambda x: F.struct(F.coalesce(get(x, "name"), F.lit("unknown")).alias("name"), F.coalesce(get(x, "description"), F.lit("")).alias("description"), F.coalesce(F.to_json(F.try_variant_get(x, "$.parameters", "variant")), F.lit("{}")).alias("parameters")))
    return F.coalesce(each, F.array().cast("array<struct<name:string,description:string,parameters:string>>"))


def bfcl(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with their answers; a question without one has none to match, of several the last counts."""
    last = numbered(answers).groupBy("id").agg(F.max_by("ground_truth", "idx").alias("ground_truth"))
    empty = F.array().cast("array<map<string,map<string,array<string>>>>")
    joined = questions.join(last, "id", "left")
    return joined.select("idx", "id", bfcl_question(F.col("question")).alias("prompt"), bfcl_functions(F.col("function")).alias("functions"), F.coalesce("ground_truth", empty).alias("reference"), F.coalesce("function_call_type", F.lit("simple")).alias("call_type"))
