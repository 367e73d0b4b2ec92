"""Results as JSON documents of a version, and back: a reader takes documents of versions before and after its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 2
#: Fields of a row and where they stand in a document; a path of the first version, which was flat, comes after it.
FIELDS: dict[str, tuple[str, tuple[str, ...]]] = {
    "idx": ("long", ("idx", "index")),
    "sample_id": ("string", ("sample_id",)),
    "task": ("string", ("task", "task_name")),
    "model": ("string", ("model", "model_name")),
    "content": ("string", ("parsed.content", "parsed_result.content", "content")),
    "confidence": ("double", ("parsed.confidence", "parsed_result.confidence", "confidence")),
    "parser_used": ("string", ("parsed.parser_used", "parsed_result.parser_used", "parser_used")),
    "refusal_detected": ("boolean", ("parsed.refusal_detected", "parsed_result.refusal_detected", "refusal_detected")),
    "reference": ("string", ("reference",)),
    "score": ("double", ("score",)),
    "passed": ("boolean", ("passed",)),
    "execution_time": ("double", ("execution_time",)),
    "error": ("string", ("error",)),
}
#: Names at the top of a document that belong to fields, whatever its version.
OWN = sorted({p.split(".")[0] for _, (_, paths) in FIELDS.items() for p in paths} | {"version"})
MORE = "more"


def to_json(df: DataFrame) -> Column:
    """A document per row: its version, the fields that df has, nulls included, with what was parsed as an object of its own, and what is in more (map<string,string> of JSON values)."""
    parsed = [c for c in FIELDS if FIELDS[c][1][0].startswith("parsed.") and c in df.columns]
    top = [c for c in FIELDS if c not in parsed and c in df.columns]
    fields = [F.lit(VERSION).alias("version"), *(F.col(c).cast(FIELDS[c][0]).alias(c) for c in top)]
    if parsed:
        fields.append(F.struct(*[F.col(c).cast(FIELDS[c][0]).alias(c) for c in parsed]).alias("parsed"))
    whole = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    if MORE not in df.columns:
        return whole
    kept = F.map_filter(F.coalesce(F.col(MORE), F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(OWN) & v.isNotNull())
    name = lambda k: F.regexp_extract(F.to_json(F.struct(k.alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)
    more = F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(F.lit(","), name(e["key"]), F.lit(":"), e["value"])), "")
    return F.concat(F.substring(whole, 1, 1), F.left(F.substr(whole, F.lit(2)), F.length(whole) - 2), more, F.lit("}"))


def from_json(df: DataFrame, column: str) -> DataFrame:
    """Rows of documents: every field (null where a document lacks it), version (1 where it says none), more (fields it has besides, as JSON), and wrong (the text of one that is no object)."""
    v = F.col("x_doc")
    out = df.withColumn("x_doc", F.try_parse_json(column))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    out = out.withColumn("x_doc", F.when(is_object, v))
    get = lambda path, kind: F.try_variant_get(v, f"$.{path}", kind)
    fields = [F.coalesce(*[get(p, kind) for p in paths]).alias(name) for name, (kind, paths) in FIELDS.items()]
    rest = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, x: ~k.isin(OWN))
    more = F.transform_values(rest, lambda k, x: F.to_json(x))
    kept = [c for c in df.columns if c != column and c not in FIELDS and c not in ("version", MORE, "wrong")]
    return out.select(*kept, F.when(v.isNotNull(), F.coalesce(get("version", "int"), F.lit(1))).alias("version"), *fields, more.alias(MORE), F.when(v.isNull(), F.col(column)).alias("wrong"))


def write(df: DataFrame, path: str) -> None:
    """Documents as JSON lines, by task where there is one."""
    rows = df.select(*(["task"] if "task" in df.columns else []), to_json(df).alias("value"))
    (rows.write.partitionBy("task") if "task" in df.columns else rows.write).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return from_json(spark.read.text(path).select("value"), "value")


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Results that stand in checkpoint documents, one document per file: the fields of each result with the document's task, model, timestamp
    and metadata, and idx as completed_indices has it where a result has none. Documents that are no JSON or name no task are left out."""
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))
    get = lambda p, kind: F.try_variant_get("doc", p, kind)
    docs = text.select(get("$.task_name", "string").alias("said_task"), get("$.model_name", "string").alias("said_model"), get("$.timestamp", "string").alias("timestamp"), F.to_json(get("$.metadata", "variant")).alias("metadata"), get("$.completed_indices", "array<long>").alias("done"), get("$.results", "array<variant>").alias("results"))
    each = docs.where("said_task is not null").select("said_task", "said_model", "timestamp", "metadata", "done", F.posexplode("results").alias("at", "one"))
    rows = from_json(each.select("said_task", "said_model", "timestamp", "metadata", F.get("done", F.col("at")).alias("said_idx"), F.to_json("one").alias("one")), "one").where("wrong is null")
    return rows.withColumns({"idx": F.coalesce("idx", "said_idx"), "task": F.coalesce("task", "said_task"), "model": F.coalesce("model", "said_model")}).drop("said_task", "said_model", "said_idx", "wrong")
