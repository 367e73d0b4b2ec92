"""Task configurations and their validation as a query over configuration rows or documents."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schemas
from ..sources.reports import exists

#: Required fields of a configuration.
REQUIRED = ["name", "task_type", "dataset_path", "metric", "parser"]
#: Parsers and metrics that each task type allows; an empty list allows any.
RULES = {
    "coding": (["code", "robust"], ["pass_at_k", "exact_match"]),
    "multiple_choice": (["mc", "robust"], ["multiple_choice"]),
    "function_call": (["json", "robust"], []),
    "reasoning": ([], []),
}

_TEXTS = {"type": "array", "items": {"type": "string"}}
_TEXT_OR_NULL = {"type": ["string", "null"]}
#: What a configuration document must be.
TASK_SCHEMA = {
    "type": "object",
    "required": ["name", "task_type", "dataset", "evaluation"],
    "properties": {
        "name": {"type": "string"},
        "task_type": {"type": "string", "enum": ["coding", "reasoning", "function_call", "multiple_choice"]},
        "description": {"type": "string"},
        "dataset": {
            "type": "object",
            "required": ["path", "loader"],
            "properties": {
                "path": {"type": "string"},
                "loader": {"type": "string", "enum": ["humaneval", "hellaswag", "bfcl", "gsm8k", "generic"]},
                "split": {"type": "string"},
                "subset": _TEXT_OR_NULL,
                "num_samples": {"type": ["integer", "null"], "minimum": 1},
            },
        },
        "prompt": {
            "type": "object",
            "properties": {
                "template": {"type": "string"},
                "system_message": _TEXT_OR_NULL,
                "few_shot": {"type": "array", "items": {"type": "object", "properties": {"input": {"type": "string"}, "output": {"type": "string"}}}},
            },
        },
        "generation": {
            "type": "object",
            "properties": {
                "max_tokens": {"type": "integer", "minimum": 1},
                "temperature": {"type": "number", "minimum": 0, "maximum": 2},
                "top_p": {"type": "number", "minimum": 0, "maximum": 1},
                "stop_sequences": _TEXTS,
                "num_return_sequences": {"type": "integer", "minimum": 1},
            },
        },
        "parsing": {
            "type": "object",
            "required": ["parser"],
            "properties": {
                "parser": {"type": "string", "enum": ["code", "mc", "json", "robust"]},
                "extraction_mode": {"type": "string", "enum": ["last_block", "first_block", "all"]},
                "language": _TEXT_OR_NULL,
            },
        },
        "evaluation": {
            "type": "object",
            "required": ["metric"],
            "properties": {
                "metric": {"type": "string", "enum": ["pass_at_k", "exact_match", "multiple_choice", "json_validity", "function_call_match", "composite"]},
                "k": {"type": "integer", "minimum": 1},
                "timeout": {"type": "number", "minimum": 1},
                "sandbox": {"type": "boolean"},
            },
        },
        "metadata": {"type": "object", "properties": {"version": {"type": "string"}, "author": {"type": "string"}, "tags": _TEXTS}},
    },
}


def task_schema() -> dict:
    """A copy of the schema that documents are checked against."""
    return json.loads(json.dumps(TASK_SCHEMA))


@dataclass(frozen=True)
class Task:
    """What the evaluator needs of a configuration, with the defaults of what it leaves out."""

    name: str
    task_type: str = "coding"
    dataset_path: str = ""
    parser: str = "robust"
    metric: str = "exact_match"
    split: str = "test"
    subset: str | None = None
    num_samples: int | None = None
    template: str = "{prompt}"
    system_message: str | None = None
    max_tokens: int = 512
    temperature: float = 0.0
    top_p: float = 1.0
    timeout: float = 5.0

    @classmethod
    def of(cls, doc: dict) -> Task:
        """From a document; sections that are missing or null leave the defaults."""
        part = lambda k: doc.get(k) or {}
        given = {"name": doc.get("name"), "task_type": doc.get("task_type"), "dataset_path": part("dataset").get("path"), "parser": part("parsing").get("parser"), "metric": part("evaluation").get("metric"), "timeout": part("evaluation").get("timeout")}
        given |= {k: part("dataset").get(k) for k in ("split", "subset", "num_samples")} | {k: part("prompt").get(k) for k in ("template", "system_message")} | {k: part("generation").get(k) for k in ("max_tokens", "temperature", "top_p")}
        return cls(**{k: v for k, v in given.items() if v is not None})


def document_errors(c: Column, schema: dict | None = None) -> Column:
    """What is wrong with configuration documents as JSON texts: missing fields of the top level, then the one schema error
    that says most, then parsers and metrics that the task type doesn't allow. Empty for a valid one."""
    schema = schema or TASK_SCHEMA
    q = schemas.quoted
    compiled = schemas.Compiler(schema)
    at = lambda path: f"try_variant_get(doc, '{path}', 'string')"
    missing = [f"case when try_variant_get(doc, {q(f'$.{k}')}, 'variant') is null and startswith(schema_of_variant(doc), 'OBJECT') then {q(f'missing {k}')} end" for k in schema.get("required", [])]
    unfit = []
    for kind, allowed in RULES.items():
        for column, names, path in zip(("parser", "metric"), allowed, ("$.parsing.parser", "$.evaluation.metric"), strict=True):
            if names:
                own = f"coalesce({at(path)}, 'none')"
                unfit.append(f"case when {at('$.task_type')} = '{kind}' and {own} not in ({', '.join(map(q, names))}) then concat({q(f'{kind} cannot use {column} ')}, {own}) end")
    parts = f"struct(array({', '.join(missing)}) as missing, {compiled.errors('doc', schema)} as broken, array({', '.join(unfit)}) as unfit)"
    held = F.filter(F.array(F.try_parse_json(F.coalesce(c, F.lit("")))), lambda x: x.isNotNull())
    found = F.call_function("transform", held, F.expr(f"doc -> {parts}"))
    listed = F.transform(found, lambda s: F.array_compact(F.concat(s["missing"], F.array(schemas.told(s["broken"])), s["unfit"])))
    return F.coalesce(F.try_element_at(listed, F.lit(1)), F.array(F.lit("not JSON")))


def validate_documents(df: DataFrame, column: str) -> DataFrame:
    """df with errors of its JSON documents."""
    return df.withColumn("errors", document_errors(F.col(column)))


def validate(df: DataFrame) -> DataFrame:
    """df with errors, an array of messages; empty for a valid configuration."""
    checks = [F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(f"missing {c}")) for c in REQUIRED if c in df.columns]
    checks += [F.lit(f"missing {c}") for c in REQUIRED if c not in df.columns]
    checks.append(F.when(~F.col("task_type").isin(*RULES), F.concat(F.lit("unknown task_type "), F.col("task_type"))))
    for kind, (parsers, metrics) in RULES.items():
        for column, allowed in (("parser", parsers), ("metric", metrics)):
            if allowed:
                checks.append(F.when((F.col("task_type") == kind) & ~F.col(column).isin(*allowed), F.concat(F.lit(f"{kind} cannot use {column} "), F.col(column))))
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def read_yaml(text: str) -> dict:
    """A configuration file as one flat row; nested sections give the fields of the same name."""
    import yaml

    doc = yaml.safe_load(text)
    if not isinstance(doc, dict):
        raise ValueError("empty configuration")
    part = lambda k: doc.get(k) or {}
    row = {"name": doc.get("name"), "task_type": doc.get("task_type"), "dataset_path": part("dataset").get("path"), "num_samples": part("dataset").get("num_samples"), "subset": part("dataset").get("subset"), "split": part("dataset").get("split"), "metric": part("evaluation").get("metric"), "parser": part("parsing").get("parser")}
    return row | {k: part("generation").get(k) for k in ("max_tokens", "temperature", "top_p")}


def _as_json(content: bytes | None) -> tuple[str | None, str | None]:
    """(a YAML file's document as JSON, None), or (None, why there is none)."""
    import yaml

    try:
        doc = yaml.safe_load(bytes(content or b"").decode())
        return (json.dumps(doc, default=str), None) if doc else (None, "empty configuration")
    except yaml.YAMLError as e:
        return None, f"no YAML: {str(e).splitlines()[0]}"
    except Exception as e:  # noqa: BLE001  any fault of a file is its own
        return None, f"{type(e).__name__}: {e}".splitlines()[0]


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc, error): every YAML file below a folder, or one file, as JSON; read where the files' parts are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{yaml,yml}").load(path)
    root = path.split("://")[-1].rstrip("/")

    def rows(frames):
        for f in frames:
            found = [_as_json(c) for c in f["content"]]
            names = [p.split(root, 1)[-1].lstrip("/") or p.rsplit("/", 1)[-1] for p in f["path"]]
            yield pd.DataFrame({"file": names, "doc": [d for d, _ in found], "error": [e for _, e in found]}).astype(object)

    schema = "file string, doc string, error string"
    read = files.select("path", "content").mapInPandas(rows, schema)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    empty = []  # the reader passes over files without a byte
    while listed.hasNext():
        f = listed.next()
        name = f.getPath().toString()
        if f.getLen() == 0 and name.endswith((".yaml", ".yml")):
            empty.append((name.split(root, 1)[-1].lstrip("/") or name.rsplit("/", 1)[-1], None, "empty configuration"))
    return read.unionByName(spark.createDataFrame(empty, schema)) if empty else read


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(file, is_valid, errors) of every YAML file below a folder; a file that can't be read as a configuration has that as its error."""
    if not exists(spark, folder):
        return spark.createDataFrame([("", False, [f"no such folder: {folder}"])], "file string, is_valid boolean, errors array<string>")
    errors = F.when(F.col("error").isNotNull(), F.array("error")).otherwise(document_errors(F.col("doc")))
    return documents(spark, folder).select("file", errors.alias("errors")).select("file", (F.size("errors") == 0).alias("is_valid"), "errors")


def check_file(spark: SparkSession, path: str) -> tuple[bool, list[str]]:
    """(whether a configuration file is valid, what is wrong with it)."""
    if not exists(spark, path):
        return False, [f"no such file: {path}"]
    row = scan(spark, path).first()
    return (row["is_valid"], list(row["errors"])) if row else (False, [f"no YAML file: {path}"])


def tasks(spark: SparkSession, folder: str) -> dict[str, Task]:
    """The valid configurations below a folder by name; an invalid one is an error that names its file. A few files at most."""
    found = documents(spark, folder).withColumn("errors", document_errors(F.col("doc"))).orderBy("file").collect()
    wrong = [f"{r['file']}: {r['error'] or '; '.join(r['errors'])}" for r in found if r["error"] or r["errors"]]
    if wrong:
        raise ValueError("; ".join(wrong))
    return {t.name: t for t in (Task.of(json.loads(r["doc"])) for r in found)}
