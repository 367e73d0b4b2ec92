"""Datasets by configuration: which files a subset has, their schema, their rows and those that can't be read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import benchmarks

#: The file of each subset; any other name, and none, is the simple one.
SUBSETS = {
    "simple": "BFCL_v3_simple.json",
    "multiple": "BFCL_v3_multiple.json",
    "parallel": "BFCL_v3_parallel.json",
    "parallel_multiple": "BFCL_v3_parallel_multiple.json",
    "exec_simple": "BFCL_v3_exec_simple.json",
    "exec_multiple": "BFCL_v3_exec_multiple.json",
    "exec_parallel": "BFCL_v3_exec_parallel.json",
    "exec_parallel_multiple": "BFCL_v3_exec_parallel_multiple.json",
    "irrelevance": "BFCL_v3_irrelevance.json",
    "live_simple": "BFCL_v3_live_simple.json",
    "live_multiple": "BFCL_v3_live_multiple.json",
    "live_parallel": "BFCL_v3_live_parallel.json",
    "live_parallel_multiple": "BFCL_v3_live_parallel_multiple.json",
    "live_relevance": "BFCL_v3_live_relevance.json",
    "live_irrelevance": "BFCL_v3_live_irrelevance.json",
    "java": "BFCL_v3_java.json",
    "javascript": "BFCL_v3_javascript.json",
    "rest": "BFCL_v3_rest.json",
    "sql": "BFCL_v3_sql.json",
    "chatable": "BFCL_v3_chatable.json",
}
#: Folder of the answers, beside the questions.
ANSWERS = "possible_answer"
DECLARED = {"humaneval": benchmarks.HUMANEVAL, "hellaswag": benchmarks.HELLASWAG, "bfcl": benchmarks.BFCL}
BAD = "_bad_row"
_schemas: dict[tuple[str, int, int], T.StructType] = {}


def subset_file(subset: str | None) -> str:
    return SUBSETS.get(subset or "simple", SUBSETS["simple"])


@dataclass(frozen=True)
class Dataset:
    """JSON lines below a path, as a loader has them: a file per subset (bfcl), or a folder or file per split or subset, or the path itself."""

    spark: SparkSession
    path: str
    loader: str = "generic"
    split: str | None = None
    subset: str | None = None

    def _status(self, path: str) -> list[tuple[str, int, int]]:
        """(path, time of change, bytes) of a file, or of a folder's files in the order of their names."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        found = [(s.getPath().toString(), s.getModificationTime(), s.getLen()) for s in fs.listStatus(where) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
        return sorted(found)

    def location(self) -> str:
        """Where the rows are; an error where nothing is."""
        root = self.path.rstrip("/")
        if self.loader == "bfcl":
            candidates = [f"{root}/{subset_file(self.subset)}"]
        else:
            parts = [x for x in (self.subset, self.split) if x]
            names = ["/".join(parts), *([self.split] if self.split else [])]
            candidates = [f"{root}/{n}{end}" for n in names if n for end in ("", ".json", ".jsonl")] + ([] if self.subset else [root])
        for c in candidates:
            if self._status(c):
                return c
        raise FileNotFoundError(f"no rows of {self.loader} dataset at any of {', '.join(candidates)}")

    def schema(self) -> T.StructType:
        """The loader's own schema, or that of the first row; kept for a file until it changes."""
        if self.loader in DECLARED:
            return T.StructType.fromDDL(DECLARED[self.loader])
        at = self._status(self.location())
        key = next((s for s in at if s[2]), None)
        if key is None:
            return T.StructType()
        if key not in _schemas:
            first = self.spark.read.text(key[0]).where(F.length(F.trim("value")) > 0).first()
            told = self.spark.range(1).select(F.schema_of_json(F.lit(first[0]))).first()[0] if first else ""
            _schemas[key] = T.DataType.fromDDL(told) if told.startswith("STRUCT<") else T.StructType()
        return _schemas[key]

    def _read(self) -> DataFrame:
        # text first: a row that is no JSON stays as it is beside the others, wherever files are split
        lines = self.spark.read.text(self.location()).where(F.length(F.trim("value")) > 0)
        whole = T.StructType([*self.schema().fields, T.StructField(BAD, T.StringType())])
        row = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
        return lines.select(row.alias("r"), "value", F.col("_metadata.file_path").alias("x_file"))

    def rows(self) -> DataFrame:
        """The rows that can be read."""
        return self._read().where(f"r is not null and r.{BAD} is null").select("r.*").drop(BAD)

    def bad_rows(self) -> DataFrame:
        """(file, text) of rows that are no JSON objects of this schema."""
        return self._read().where(f"r is null or r.{BAD} is not null").select(F.element_at(F.split("x_file", "/"), -1).alias("file"), F.col("value").alias("text"))

    def info(self) -> dict:
        """The dataset's path, loader, split, number of rows that can be read, and schema."""
        return {"path": self.path, "loader": self.loader, "split": self.split, "num_samples": self.rows().count(), "schema": self.schema().simpleString()}

    def answers(self) -> DataFrame:
        """Answers to a subset's questions; none where their file isn't there."""
        at = f"{self.path.rstrip('/')}/{ANSWERS}/{subset_file(self.subset)}"
        return self.spark.read.schema(benchmarks.ANSWERS).json(at) if self._status(at) else self.spark.createDataFrame([], benchmarks.ANSWERS)

    def samples(self, n: int | None = None, extract=None) -> DataFrame:
        """The dataset's samples in its order, at most n; extract serves a generic dataset."""
        own = {"humaneval": benchmarks.humaneval, "hellaswag": benchmarks.hellaswag, "bfcl": lambda rows: benchmarks.bfcl(rows, self.answers())}
        extract = extract or own.get(self.loader)
        if extract is None:
            raise ValueError(f"a {self.loader} dataset needs an extract function")
        return benchmarks.samples(self.rows(), extract, n)
