"""Line dedup: levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SPACE = " \t\n\x0b\x0c\r"
KEY = ("x_h", "x_g")


def _bare(line: Column) -> Column:
    """A line without white space at both ends; the few lines that have some are looked at by character."""
    loose = reduce(lambda acc, c: acc | line.startswith(c) | line.endswith(c), SPACE, F.lit(False))
    return F.when(loose, F.btrim(line, F.lit(SPACE))).otherwise(line)


def _folded(bare: Column) -> Column:
    """A-Z lower-cased. A string with other letters is read as Latin-1 first: lower-casing then changes lead bytes
    of UTF-8 too, but how many bytes follow one still tells which it was, so different strings stay different."""
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.lower(F.decode(bare.cast("binary"), "ISO-8859-1")))


def _keyed(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row per line of at least min_chars code points: x_id, x_text_hash, place x_at and 96 bits of hash."""
    lines = docs.select("x_id", "x_text_hash", F.posexplode(F.split("x_text", "\n")).alias("x_at", "x_line"))
    # short lines go by bytes before anything is computed; each column below is used twice, so it is computed once
    lines = lines.where(F.octet_length("x_line") >= min_chars).withColumn("x_bare", _bare(F.col("x_line")))
    lines = lines.withColumn("x_chars", F.char_length("x_bare")).withColumn("x_key", _folded(F.col("x_bare")))
    keyed = lines.select("x_id", "x_text_hash", "x_at", F.xxhash64("x_key").alias("x_h"), F.hash("x_key").alias("x_g"), "x_chars")
    return keyed.where(F.col("x_chars") >= min_chars).drop("x_chars")


class LineRuns:
    """Hashes of all lines seen so far, each with the document that owns it, in sorted runs.

    A run is a table in buckets of the hash, sorted in each, so batches are merged with it where its buckets lie
    and only the batch is shuffled. Runs of one level are disjoint; as soon as a level has fanout runs and another
    batch comes, they become one run of the next level, so n batches are rewritten log(n) times.
    """

    def __init__(self, scratch: Scratch, fanout: int = 3) -> None:
        self.scratch, self.fanout = scratch, fanout
        self.spark = scratch.spark
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name = f"gaugewell_run_{uuid.uuid4().hex}"
        path = f"{self.scratch.root}/{name}"
        self.scratch.made.append(path)
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).option("compression", "zstd").saveAsTable(name)
        return name, path

    def _forget(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"drop table if exists {name}")
            self.scratch.drop(path)

    def _compact(self) -> None:
        for level, runs in enumerate(self.levels):
            if len(runs) >= self.fanout:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                merged = reduce(DataFrame.unionByName, [self.spark.table(n) for n, _ in runs])
                self.levels[level + 1].append(self._write(merged.repartition(self.buckets, *KEY)))
                self.levels[level] = []
                self._forget(runs)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def add(self, lines: DataFrame) -> None:
        """A new batch: its keys that no run has become a run, owned by the smallest x_id that holds them; a null id is larger than any other."""
        self._compact()
        fresh = lines.groupBy(*KEY).agg(F.min("x_id").alias("x_owner"))
        for run in self.runs():
            fresh = fresh.join(run.hint("merge"), list(KEY), "left_anti")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(fresh))

    def repeated(self, lines: DataFrame) -> DataFrame:
        """The lines, of batches that were added, that another document owns. A key that very many documents hold is met by key and id, so nowhere in one place."""
        if not self.runs():
            return lines.limit(0)
        owned = reduce(DataFrame.unionByName, self.runs()).select(*[F.col(k).alias(f"{k}_own") for k in KEY], "x_owner")
        same = (F.col("x_h") == F.col("x_h_own")) & (F.col("x_g") == F.col("x_g_own")) & F.col("x_id").eqNullSafe(F.col("x_owner"))
        return lines.join(owned.hint("merge"), same, "left_anti")

    def drop(self) -> None:
        self._forget([run for level in self.levels for run in level])
        self.levels = []


def drop_repeated_lines(df: DataFrame, text: str = "text", id: str = "doc_id", min_chars: int = 10, batches: int = 6, fanout: int = 3) -> DataFrame:
    """df's columns with repeated lines cut out of text, and x_n_lines and x_n_dropped.

    Lines lie between line feeds. A line of at least min_chars code points without the white space at its ends stays only
    in the document of the smallest id that holds it (all its occurrences there), compared with A-Z lower-cased.
    Ids must be numbers. They are cut into batches of about equal rows, which go through the runs (see LineRuns) in
    ascending order; the result doesn't depend on how many there are.

    Null and empty texts are one empty line and give an empty text. Rows that repeat an id are parts of one document. Null ids are one document, after
    all others. Very long texts and lines are taken whole. Extra columns stay, whatever their names. Empty input gives an
    empty result. Lines are told apart by 96-bit hashes.
    """
    scratch = Scratch(df.sparkSession, "lines")
    names = [f"x_c{i}" for i in range(len(df.columns))]
    at = {c: names[i] for i, c in enumerate(df.columns)}
    docs = df.toDF(*names).withColumn("x_id", F.col(at[id])).withColumn("x_text", F.coalesce(F.col(at[text]).cast("string"), F.lit(""))).withColumn("x_text_hash", F.xxhash64("x_text"))
    cuts = df.select(F.percentile_approx(F.col(id), [i / batches for i in range(1, batches)], F.lit(1000)).alias("c")).first()["c"] if batches > 1 else []
    batch = reduce(lambda acc, c: acc + F.coalesce(F.col("x_id") >= F.lit(c), F.lit(True)).cast("int"), cuts or [], F.lit(0))
    path = scratch.path("keyed")
    scratch.made.append(path)
    keyed = _keyed(docs, min_chars).withColumn("x_batch", batch)
    keyed.write.partitionBy("x_batch").option("compression", "zstd").parquet(path)
    keyed = df.sparkSession.read.schema(keyed.schema).parquet(path)
    seen = LineRuns(scratch, fanout)
    for i in range(len(cuts or []) + 1):
        seen.add(keyed.where(F.col("x_batch") == i))
    gone = seen.repeated(keyed).groupBy(F.col("x_id").alias("x_id_gone"), F.col("x_text_hash").alias("x_hash_gone")).agg(F.collect_set("x_at").alias("x_gone"))
    gone = scratch.table(gone, "gone")
    seen.drop()
    scratch.drop(path)
    out = docs.join(gone, F.col("x_id").eqNullSafe(F.col("x_id_gone")) & (F.col("x_text_hash") == F.col("x_hash_gone")), "left")
    out = out.withColumn("x_lines", F.split("x_text", "\n"))
    out = out.withColumn("x_left", F.when(F.col("x_gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("x_lines") - 1), F.col("x_gone"))))
    kept = F.when(F.col("x_left").isNull(), F.col("x_text")).otherwise(F.array_join(F.transform("x_left", lambda i: F.get("x_lines", i)), "\n"))
    n = F.size("x_lines").cast("bigint")
    columns = [(kept if c == at[text] else F.col(c)).alias(c) for c in names]
    out = out.select(*columns, n.alias("x_n_lines"), (n - F.coalesce(F.size("x_left"), F.size("x_lines"))).cast("bigint").alias("x_n_dropped"))
    return out.toDF(*df.columns, "x_n_lines", "x_n_dropped")
