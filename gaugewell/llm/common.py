"""What the training-data operators share: scratch tables, words, hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows, and about so many bytes, that Python gets at once.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Entries that a worker's word cache holds before it starts anew.
CACHE_WORDS = 400_000


def prepare(spark: SparkSession) -> None:
    """Bound what one Arrow batch of long texts can take in a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only a session of one process makes its own where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="gaugewell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


#: A row's place in a written table: a hash of its file's name, and its number in the file.
FILE, ROW = "__x_file", "__x_row"
#: Of a folder of notes, the file that says which files there are.
INDEX = "files"
_roots: list[str] = []


class Scratch:
    """Tables of one run in the shared folder, so that a lost executor costs a read and not a recomputation.

    An operator's result may read its tables later; drop_scratch removes those of all runs of
    this session.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        prepare(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made: list[str] = []
        _roots.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{len(self.made)}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read again."""
        path = self.path(name)
        self.made.append(path)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *paths: str) -> None:
        for path in paths:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
            if path in self.made:
                self.made.remove(path)

    def finish(self, df: DataFrame) -> DataFrame:
        """The result, written and read again; every other table of this run goes."""
        before = list(self.made)
        path = f"{self.root}/result"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.drop(*before)
        return self.spark.read.schema(df.schema).parquet(path)

    def notes(self, notes: DataFrame, name: str) -> str:
        """Notes on rows of a written table, at most one a row, as a file of notes beside each of its files.

        notes has FILE, ROW and what is noted. Only they are shuffled, by file; the table's own rows
        meet them where they are read (see noted), so its texts never move to learn whether they are wanted.
        """
        folder = self.path(name)
        self.made.append(folder)

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            where, base = filesystem(folder)
            where.create_dir(base, recursive=True)
            held: list[pa.RecordBatch] = []
            files: list[int] = []

            def out() -> None:
                file = held[0].column(FILE)[0].as_py()
                files.append(file)
                under = f"{base}/.{file}-{uuid.uuid4().hex}"
                table = pa.Table.from_batches(held).drop_columns([FILE]).combine_chunks()
                with where.open_output_stream(under) as f, pa.ipc.new_file(f, table.schema) as sink:
                    sink.write_table(table)
                where.move(under, f"{base}/{file}")

            for b in batches:
                for part in _by_file(b):
                    if held and held[0].column(FILE)[0] != part.column(FILE)[0]:
                        out()
                        held = []
                    held.append(part)
            if held:
                out()
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64())], ["file"])

        dealt = notes.select(F.col(FILE).alias(FILE), F.col(ROW).alias(ROW), *(c for c in notes.columns if c not in (FILE, ROW)))
        dealt = dealt.repartition(FILE).sortWithinPartitions(FILE, ROW)
        files = sorted({r[0] for r in dealt.mapInArrow(write, "file long").collect()})  # a number per file that has notes
        where, base = filesystem(folder)
        where.create_dir(base, recursive=True)
        index = pa.table({FILE: pa.array(files, pa.int64())})
        with where.open_output_stream(f"{base}/{INDEX}") as f, pa.ipc.new_file(f, index.schema) as sink:
            sink.write_table(index)
        return folder


def located(table: DataFrame) -> DataFrame:
    """A written table with FILE and ROW."""
    return table.select("*", F.xxhash64("_metadata.file_name").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def _by_file(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if b.num_rows:
        file = b.column(FILE).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.concatenate([[True], file[1:] != file[:-1]]))
        for a, z in zip(cut, [*cut[1:], b.num_rows], strict=True):
            yield b.slice(a, z - a)


def noted(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.RecordBatch]]:
    """Batches of a located table with their notes: (rows of one file, which of them are noted, their notes). A file of notes that was written and can't be found is an error."""
    where, base = filesystem(folder)
    held: int | None = None
    known: set[int] | None = None
    for b in batches:
        for part in _by_file(b):
            file = part.column(FILE)[0].as_py()
            if file != held:
                if known is None:
                    known = set(pa.ipc.open_file(where.open_input_file(f"{base}/{INDEX}")).read_all().column(FILE).to_pylist())
                held, there = file, file in known
                notes = pa.ipc.open_file(where.open_input_file(f"{base}/{file}")).read_all().combine_chunks() if there else None
                rows = notes.column(ROW).to_numpy() if there else np.empty(0, np.int64)
            own = part.column(ROW).to_numpy()
            at = np.searchsorted(rows, own)
            on = np.flatnonzero(at < len(rows))
            on = on[rows[at[on]] == own[on]] if len(on) else on
            yield part, on, notes.take(pa.array(at[on])) if len(on) else None


def without_noted(table: DataFrame, folder: str) -> DataFrame:
    """The rows of a written table that have no note."""
    names = table.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, on, _ in noted(batches, folder):
            keep = np.ones(part.num_rows, bool)
            keep[on] = False
            yield part.select(names).filter(pa.array(keep))

    return located(table).mapInArrow(run, table.schema)


def written_order(df: DataFrame, major: str, minor: str) -> DataFrame:
    """df with the order of its rows as they were written: the files by the numbers that writers give them and then by name, and places in files. Of a frame that reads no files, its partitions and places in them."""
    number = F.lpad(F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1), 12, "0")
    try:
        return df.select("*", F.concat(number, F.lit("/"), F.col("_metadata.file_path")).alias(major), F.col("_metadata.row_index").alias(minor))
    except AnalysisException:
        at = F.monotonically_increasing_id()
        return df.select("*", F.lpad(F.shiftright(at, 33).cast("string"), 10, "0").alias(major), at.bitwiseAND(F.lit((1 << 33) - 1)).alias(minor))


def scratch_roots() -> list[str]:
    """The folders of all runs of this session that are still there."""
    return list(_roots)


def drop_scratch(spark: SparkSession, roots: list[str] | None = None) -> None:
    """Remove the tables of the given runs, or of all runs of this session, also those that results still read."""
    for root in scratch_roots() if roots is None else roots:
        if root in _roots:
            _roots.remove(root)
        where = spark._jvm.org.apache.hadoop.fs.Path(root)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z only; bytes.split and bytes.lower mean just these characters."""
    return text.lower().split() if text else []


class WordHashes(dict):
    """Word to 64-bit hash, filled on demand and bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x + _G
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows; of the whole sequence where it is shorter; of nothing where it is empty."""
    n = len(h)
    if not n:
        return h
    width = min(k, n)
    out = mix(h[: n - width + 1] + np.uint64(width))
    for i in range(1, width):
        out = mix(out ^ (h[i : n - width + 1 + i] + np.uint64(i)))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def fingerprint(values: np.ndarray) -> int:
    """A signed 64-bit hash of an array's bytes."""
    h = xxhash.xxh3_64_intdigest(np.ascontiguousarray(values).view(np.uint8).data) if len(values) else 0
    return h - (1 << 64) if h >= 1 << 63 else h


def hash_bucket(seed: int, buckets_log2: int, *cols: str):
    """(hash, bucket): a place in a fixed pseudo-random order, and its leading bits."""
    h = F.xxhash64(F.lit(seed), *cols)
    return h, F.shiftrightunsigned(h, 64 - buckets_log2).cast("int")


def rank_within(df: DataFrame, key: str, ties: list[str], buckets_log2: int, seed: int, at: tuple[str, int] | None = None, hashed: list[str] | None = None) -> DataFrame:
    """df with __x_rank: 0, 1, ... within each value of key, in the fixed pseudo-random order of hashed (all ties by default), or in that of a column of numbers from 0 to below an end (at).

    A value's rows are numbered in hash buckets, whose counts give each bucket its first
    number; so a value that a third of all rows have is spread over many tasks.
    """
    if at:
        h, bucket = F.col(at[0]), F.floor(F.col(at[0]) / max(1, at[1]) * (1 << buckets_log2)).cast("int")
    else:
        h, bucket = hash_bucket(seed, buckets_log2, *(hashed or ties))
    rows = df.withColumn("__x_hash", h).withColumn("__x_bucket", bucket)
    before = rows.groupBy(F.col(key).alias("__x_key"), F.col("__x_bucket").alias("__x_at")).count()
    by = Window.partitionBy("__x_key").orderBy("__x_at").rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn("__x_base", F.coalesce(F.sum("count").over(by), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy(key, "__x_bucket").orderBy("__x_hash", *ties)) - 1
    joined = rows.withColumn("__x_inside", inside).join(before, F.col(key).eqNullSafe(F.col("__x_key")) & (F.col("__x_bucket") == F.col("__x_at")))
    return joined.select(*df.columns, (F.col("__x_base") + F.col("__x_inside")).alias("__x_rank"))
