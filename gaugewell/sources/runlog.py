"""A run's results as an append-only log: a folder of rows for each step, and a numbered commit that makes it count.

    {root}/{task}_{model}/steps/{step}/*.parquet     rows; they count once a commit names them
    {root}/{task}_{model}/log/00000000000000000007.json   commit 7

A commit is created under its number or not at all, and ends a step: whatever stops a writer between two operations
leaves the log as it was, with at most a folder that nothing names. Readers take commits in order and pass over one that
was torn. Nothing that a commit names is rewritten; compaction writes all rows once more and commits that they replace those before.
"""

from __future__ import annotations

import json
import tempfile
import uuid
import warnings
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_name

APPEND, REPLACE, FINISH = "append", "replace", "finish"
COMMITS = "commit long, action string, step string, n_rows long, timestamp string, metadata string"


@dataclass(frozen=True)
class Commit:
    """What one commit says. step is null for one that only tells that a run has ended."""

    commit: int
    action: str
    step: str | None
    n_rows: int
    timestamp: str
    metadata: dict = field(default_factory=dict)


class Conflict(Exception):
    """Another writer has this number."""


class Store:
    """The few operations on files that the log needs, each of which may be the last one before a crash."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def write(self, rows: DataFrame, path: str) -> None:
        rows.write.parquet(path)

    def create(self, path: str, text: str) -> None:
        """A file with a text, or Conflict if there is one of this name."""
        fs, where = self._at(path)
        if fs.exists(where):
            raise Conflict(path)
        try:
            out = fs.create(where, False)
        except Exception as e:  # noqa: BLE001  stores differ in what they raise
            if fs.exists(where):
                raise Conflict(path) from e
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, path: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect())

    def names(self, path: str) -> list[str]:
        fs, where = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def delete(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.delete(where, True) if fs.exists(where) else False


def shared_root(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares; of one's own only where none is named and there is one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="gaugewell-runs-")
    return f"{shared.rstrip('/')}/runs-{uuid.uuid4().hex}"


class RunLog:
    """The log of one task and model below a root."""

    def __init__(self, spark: SparkSession, root: str, task: str, model: str, store: Store | None = None) -> None:
        self.spark, self.task, self.model = spark, task, model
        self.store = store or Store(spark)
        names = spark.range(1).select(*[safe_name(F.lit(x)).alias(c) for c, x in (("a", task), ("b", model))]).first()
        self.path = f"{root.rstrip('/')}/{names['a']}_{names['b']}"

    def commits(self) -> list[Commit]:
        """All commits in order, without torn ones. One read for all files; they are as many as steps since the last compaction was tidied up."""
        files = [n for n in self.store.names(f"{self.path}/log") if n.endswith(".json") and not n.startswith((".", "_"))]
        if not files:
            return []
        rows = self.spark.read.text([f"{self.path}/log/{n}" for n in files], wholetext=True).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).collect()
        found = []
        for r in sorted(rows, key=lambda r: r["file"]):
            try:
                said = json.loads(r["value"])
                found.append(Commit(**{k: said.get(k) for k in Commit.__dataclass_fields__} | {"metadata": said.get("metadata") or {}}))
            except (ValueError, AttributeError, TypeError):
                warnings.warn(f"commit {r['file']} of {self.path} is torn and doesn't count", stacklevel=2)
        return [c for c in found if c.commit is not None]

    def _last(self) -> int:
        """The largest number that a file has, torn or not."""
        return max((int(n.removesuffix(".json")) for n in self.store.names(f"{self.path}/log") if n.removesuffix(".json").isdigit()), default=-1)

    def _commit(self, action: str, step: str | None, n_rows: int, metadata: dict | None) -> Commit:
        while True:
            c = Commit(self._last() + 1, action, step, n_rows, datetime.now(timezone.utc).isoformat(), metadata or {})
            try:
                self.store.create(f"{self.path}/log/{c.commit:020d}.json", json.dumps(asdict(c), sort_keys=True))
                return c
            except Conflict:  # a writer beside this one came first; appends don't depend on their order
                continue

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        step = uuid.uuid4().hex
        self.store.write(rows, f"{self.path}/steps/{step}")
        return step, self.spark.read.parquet(f"{self.path}/steps/{step}").count()

    def append(self, rows: DataFrame, metadata: dict | None = None) -> Commit:
        """Write a step's rows, then commit them."""
        return self._commit(APPEND, *self._write(rows), metadata)

    def finish(self, metadata: dict | None = None) -> Commit:
        """Note that the run has all its results."""
        return self._commit(FINISH, None, 0, metadata)

    def finished(self) -> bool:
        """Whether the run has ended and nothing was appended since."""
        at = {c.action: c.commit for c in self.commits()}
        return at.get(FINISH, -1) > at.get(APPEND, -1)

    def live(self, commits: list[Commit] | None = None) -> list[Commit]:
        """The commits whose steps count: those since the last one that replaced all before it."""
        out: list[Commit] = []
        for c in self.commits() if commits is None else commits:
            if c.action == REPLACE:
                out = [c]
            elif c.action == APPEND:
                out.append(c)
        return out

    def rows(self, key: str | None = None) -> DataFrame | None:
        """The rows of all steps that count, of rows with one key the last committed; None where there is none.

        A step whose folder is torn, lost or unreadable is a warning and doesn't count, so its samples are evaluated again. Steps may differ in columns: what one lacks is null.
        """
        parts = []
        for c in self.live():
            path = f"{self.path}/steps/{c.step}"
            try:
                if not self.store.exists(f"{path}/_SUCCESS"):
                    raise FileNotFoundError(path)
                parts.append(self.spark.read.parquet(path).withColumn("x_commit", F.lit(c.commit)))
            except (PySparkException, OSError) as e:
                warnings.warn(f"step {c.step} of {self.path} can't be read and doesn't count: {type(e).__name__}", stacklevel=2)
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        if key is not None:
            rest = [c for c in out.columns if c != key]
            out = out.groupBy(key).agg(F.max_by(F.struct(*rest), "x_commit").alias("x_last")).select(key, "x_last.*")
        return out.drop("x_commit")

    def replace(self, rows: DataFrame, metadata: dict | None = None, after: int | None = None) -> Commit:
        """Rows in place of all before; with after, only if that is still the last commit, else Conflict."""
        step, n = self._write(rows)
        if after is None:
            return self._commit(REPLACE, step, n, metadata)
        c = Commit(after + 1, REPLACE, step, n, datetime.now(timezone.utc).isoformat(), metadata or {})
        self.store.create(f"{self.path}/log/{c.commit:020d}.json", json.dumps(asdict(c), sort_keys=True))
        return c

    def compact(self, key: str | None = None, metadata: dict | None = None) -> Commit | None:
        """All rows as one step in place of those before; Conflict, and nothing is changed, if another writer has committed meanwhile."""
        before, ended, rows = self._last(), self.finished(), self.rows(key)
        if rows is None:
            return None
        done = self.replace(rows, metadata, before)
        if ended:
            self.finish(metadata)
        return done

    def tidy(self) -> int:
        """Remove folders that no commit which counts names, and commits that a later one replaced; how many went. Not while someone writes."""
        commits = self.commits()
        live = {c.step for c in self.live(commits)}
        gone = [f"{self.path}/steps/{n}" for n in self.store.names(f"{self.path}/steps") if n not in live]
        last = max((c.commit for c in commits if c.action == REPLACE), default=-1)
        gone += [f"{self.path}/log/{n}" for n in self.store.names(f"{self.path}/log") if n.removesuffix(".json").isdigit() and int(n.removesuffix(".json")) < last]
        return sum(self.store.delete(path) for path in gone)

    def history(self) -> DataFrame:
        """A row per commit."""
        said = [(c.commit, c.action, c.step, c.n_rows, c.timestamp, json.dumps(c.metadata, sort_keys=True)) for c in self.commits()]
        return self.spark.createDataFrame(said, COMMITS)

    def delete(self) -> bool:
        return self.store.delete(self.path)


def runs(spark: SparkSession, root: str) -> DataFrame:
    """A row per run below a root: its folder, commits, rows that were appended since the last compaction, last commit and whether it has ended. One scan of all logs; torn commits don't count."""
    store = Store(spark)
    folders = [n for n in store.names(root) if store.exists(f"{root.rstrip('/')}/{n}/log")]
    schema = "run string, commit long, action string, n_rows long, timestamp string"
    if not folders:
        said = spark.createDataFrame([], schema)
    else:
        text = spark.read.text([f"{root.rstrip('/')}/{n}/log" for n in folders], wholetext=True)
        said = text.select(F.element_at(F.split(F.input_file_name(), "/"), -3).alias("run"), F.from_json("value", COMMITS).alias("c")).select("run", "c.*").where("commit is not null and action is not null")
    latest = said.groupBy("run").agg(F.max(F.when(F.col("action") == REPLACE, F.col("commit"))).alias("replaced"))
    live = F.col("commit") >= F.coalesce("replaced", F.lit(-1))
    return said.join(latest, "run").groupBy("run").agg(F.count("*").alias("commits"), F.sum(F.when(live, F.col("n_rows")).otherwise(0)).alias("n_rows"), F.max("timestamp").alias("timestamp"), F.max_by(F.col("action") == FINISH, "commit").alias("finished"))


def prune(spark: SparkSession, root: str, keep: int = 5) -> int:
    """Delete the oldest runs that have ended, but for the newest keep of them; runs in progress stay. How many went."""
    ended = [r["run"] for r in runs(spark, root).where("finished").orderBy(F.desc("timestamp"), "run").select("run").collect()]
    return sum(Store(spark).delete(f"{root.rstrip('/')}/{name}") for name in ended[keep:])
