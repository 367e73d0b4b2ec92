"""Checkpoints of runs: a run's results so far, kept in its log (see runlog)."""

from __future__ import annotations

import json
import warnings
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runlog
from .runlog import RunLog

#: Columns that save adds to the results.
ADDED = ("task_name", "model_name", "timestamp", "metadata")


def save(results: DataFrame, root: str, task: str, model: str, metadata: str = "{}", keep: int | None = 5) -> str:
    """A run's results as a whole, in place of what its log had; readers see those before or these. Of the runs below root that were saved whole or have ended the newest keep stay."""
    log = RunLog(results.sparkSession, root, task, model)
    now = datetime.now(timezone.utc).isoformat()
    rows = results.withColumns({"task_name": F.lit(task), "model_name": F.lit(model), "timestamp": F.lit(now), "metadata": F.lit(metadata)})
    log.replace(rows, json.loads(metadata))
    log.finish()
    if keep is not None:
        runlog.prune(results.sparkSession, root, keep)
    return log.path


def listed(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(path, time of the last commit) of the runs below root, newest first; one without a commit that can be read is left out."""
    found = runlog.runs(spark, root).orderBy(F.desc("timestamp"), "run").select("run", "timestamp").collect()
    return [(f"{root.rstrip('/')}/{r['run']}", r["timestamp"]) for r in found]


def has(spark: SparkSession, root: str, task: str, model: str) -> bool:
    return bool(RunLog(spark, root, task, model).live())


def load(spark: SparkSession, root: str, task: str, model: str, key: str | None = None) -> DataFrame | None:
    """A run's results; None, and a warning, without a checkpoint that can be read."""
    log = RunLog(spark, root, task, model)
    rows = log.rows(key)
    if rows is None:
        warnings.warn(f"no checkpoint at {log.path} that can be read", stacklevel=2)
    return rows


def delete(spark: SparkSession, root: str, task: str, model: str) -> bool:
    """Whether there was one to delete."""
    return RunLog(spark, root, task, model).delete()


def clear(spark: SparkSession, root: str) -> int:
    """Delete all runs, also those in progress and those that can't be read; how many there were."""
    store = runlog.Store(spark)
    paths = [f"{root.rstrip('/')}/{name}" for name in store.names(root)]
    return sum(store.delete(path) for path in paths if store.exists(f"{path}/log"))


def prune(spark: SparkSession, root: str, keep: int = 5) -> int:
    """Delete all ended runs but the newest keep; how many went."""
    return runlog.prune(spark, root, keep)


def info(rows: DataFrame) -> DataFrame:
    """Completed samples and time of each run in result rows."""
    return rows.groupBy("task_name", "model_name").agg(F.count(F.lit(1)).alias("completed"), F.max("timestamp").alias("timestamp"))
