"""Operators on small tables, and all queries beside their SQL."""

import glob
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gaugewell.operators import diagnostics, execution, leaderboard, metrics, resume, running
from gaugewell.plans import catalog, config, registry
from gaugewell.sources import benchmarks, reports
from gaugewell.streaming import results

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        return
    want = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4


def test_empty_metrics(spark):
    none = spark.createDataFrame([], "passed boolean, execution_time double")
    assert metrics.core(none).first().asDict() == {"accuracy": 0.0, "total": 0, "passed": 0, "failed": 0, "avg_execution_time": 0.0}


def test_single_run_deviation(spark):
    one = spark.createDataFrame([("p", 1.0, 2.0, 3)], "prompt string, ttft_ms double, throughput double, tokens int")
    assert metrics.latency_per_prompt(one, "prompt").first()["ttft_std"] == 0.0


def test_leaderboard_golden(spark, tmp_path):
    models = {"qwen36_27b_bf16": (0.561, 0.9, 0.6325), "qwen3.6-35b-a3b-q8": (0.5, 0.76, 0.535), "gemma4-26b-a4b-bf16": (0.5671, 0.58, 0.55)}
    doc = {"models": {m: {b: {"accuracy": a} for b, a in zip(leaderboard.BENCHMARKS, v, strict=True)} for m, v in models.items()}}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    scores = reports.read_report(spark, str(tmp_path / "r.json")).withColumn("quantization", leaderboard.quantization(F.col("model")))
    board = leaderboard.display_rank(leaderboard.wide(scores, "model", "pos", "quantization")).orderBy("display_rank")
    got = [(r["model"], r["quantization"], r["humaneval"], r["avg_accuracy"]) for r in board.collect()]
    assert got == [("qwen36_27b_bf16", "BF16", 56.1, 69.78), ("gemma4-26b-a4b-bf16", "BF16", 56.71, 56.57), ("qwen3.6-35b-a3b-q8", "Q8_0", 50.0, 59.83)]
    assert reports.read_report(spark, str(tmp_path / "none.json")).count() == 0
    shown = board.select(leaderboard.display_name(F.col("model")).alias("n")).first()["n"]
    assert shown == "Qwen 3.6 27B (BF16)"


def test_positional_lengths(spark):
    with pytest.raises(ValueError):
        metrics.positional(spark.range(2), spark.range(3), "id")


def test_resume(spark):
    done = spark.createDataFrame([(1,), (2,)], "idx long")
    assert [r["idx"] for r in resume.remaining(spark.range(4).toDF("idx"), done).orderBy("idx").collect()] == [0, 3]
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in resume.last_wins(rows, "k", "o").collect()} == {("a", "y"), ("b", "z")}


def test_diagnostic_precedence(spark):
    row = spark.createDataFrame([(False, "e", "p", True, "raw")], "passed boolean, error string, parse_error string, refusal_detected boolean, raw_output string")
    assert diagnostics.categories(row).first()["category"] == "execution_error"


def test_safety_and_sandbox(spark):
    rows = spark.createDataFrame([(0, "print(6 * 7)"), (1, "import os"), (2, "1 / 0"), (3, "while True: pass"), (4, "x ="), (5, "eval('1')"), (6, "import math\nprint(math.pi)")], "i int, code string")
    safe = {r["i"]: r["safety"]["is_safe"] for r in execution.safety_check(rows, "code").collect()}
    assert safe == {0: True, 1: False, 2: True, 3: True, 4: False, 5: False, 6: True}
    ran = {r["i"]: r for r in execution.sandbox(rows, "code", timeout=2).collect()}
    assert ran[0]["success"] and ran[0]["output"] == "42\n" and ran[3]["timed_out"]
    assert "ZeroDivisionError" in ran[2]["error"] and not ran[1]["success"]


def test_generate(spark):
    def client(prompt):
        if prompt == "bad":
            raise RuntimeError
        return prompt.upper(), 1, "stop"

    rows = execution.generate(spark.createDataFrame([("a",), ("bad",)], "prompt string"), client, delay=0).collect()
    assert {(r["text"], r["finish_reason"]) for r in rows} == {("A", "stop"), ("", "error")}


def test_config():
    with pytest.raises(ValueError):
        config.read_yaml("")
    row = config.read_yaml("name: a\ntask_type: coding\ndataset: {path: p}\nparsing: {parser: code}\nevaluation: {metric: pass_at_k}")
    assert (row["dataset_path"], row["parser"], row["metric"]) == ("p", "code", "pass_at_k")


def test_registry():
    registry.register("parser", "x", lambda: 1)
    with pytest.raises(ValueError):
        registry.register("parser", "x", lambda: 2)
    assert registry.create("parser", "x") == 1
    registry.unregister("parser", "x")
    with pytest.raises(ValueError):
        registry.create("parser", "x")


def test_benchmarks(spark, tmp_path):
    (tmp_path / "q.json").write_text("\n".join(json.dumps(x) for x in [{"id": "1", "question": [[{"role": "user", "content": "hi"}]]}, {"id": "2", "question": "yo"}, {"id": "3", "question": ["t"]}, {"id": "4", "question": []}, {"id": "5", "question": [{"role": "user", "content": "one"}]}]))
    (tmp_path / "a.json").write_text(json.dumps({"id": "1", "ground_truth": [{"f": {"x": ["1"]}}]}))
    q = benchmarks.numbered(benchmarks.read_split(spark, str(tmp_path / "q.json"), benchmarks.BFCL))
    a = benchmarks.read_split(spark, str(tmp_path / "a.json"), benchmarks.ANSWERS)
    got = {r["id"]: (r["prompt"], len(r["reference"])) for r in benchmarks.bfcl(q, a).collect()}
    assert got == {"1": ("hi", 1), "2": ("yo", 0), "3": ("t", 0), "4": ("", 0), "5": ("one", 0)}
    h = spark.createDataFrame([(0, "c", None, None, ["x", "y"], "1", None, None)], benchmarks.HELLASWAG).withColumn("idx", F.col("ind"))
    row = benchmarks.hellaswag(h).first()
    assert row["reference"] == "B" and row["prompt"].endswith("C. N/A\nD. N/A")
    e = spark.createDataFrame([("t", "p", "f", None, None)], benchmarks.HUMANEVAL).withColumn("idx", F.lit(0))
    assert benchmarks.humaneval(e).first()["reference"] == ""


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("t", "s1", True, 1), ("t", "s2", False, 2)], "task string, sample_id string, passed boolean, at int").withColumn("ts", F.timestamp_seconds("at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = results.read_results(spark, str(tmp_path / "in"), rows.schema.simpleString()[7:-1].replace(":", " "))
    run = results.progress(stream).writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("progress").select("passed", "failed").first()[:] == (1, 1)


def test_code_queries_take_all_outputs(spark, tmp_path):
    """Code is in the outputs 9 (Python) and 13 (JavaScript) of every 14; the others have none."""
    spark.range(28).selectExpr("id as event_id", "id as user_id", "'view' as event_type", "1.0D as value").write.parquet(str(tmp_path / "events.parquet"))
    ok = {r["idx"]: r["ok"] for r in catalog.syntax_check(spark, str(tmp_path)).collect()}
    assert ok == {i: {9: True, 13: False}.get(i % 14) for i in range(28)}
    safe = {r["idx"]: (r["is_safe"], bool(r["violations"])) for r in catalog.safety_check(spark, str(tmp_path)).collect()}
    held = {9: (False, True), 23: (True, False), 13: (False, True), 27: (False, True)}
    assert safe == {i: held.get(i, (None, False)) for i in range(28)}


@pytest.mark.parametrize("width", [1, 3, 1 << 16])
def test_running_sums(spark, width):
    rows = [(g, n, (n or 0) % 3 == 0, "x") for g in ("a", None, "b") for n in (None, -7, -1, 0, 2, 3, 4, 11, 70000)] + [("hot", n, n % 2 == 0, "x") for n in range(500)]
    df = spark.createDataFrame(rows, "g string, n long, ok boolean, x_ok string")
    got = running.running_sums(df.repartition(5), {"good": F.col("ok").cast("int"), "all": F.lit(1)}, "n", "g", width=width)
    assert got.columns == ["g", "n", "ok", "x_ok", "good", "all"]
    want, sums = [], {}
    for g, n, ok, _ in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
        good, every = sums.get(g, (0, 0))
        sums[g] = (good + ok, every + 1)
        want.append((g, n, ok, *sums[g]))
    assert sorted(map(repr, want)) == sorted(repr((r.g, r.n, r.ok, r.good, r["all"])) for r in got.collect())
    assert running.running_sums(df.limit(0), {"good": F.lit(1)}, "n", "g", width=width).count() == 0


def test_running_sums_without_groups(spark):
    got = running.running_sums(spark.range(0, 1000, 1, 7), {"at": F.lit(1)}, "id", width=64).collect()
    assert sorted((r.id, r["at"]) for r in got) == [(i, i + 1) for i in range(1000)]
