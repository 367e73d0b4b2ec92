"""Datasets and their subsets, documents of differing shapes, results as JSON, token events as a stream, patterns and prompts."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gaugewell.functions import patterns, refusal, templates
from gaugewell.operators import dashboard, diagnostics
from gaugewell.sources import datasets, result_json
from gaugewell.streaming import results, tokens


def test_subsets_and_their_files():
    assert len(datasets.SUBSETS) == 20 and all(datasets.subset_file(s) == f"BFCL_v3_{s}.json" for s in datasets.SUBSETS)
    assert {datasets.subset_file(s) for s in ("tiny", "mini", "nothing", "", None)} == {"BFCL_v3_simple.json"}


def test_datasets(spark, tmp_path):
    simple = [{"id": "a", "question": [[{"role": "user", "content": "q1"}]], "function": {"name": "f"}}, {"id": "b", "question": "q2", "function": []}]
    (tmp_path / "BFCL_v3_simple.json").write_text("\n".join([json.dumps(simple[0]), "no json {", "", json.dumps(simple[1])]))
    (tmp_path / "BFCL_v3_java.json").write_text(json.dumps({"id": "j", "question": "qj", "function": []}))
    (tmp_path / "possible_answer").mkdir()
    (tmp_path / "possible_answer" / "BFCL_v3_simple.json").write_text(json.dumps({"id": "a", "ground_truth": [{"f": {"k": ["1"]}}]}))
    one = datasets.Dataset(spark, str(tmp_path), "bfcl", subset="mini")
    got = {r.id: r for r in one.samples().collect()}
    assert (got["a"].prompt, got["a"].reference, got["b"].reference) == ("q1", [{"f": {"k": ["1"]}}], []) and len(got) == 2
    assert [(r.file, r.text) for r in one.bad_rows().collect()] == [("BFCL_v3_simple.json", "no json {")]
    java = datasets.Dataset(spark, str(tmp_path), "bfcl", subset="java")
    assert [(r.id, r.reference) for r in java.samples().collect()] == [("j", [])] and java.answers().count() == 0
    with pytest.raises(FileNotFoundError, match="BFCL_v3_sql"):
        datasets.Dataset(spark, str(tmp_path), "bfcl", subset="sql").rows()
    (tmp_path / "g" / "test").mkdir(parents=True)
    (tmp_path / "g" / "test" / "p.json").write_text('{"n": 1, "t": "x"}\n{"n": 2}\n[1]\n')
    (tmp_path / "g" / "empty.json").write_text("")
    generic = datasets.Dataset(spark, str(tmp_path / "g"), split="test")
    assert generic.schema().simpleString() == "struct<n:bigint,t:string>" and sorted((r.n, r.t) for r in generic.rows().collect()) == [(1, "x"), (2, None)]
    assert [r.text for r in generic.bad_rows().collect()] == ["[1]"]
    assert datasets.Dataset(spark, str(tmp_path / "g"), split="empty").schema().fields == [] and datasets.Dataset(spark, str(tmp_path / "g"), split="empty").rows().count() == 0
    assert generic.info() == {"path": str(tmp_path / "g"), "loader": "generic", "split": "test", "num_samples": 2, "schema": "struct<n:bigint,t:string>"}
    with pytest.raises(ValueError, match="extract"):
        generic.samples()
    time.sleep(1.1)  # file systems tell times of change by the second
    (tmp_path / "g" / "test" / "p.json").write_text('{"m": 1.5}\n')
    assert generic.schema().simpleString() == "struct<m:double>"


def test_dashboard_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"models": {"m1": {"humaneval": {"accuracy": 0.5, "samples": 4}, "bfcl": 0.25}, "m2": {}, "m3": {"hellaswag": {"accuracy": 0}}}, "generated_at": "1"}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"models": {"m1": {"humaneval": {"accuracy": 0.75}}}, "generated_at": "2"}))
    (tmp_path / "bad.json").write_text('{"models"')
    (tmp_path / "inf.json").write_text(json.dumps({"model": "m1", "overall_metrics": {"ttft_ms": {"mean": 12.5, "max": 20}, "throughput_tokens_per_sec": {"mean": 3}}}))
    path = lambda *n: [f"{tmp_path}/{x}.json" for x in n]
    docs, inf = dashboard.read_documents(spark, *path("a", "b", "bad", "none")), dashboard.read_documents(spark, *path("inf"))
    assert {r.source for r in docs.where("doc is null").collect()} == {"bad.json"}
    got = {r.model: r for r in dashboard.combined(docs, inf).collect()}
    assert (got["m1"].humaneval, got["m1"].hellaswag, got["m1"].bfcl, got["m1"].avg_accuracy, got["m1"].humaneval_samples) == (75.0, 0.0, 25.0, 50.0, 0)
    assert (got["m1"].ttft_ms, got["m1"].throughput, got["m1"].measured_in) == (12.5, 3.0, "inf.json") and got["m3"].avg_accuracy == 0.0 and got["m3"].ttft_ms is None
    assert {r.source for r in dashboard.scores(docs).where("model = 'm1'").collect()} == {"a.json", "b.json"}
    nothing = dashboard.read_documents(spark, *path("none"))
    assert nothing.count() == 0 and dashboard.combined(nothing, nothing).count() == 0
    rows = spark.createDataFrame([("x", 3), ("y", 1), ("x", 4), ("z", 0), ("y", 9), (None, 7)], "e string, at int")
    assert [(r.e, r.n) for r in dashboard.histogram(rows, "e", "at").collect()] == [("y", 2), ("x", 2), ("z", 1), (None, 1)]


def test_results_as_json(spark, tmp_path):
    schema = "idx long, sample_id string, task string, content string, confidence double, parser_used string, refusal_detected boolean, reference string, score double, passed boolean, execution_time double, error string, more map<string,string>, model string"
    rows = [(1, "s\"1", "a", 'x "y"\n{}', 0.5, "mc", True, "r", 1.0, True, 0.25, None, {"kept": '{"a":[1,null]}', "odd \"name": "true", "score": "9"}, "m"), (2, None, "b", None, None, None, None, None, None, None, None, "wrong", None, None)]
    df = spark.createDataFrame(rows, schema)
    result_json.write(df, str(tmp_path / "out"))
    got = {r.idx: r for r in result_json.read(spark, str(tmp_path / "out")).collect()}
    for r in rows:
        own = got[r[0]].asDict()
        assert own["version"] == 2 and own["wrong"] is None
        names = [x.split()[0] for x in schema.replace("string,string", "string").split(", ")]
        assert {k: own[k] for k in result_json.FIELDS} == {k: v for k, v in zip(names, r, strict=True) if k != "more"}
    assert got[1].more == {"kept": '{"a":[1,null]}', 'odd "name': "true"} and got[2].more == {}
    old = ['{"index": 3, "parsed_result": {"content": "c", "confidence": 1}, "later": [1]}', '{"version": 7, "idx": 4, "parsed": {"content": "d"}}', "[]", "no json"]
    got = result_json.from_json(spark.createDataFrame([(x, 5) for x in old], "doc string, extra int"), "doc").collect()
    assert [(r.version, r.idx, r.content, r.confidence, r.extra) for r in got] == [(1, 3, "c", 1.0, 5), (7, 4, "d", None, 5), (None, None, None, None, 5), (None, None, None, None, 5)]
    assert got[0].more == {"later": "[1]"} and [r.wrong for r in got] == [None, None, "[]", "no json"]


def test_checkpoint_documents(spark, tmp_path):
    doc = {"task_name": "t", "model_name": "m", "completed_indices": [4, 7], "timestamp": "2024", "metadata": {"k": [1]}, "results": [{"sample_id": "a", "parsed_result": {"content": "x", "confidence": 0.5}, "score": 1.0, "passed": True, "x": 1}, {"sample_id": "b", "parsed_result": None, "error": "e", "idx": 9}, "no object"]}
    for name, text in (("a", json.dumps(doc)), ("bad", '{"task'), ("other", '{"results": [{}]}'), ("none", json.dumps({"task_name": "u", "results": []}))):
        (tmp_path / f"{name}.json").write_text(text)
    got = sorted(result_json.read_checkpoints(spark, str(tmp_path)).collect(), key=lambda r: r.idx)
    assert [(r.idx, r.task, r.model, r.sample_id, r.content, r.score, r.passed, r.error, r.more, r.metadata) for r in got] == [(4, "t", "m", "a", "x", 1.0, True, None, {"x": "1"}, '{"k":[1]}'), (9, "t", "m", "b", None, None, None, "e", {}, '{"k":[1]}')]


def test_token_stream_equals_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(30):
        at = 1_700_000_000.0 + 120 * i
        rows.append((f"r{i}", "start", at, None))
        n = rng.randint(0, 6)
        rows += [(f"r{i}", "token", at + 0.5 * (k + 1), "" if k % 3 == 2 else "x") for k in range(n)]
        if i % 7:
            rows.append((f"r{i}", "end", at + 0.5 * (n + 2), "length" if i % 2 else "stop"))
    rows.append(("last", "start", 1_700_000_000.0 + 86_400, None))  # moves the watermark past the others
    df = spark.createDataFrame(rows, "request_id string, kind string, t double, text string").select("request_id", "kind", F.timestamp_seconds("t").alias("time"), "text")
    parts = df.withColumn("part", F.floor((F.unix_micros("time") / 1e6 - 1_700_000_000) / 1200))
    for p in sorted(r.part for r in parts.select("part").distinct().collect()):
        parts.where(F.col("part") == p).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01)
    batch = {r.request_id: r for r in tokens.requests(df).collect()}
    query = tokens.stream_requests(tokens.read_events(spark, str(tmp_path / "in"), 1)).writeStream.format("memory").queryName("token_requests_test").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = {r.request_id: r for r in spark.table("token_requests_test").collect()}
    assert set(got) == set(batch) - {"last"} and all(got[k] == batch[k] for k in got)
    assert tokens.late_events(query) == 0
    late = spark.createDataFrame([("r0", "token", 1_700_000_001.0, "x")], "request_id string, kind string, t double, text string").select("request_id", "kind", F.timestamp_seconds("t").alias("time"), "text")
    late.write.mode("append").parquet(str(tmp_path / "in"))
    query = tokens.stream_requests(tokens.read_events(spark, str(tmp_path / "in"), 1)).writeStream.format("memory").queryName("token_requests_test2").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert tokens.late_events(query) == 1
    assert tokens.requests(df.limit(0)).count() == 0
    s = tokens.summary(tokens.requests(df)).first()
    assert s.requests == sum(i % 7 > 0 for i in range(30))


def test_first_results_of_a_stream(spark, tmp_path):
    rows = [("t", "a", True, 0), ("t", "a", False, 10), ("t", "b", True, 20), ("u", "a", True, 30)]
    df = spark.createDataFrame(rows, "task string, sample_id string, passed boolean, s long").select("task", "sample_id", "passed", F.timestamp_seconds("s").alias("ts"))
    for i in range(4):
        df.where(F.col("ts") == F.timestamp_seconds(F.lit(10 * i))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01)
    stream = results.first_results(results.read_results(spark, str(tmp_path / "in"), "task string, sample_id string, passed boolean, ts timestamp", 1))
    query = stream.writeStream.format("memory").queryName("first_results_test").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert sorted((r.task, r.sample_id) for r in spark.table("first_results_test").collect()) == [("t", "a"), ("t", "b"), ("u", "a")]


def test_literals_never_lose_a_match(spark):
    every = [p for p, _ in refusal.PATTERNS + refusal.EMPTY] + [p for ps in diagnostics.FAMILIES.values() for p in ps]
    assert all(patterns.required(p) for p, _ in refusal.PATTERNS) and patterns.required(r"^\s*$") == () and patterns.required("(?i)abc") == () and patterns.required("a|b*") == ()
    assert patterns.required(r"x(?:ab|cd)+y") == ("ab", "cd") and patterns.required(r"[ab]c?d{2,}e") == ("d",)
    rng = random.Random(1)
    pieces = ["i cannot", "i can't", "i am ", "i'm ", "unable to ", "not able to", "provide", " ", "sorry,", "sorry ", "violates the ", "policy", "information", "more ", "i would need ", "syntax error", "timed  out", "no output", "i'd need", "code generation is not allowed", "beyond my knowledge", "n/a", "...", "xi cannoty", "invalid format"]
    texts = ["", " ", "[]", "null", *["".join(rng.choices(pieces, k=rng.randint(1, 5))) for _ in range(1500)]]
    for p in every:
        for t in texts:
            if re.search(p, t):
                assert not patterns.required(p) or any(x in t for x in patterns.required(p)), (p, t)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", patterns.found(F.col("t"), every).alias("f"), patterns.any_of(F.col("t"), every[:9]).alias("a"), refusal.analysis(F.col("t"))["matches"].alias("m")).collect()
    for r in got:
        assert r.f == [p for p in every if re.search(p, r.t)] and r.a == any(re.search(p, r.t) for p in every[:9])
        assert r.m == [p for p, _ in refusal.PATTERNS if re.search(p, r.t.strip().lower())]


def test_prompts_of_one_turn(spark):
    df = spark.createDataFrame([("Qwen2-7B", "p", "s"), ("other", "p", ""), ("gemma-2-9b", "p", None), (None, "p", None)], "model string, prompt string, system string")
    got = [r[0] for r in df.select(templates.one_shot(F.col("model"), F.col("prompt"), F.col("system"))).collect()]
    assert got == ["<|im_start|>system\ns<|im_end|>\n<|im_start|>user\np<|im_end|>\n<|im_start|>assistant\n", "User: p\nAssistant: ", "<start_of_turn>user\np<end_of_turn>\n<start_of_turn>model\n", "User: p\nAssistant: "]
    assert df.select(templates.one_shot(F.col("model"), F.col("prompt"), generation_prompt=False)).first()[0] == "<|im_start|>user\np<|im_end|>\n"
    texts = spark.createDataFrame([("a<|im_end|>b",), ("a</s>",), ("",), (None,)], "t string")
    assert [r[0] for r in texts.select(templates.until_stop(F.col("t"), "qwen")).collect()] == ["a", "a</s>", "", None]
    assert [r[0] for r in texts.select(templates.until_stop(F.col("t"), "default")).collect()] == ["a<|im_end|>b", "a</s>", "", None]
    assert [r[0] for r in spark.createDataFrame([("x<|end_of_text|>y<|eot_id|>",)], "t string").select(templates.until_stop(F.col("t"), "llama")).collect()] == ["x"]
    turns = [("user", f"u{i}") for i in range(6)] + [("system", "s"), ("assistant", "  "), ("tool", "t"), ("assistant", " a "), ("user", None)]
    kept = spark.createDataFrame([(turns,), ([],)], "m array<struct<role:string,content:string>>").select(templates.history(F.col("m"))).collect()
    assert [[tuple(x) for x in r[0]] for r in kept] == [[("user", "u3"), ("user", "u4"), ("user", "u5"), ("assistant", "a")], []]
