"""The evaluator, loaders, checkpoints, inference documents and reports beyond what their queries show."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gaugewell.functions import calls, code, jsons, refusal, robust, templates, text
from gaugewell.operators import evaluate, execution, manytasks, metrics, report, resume
from gaugewell.plans import config, registry
from gaugewell.sources import benchmarks, checkpoints, inference, reports
from gaugewell.sources.derived import CODE_OK, SHAPES


def test_client_errors_are_rows(spark):
    def client(prompt):
        if "bad" in prompt:
            raise RuntimeError(prompt)
        return f"The answer is {prompt[-1]}.", 4, "stop"

    data = [(0, "s0", "pick A", "A"), (1, "s1", "bad B", "B"), (2, "s2", "pick C", "B")]
    samples = spark.createDataFrame(data, "idx long, sample_id string, prompt string, reference string")
    quick = lambda p: client(p)
    got = {r.idx: r for r in evaluate.evaluate(execution_samples(samples, quick), "multiple_choice", "mc").collect()}
    assert (got[0].content, got[0].score, got[0].passed, got[0].error) == ("A", 1.0, True, None)
    assert (got[1].content, got[1].score, got[1].passed, got[1].error, got[1].parser_used) == (None, 0.0, False, "generation failed", None)
    assert (got[2].content, got[2].passed) == ("C", False)


def execution_samples(samples, client):
    return execution.generate(samples, client, retries=1, delay=0.0)


def test_replay_and_batches(spark):
    samples = spark.createDataFrame([("a", "x"), ("b", "y")], "sample_id string, prompt string")
    done = spark.createDataFrame([("a", "out", 3, 0.5, "stop")], "sample_id string, text string, tokens_generated int, generation_time double, finish_reason string")
    got = {r.sample_id: r for r in execution.replay(done, samples).collect()}
    assert got["a"].text == "out" and (got["b"].text, got["b"].finish_reason) == ("", "error")

    def many(prompts):
        if "y" in prompts and len(prompts) == 1:
            raise RuntimeError("no")
        return [(p.upper(), 1, "stop") for p in prompts]

    rows = execution.batched(many, samples.coalesce(1), size=1).collect()
    assert {r.prompt: (r.text, r.finish_reason) for r in rows} == {"x": ("X", "stop"), "y": ("", "error")}


def test_robust_columns_are_the_expression(spark):
    texts = [x.replace("{L}", "B").replace("{N}", "7") for x in SHAPES] + [None, "", "The answer is C.", "```python\nx = 1\n```", "plain words only here", "    indented\nmore", "def f(x):\n    return 1\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for order in (("code", "mc", "json"), ("json", "mc", "code"), ("mc",)):
        for least in (0.5, 0.99):
            a = {r.i: r.r.asDict() for r in df.select("i", robust.parse(F.col("t"), order, least).alias("r")).collect()}
            b = {r.i: {k: r[k] for k in ("content", "confidence", "parser_used")} for r in robust.parsed(df, "t", order, least).collect()}
            assert a == b
    one = df.select("i", jsons.extract(F.col("t")).alias("x"), jsons.confidence(F.col("t")).alias("c"), refusal.detect(F.col("t")).alias("d"), refusal.is_refusal(F.col("t")).alias("y"))
    two = jsons.with_json(refusal.detected(df.withColumn("t", F.coalesce("t", F.lit(""))), "t", "d"), "t", "x", "c")
    two = {r.i: (r.x, r.c, r.d) for r in two.collect()}
    assert all((r.x, r.c, r.d) == two[r.i] and r.y == r.d.is_refusal for r in one.collect())


def test_shapes_that_hold_code(spark):
    held = [x for x in SHAPES if any(x.startswith(s) for s in CODE_OK)]
    assert len(held) == len([x for x in SHAPES if "```" in x and x != "```\n```"]) == len(CODE_OK)


@pytest.mark.parametrize(
    "found,wanted,score",
    [
        ('{"name": "f", "arguments": {"k": 1}}', '[{"f": {"k": [1]}}]', 1.0),
        ('[{"name": "f", "arguments": {"k": 1.0}}, {"name": "f", "arguments": {}}]', '[{"f": {"k": [1]}}]', 0.5),
        ('[{"name": "f", "arguments": {"k": true}}]', '[{"f": {"k": [1]}}]', 1.0),
        ('[{"name": "f", "arguments": {"k": "1"}}]', '[{"f": {"k": [1]}}]', 0.0),
        ('[{"name": "f", "arguments": {"k": 2}}]', '[{"f": {"k": 2}}]', 1.0),
        ('[{"name": "f", "arguments": {"k": {"a": [1, 2]}}}]', '[{"f": {"k": [{"a": [1, 2]}]}}]', 1.0),
        ('[{"name": "f", "arguments": {}}, 3]', '[{"f": {}}]', 0.5),
        ('"text"', '[{"f": {}}]', 0.0),
        ("[]", '[{"f": {}}]', 0.0),
        ('[{"name": "f", "arguments": {}}]', "[]", 0.0),
        ('[{"name": "f", "arguments": {}}]', '{"f": {}}', 0.0),
        (None, None, 0.0),
    ],
)
def test_call_match(spark, found, wanted, score):
    df = spark.createDataFrame([(found, wanted)], "a string, b string")
    assert df.select(calls.match(calls.parse(F.col("a"), named=False), calls.expected(F.col("b")))).first()[0] == score


def test_call_match_parses_each_text_once(spark):
    """As one expression each use of the parsed texts parsed them again, for each call and parameter too; the results are those of that expression."""
    found = ['[{"name": "f", "arguments": {"k": 1}}, {"name": "g", "arguments": {}}]', '{"name": "f", "arguments": {"k": true}}', 'Calls: [{"name": "f", "arguments": {"k": [1]}}] ok', "```json\n[]\n```", "{'name': 'f'}", "[1", "", None]
    wanted = ['[{"f": {"k": [0]}}, {"f": {"k": [1, 2]}}, {"g": 1}]', '[{"f": {"k": 1}}, 3]', '[{"f": {"k": [[1.0]]}}]', '{"f": {}}', "[]", "[", None]
    df = spark.createDataFrame([(a, b) for a in found for b in wanted], "text string, reference string").coalesce(1)
    out = evaluate.evaluate(df, "function_call_match", "json")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("parseJson") <= 8
    many = manytasks.evaluate_tasks(df.withColumn("task", F.lit("t")), {"t": ("json", "function_call_match")})
    plain = df.select("text", "reference", jsons.extract(F.col("text")).alias("content"), jsons.confidence(F.col("text")).alias("confidence"))
    plain = plain.withColumn("score", calls.match(calls.parse(F.col("content"), named=False), calls.expected(F.col("reference"))))
    rows = [x.select("text", "reference", "content", "confidence", "score").collect() for x in (out, many, plain)]
    assert rows[0] == rows[1] == rows[2] and {r.score for r in rows[0]} == {0.0, 0.5, 1.0}


def test_sandbox_limits():
    run = lambda x, t=5.0: execution.execute(x, t, 512)
    assert run("print('a')\nimport json, math, re, collections")[:2] == (True, "a\n")
    for bad in ("e = eval\ne('1')", "import os", "import builtins\nbuiltins.eval('1')", "import importlib\nimportlib.import_module('os')", "x = open\nx('f', 'w')"):
        assert not run(bad)[0], bad
    assert len(run("print('x' * 10_000_000)")[1]) <= execution.KEPT
    late = run("while True:\n    pass", 1.0)
    assert late[5] and late[3] == -1 and late[4] < 4
    assert execution.blocked_modules(["numpy"], ("os",))[:2] == ["PyQt5", "PyQt6"] and "os" not in execution.blocked_modules(allowed=("os",))
    assert execution.imports("import b, a.c\nfrom z import q") == ["a.c", "b", "z"] and execution.imports("(") == []


def test_tests_of_a_task_are_run_from_one_interpreter(spark):
    """Programs of one task share the hash seed that interpreters of their own would differ in, and no state."""
    code = "import math\nn = getattr(math, 'n', 0) + 1\nmath.n = n\nprint(hash('a'), n)"
    rows = spark.range(6).coalesce(1).select("id", F.lit(code).alias("content"), F.lit("").alias("reference"), F.lit("assert n == 1").alias("test"), F.lit("f").alias("entry_point"))
    got = evaluate.scored(rows, "pass_at_k").collect()
    assert [r.passed for r in got] == [True] * 6 and len({r.output for r in got}) == 1


def test_rows_are_numbered_as_read(spark, tmp_path):
    rows = [{"n": i, "prompt": None if i % 5 == 2 else f"p{i}"} for i in range(200)]
    for k in range(4):
        (tmp_path / f"part-{k}.json").write_text("\n".join(json.dumps(r) for r in rows[50 * k : 50 * (k + 1)]))
    df = spark.read.schema("n long, prompt string").json(str(tmp_path))
    assert all(r.n == r.idx for r in benchmarks.numbered(df).collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert all(r.n == r.idx for r in benchmarks.numbered(spark.read.schema("n long, prompt string").json(str(tmp_path))).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    extract = lambda x: x.select("idx", F.concat(F.lit("id_"), F.col("idx").cast("string")).alias("id"), "prompt").where("prompt is not null")
    got = sorted(benchmarks.samples(df, extract, 10).collect(), key=lambda r: r.idx)
    want = [r for r in rows if r["prompt"]][:10]
    assert [(r.idx, r.id, r.prompt) for r in got] == [(i, f"id_{w['n']}", w["prompt"]) for i, w in enumerate(want)]


def test_benchmark_rows(spark):
    items = spark.createDataFrame([("t1", "p", "f", "sol", "def check(c): pass"), (None, "q", None, None, None), ("t3", None, "g", "s", "t")], benchmarks.HUMANEVAL)
    got = benchmarks.samples(items.coalesce(1), benchmarks.humaneval).collect()
    assert [(r.id, r.prompt, r.entry_point) for r in sorted(got, key=lambda r: r.idx)] == [("t1", "p", "f"), ("humaneval_1", "q", "")]
    shapes = ['{"name": "f", "description": "d", "parameters": {"type": "object"}}', '[{"name": "a"}, 3, {"description": "x"}]', '"{\\"name\\": \\"s\\"}"', '" "', "7"]
    rows = spark.createDataFrame([(s,) for s in shapes], "s string").select(benchmarks.bfcl_functions(F.parse_json("s")).alias("f")).collect()
    assert [[x.name for x in r.f] for r in rows] == [["f"], ["a", "unknown"], ["s"], [], []]
    assert rows[0].f[0].parameters == '{"type":"object"}'


def test_checkpoints(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    rows = spark.createDataFrame([(i, f"s{i}", i % 2 == 0) for i in range(6)], "idx long, sample_id string, passed boolean")
    with pytest.warns(UserWarning, match="no checkpoint"):
        assert checkpoints.load(spark, root, "t", "m") is None and checkpoints.listed(spark, root) == []
    path = checkpoints.save(rows.where("idx < 3"), root, "t/1", "m:e")
    assert path.endswith("/t_1_m_e") and checkpoints.has(spark, root, "t/1", "m:e")
    done = checkpoints.load(spark, root, "t/1", "m:e")
    assert [r.idx for r in resume.remaining(rows, done).orderBy("idx").collect()] == [3, 4, 5]
    checkpoints.save(rows, root, "t/1", "m:e", '{"k": 1}')
    one = checkpoints.info(checkpoints.load(spark, root, "t/1", "m:e")).first()
    assert (one.task_name, one.completed) == ("t/1", 6)
    for i in range(7):
        checkpoints.save(rows, root, "x", str(i), keep=5)
    assert len(checkpoints.listed(spark, root)) == 5 and not checkpoints.has(spark, root, "t/1", "m:e")
    assert checkpoints.delete(spark, root, "x", "6") and not checkpoints.delete(spark, root, "x", "6")
    (tmp_path / "c" / "bad_m" / "log").mkdir(parents=True)
    (tmp_path / "c" / "bad_m" / "log" / f"{0:020d}.json").write_text("no commit")
    with pytest.warns(UserWarning, match="torn"):
        assert checkpoints.load(spark, root, "bad", "m") is None
    assert checkpoints.clear(spark, root) == 5 and checkpoints.listed(spark, root) == []


def test_a_run_goes_on_from_its_checkpoint(spark, tmp_path):
    root = f"file://{tmp_path}/runs"
    samples = spark.createDataFrame([(i, f"s{i}", f"The answer is {'ABCD'[i % 4]}.", "A") for i in range(10)], "idx long, sample_id string, text string, reference string")
    seen = []

    def rows(part):
        seen.append(sorted(r.idx for r in part.select("idx").collect()))
        if len(seen) == 3:
            raise RuntimeError("interrupted")
        return evaluate.evaluate(part, "multiple_choice", "mc")

    with pytest.raises(RuntimeError):
        evaluate.run(samples, rows, root, "t", "m", every=4)
    assert checkpoints.load(spark, root, "t", "m").count() == 8
    got = sorted(evaluate.run(samples, rows, root, "t", "m", every=4).collect(), key=lambda r: r.idx)
    assert seen == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9], [8, 9]]
    assert [r.passed for r in got] == [i % 4 == 0 for i in range(10)] and "timestamp" not in got[0].asDict()
    assert evaluate.run(samples, rows, root, "t", "m", every=4).count() == 10 and len(seen) == 4
    assert evaluate.run(samples.where("false"), lambda p: evaluate.evaluate(p, "multiple_choice", "mc"), root, "t", "other").count() == 0


def test_model_info_and_wide_metrics(spark):
    info = execution.ModelInfo("m", context_length=10)
    df = spark.createDataFrame([("x" * 20,), ("x" * 44,), (None,)], "p string")
    assert [r[0] for r in df.select(info.fits(F.col("p"), 4)).collect()] == [True, False, True]
    long_ = spark.createDataFrame([("t1", "b", 0.5), ("t2", "a", 0.25)], "task string, name string, value double")
    got = {r.task: (r.a, r.b) for r in metrics.wide(long_, "task", "name", "value").collect()}
    assert got == {"t1": ("N/A", "0.5000"), "t2": ("0.2500", "N/A")}


def test_inference_documents(spark, tmp_path):
    stats = spark.createDataFrame([("m", 2.5, 10.0, 20.0, 3.0)], "model_name string, model_size_gb double, ttft_ms double, throughput_tok_s double, peak_ram_gb double")
    inference.write_metrics(stats, f"{tmp_path}/m")
    got = inference.read_metrics(spark, f"{tmp_path}/m").first()
    assert (got.model_name, got.ttft_ms, got.throughput_tok_s, got.peak_ram_gb, got.model_size_gb) == ("m", 10.0, 20.0, 3.0, 2.5)
    inference.write_context(spark.createDataFrame([(4096, 24.7)], inference.CONTEXT), f"{tmp_path}/c")
    assert inference.read_context(spark, f"{tmp_path}/c").first() == (4096, 24.7)
    (tmp_path / "models.json").write_text('[{"key": "a", "label": "A", "path": "/x/a.gguf"}]')
    (tmp_path / "one.json").write_text('{"key": "a"}')
    assert inference.models(spark, config=f"{tmp_path}/models.json").first().key == "a"
    with pytest.raises(ValueError):
        inference.models(spark, config=f"{tmp_path}/one.json")
    assert inference.models(spark, path="/m/big.gguf", key="k").first() == ("k", "big", "/m/big.gguf")
    assert [r.key for r in inference.models(spark).collect()] == ["qwen36_27b_q4km", "qwen36_27b_q80", "qwen36_27b_bf16"]


RESULT = "idx long, sample_id string, passed boolean, score double, execution_time double, error string, parse_error string, raw_output string, refusal_detected boolean, parser_used string"


def results(spark):
    rows = [(i, f"s{i}", i % 3 == 0, float(i % 3 == 0), 0.5, "Timed out: x" if i % 4 == 1 else None, "could not parse" if i % 7 == 2 else "", "raw", i % 5 == 4, None if i % 4 == 1 else "mc") for i in range(40)]
    return rows, spark.createDataFrame(rows, RESULT)


def test_report(spark):
    rows, df = results(spark)
    members = spark.createDataFrame([("even", f"s{i}") for i in range(0, 40, 2)], "category string, sample_id string")
    got = report.analyse(df, members)
    bad = [r for r in rows if not r[2]]
    kind = lambda r: "execution_error" if r[5] else "refusal" if r[8] else "parsing_error" if r[6] else "incorrect_output"
    assert (got.total, got.passed, got.failed) == (40, len(rows) - len(bad), len(bad)) and got.pass_rate == pytest.approx(14 / 40)
    assert got.kinds == {k: n for k in report.KINDS if (n := sum(kind(r) == k for r in bad))}
    assert got.patterns["timeout"] == sum(bool(r[5]) for r in bad) and got.categories["even"]["total"] == 20
    assert got.advice[0].startswith("WARNING") and any(a.startswith("TIMEOUTS") for a in got.advice)
    shown = report.ascii_report(got, 60)
    assert all(len(x) <= 60 for x in shown.split("\n")) and "timeout" in shown and "35.0%" in shown
    assert report.analyse(df.where("false")) == report.Report()
    console = report.console(df)
    assert "... and 30 more\n" in console and "errors" in console and "N/A" in console
    text_ = json.loads(reports.diagnostics_json(df).orderBy("json").first().json)
    assert set(text_) == {"sample_id", "passed", "score", "execution_time", "error"}
    assert "| timeout | 3 |" in reports.diagnostics_markdown({"total": 40}, [("timeout", 3)], got.advice)


def test_wrap():
    def simple(words, width):
        lines, line, size = [], [], 0
        for w in words:
            if size + len(w) + 1 <= width:
                line.append(w)
                size += len(w) + 1
            else:
                lines += [" ".join(line)] if line else []
                line, size = [w], len(w)
        return lines + ([" ".join(line)] if line else [])

    rng = random.Random(1)
    for _ in range(500):
        words = ["x" * rng.randint(1, 14) for _ in range(rng.randint(0, 12))]
        assert report.wrap(" ".join(words), 12) == simple(words, 12)


def test_small_rules(spark):
    df = spark.createDataFrame([("I cannot help with this one.", [1], None), ("fine then, long enough", [], "x"), (None, None, None)], "t string, a array<int>, e string")
    got = df.select(refusal.reason(F.col("t")).alias("r"), report.default_confidence(F.col("a"), "array").alias("c"), code.post_process(F.col("t"), True).alias("p")).collect()
    assert got[0].r.startswith(r"\b(i cannot") and got[1].r is None and got[2].r == "empty_input"
    assert [r.c for r in got] == [0.9, 0.5, 0.0] and got[2].p == ""
    assert refusal.is_refusal(F.lit("x")) is not None
    first = refusal.PATTERNS[0][0]
    told = lambda **k: df.select(refusal.detect(F.col("t"), **k)["pattern_matched"].alias("x")).first().x
    assert told() == first and told(without=(first,)) != first
    custom = df.select(refusal.detect(F.col("t"), custom=[("long enough", 0.8)])["pattern_matched"].alias("x")).collect()
    assert custom[1].x == "long enough"
    assert df.select(text.token_estimate(F.col("t"))).first()[0] == 7


def test_templates_and_parsers_of_ones_own(spark):
    templates.register("plain", {"system": "[{content}]", "user": "U:{content}\n", "assistant": "A:{content}\n"})
    try:
        assert "plain" in templates.listed()
        df = spark.createDataFrame([([("system", "s"), ("user", "q")],)], "m array<struct<role:string,content:string>>")
        assert df.select(templates.chat(F.col("m"), "plain")).first()[0] == "[s]U:q\nA:"
    finally:
        del templates.TEMPLATES["plain"]
    with pytest.raises(ValueError):
        templates.register("bad", {"system": "x", "user": "{content}", "assistant": "{content}"})
    own: registry.Parser = lambda c: F.struct(F.reverse(c).alias("content"), F.lit(1.0).alias("confidence"), F.lit("own").alias("parser_used"))
    registry.register("parser", "own", lambda: own)
    try:
        rows = spark.createDataFrame([("abc", "cba")], "text string, reference string")
        assert evaluate.evaluate(rows, "exact_match", registry.create("parser", "own")).first().passed
    finally:
        registry.unregister("parser", "own")


def test_scan_of_configurations(spark, tmp_path):
    good = "name: a\ntask_type: coding\ndataset:\n  path: p\n  loader: humaneval\nevaluation:\n  metric: pass_at_k\nparsing:\n  parser: code\n"
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.yaml").write_text(good)
    (tmp_path / "sub" / "b.yaml").write_text(good.replace("pass_at_k", "multiple_choice"))
    (tmp_path / "c.yaml").write_text("[1, 2")
    (tmp_path / "d.txt").write_text("no")
    got = {r.file: r for r in config.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.yaml", "sub/b.yaml", "c.yaml"}
    assert got["a.yaml"].is_valid and not got["sub/b.yaml"].is_valid and not got["c.yaml"].is_valid
