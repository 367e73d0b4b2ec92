"""Logs that are stopped at any point, row failures, many tasks in one plan, the sandbox's guard, schemas and configurations."""

import json
import warnings

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugewell.functions import robust, schemas
from gaugewell.operators import evaluate, execution, manytasks
from gaugewell.operators.isolation import RowMetric, RowParser
from gaugewell.plans import config, evaluation, runs
from gaugewell.plans.runs import ESCAPES
from gaugewell.sources import checkpoints, runlog


class Killed(Exception):
    pass


class Killer(runlog.Store):
    """Ends at the nth operation that changes files, before or after it; a created file may be torn."""

    def __init__(self, spark, at, after, torn=False):
        super().__init__(spark)
        self.left, self.after, self.torn = at, after, torn

    def _do(self, act, tear=None):
        self.left -= 1
        if self.left == 0:
            if self.after:
                act()
            elif self.torn and tear:
                tear()
            raise Killed
        if self.left < 0:
            raise Killed
        return act()

    def write(self, rows, path):
        self._do(lambda: super(Killer, self).write(rows, path))

    def create(self, path, text):
        self._do(lambda: super(Killer, self).create(path, text), lambda: super(Killer, self).create(path, text[: len(text) // 2]))

    def delete(self, path):
        return self._do(lambda: super(Killer, self).delete(path))


@pytest.fixture
def quiet():
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        yield


def part(spark, step, value=0):
    return spark.range(step * 10, step * 10 + 10).select(F.col("id").alias("idx"), F.lit(value).alias("value"))


def state(log):
    rows = log.rows("idx")
    return {r.idx: r.value for r in rows.collect()} if rows is not None else {}


@pytest.mark.parametrize("after,torn", [(False, False), (True, False), (False, True)])
def test_a_kill_between_any_two_operations_loses_at_most_a_step(spark, tmp_path, quiet, after, torn):
    for at in range(1, 11) if not after and not torn else (2, 4, 8) if torn else (1, 6, 9):
        root = f"file://{tmp_path}/{at}-{after}-{torn}"
        log = runlog.RunLog(spark, root, "t", "m", Killer(spark, at, after, torn))
        done = []
        before = {}
        try:
            for step in range(3):
                log.append(part(spark, step))
                done.append(step)
                before = {i: 0 for s in done for i in range(10 * s, 10 * s + 10)}
            log.compact("idx")
            log.finish()
            log.tidy()
        except Killed:
            pass
        seen = runlog.RunLog(spark, root, "t", "m")
        got = state(seen)
        extra = set(got) - set(before)
        assert set(before) <= set(got) and len(extra) in (0, 10)  # a step may have been committed as the writer ended
        for step in range(3):  # whoever goes on finds the log in order
            if 10 * step not in got:
                seen.append(part(spark, step))
        assert state(seen) == {i: 0 for i in range(30)}
        seen.compact("idx")
        seen.tidy()
        assert state(seen) == {i: 0 for i in range(30)} and len(seen.store.names(f"{seen.path}/steps")) == 1


def test_log_keeps_the_last_of_a_sample_and_its_history(spark, tmp_path, quiet):
    root = f"file://{tmp_path}"
    log = runlog.RunLog(spark, root, "t/1", "m:x")
    assert log.path.endswith("/t_1_m_x") and log.rows() is None and not log.finished()
    log.append(part(spark, 0), {"k": 1})
    log.append(part(spark, 0, 5).where("idx < 3").withColumn("more", F.lit("x")))
    assert state(log) == {i: 5 if i < 3 else 0 for i in range(10)} and "more" in log.rows().columns
    with pytest.raises(runlog.Conflict):
        log.replace(part(spark, 1), after=0)
    log.finish()
    assert log.finished() and [c.action for c in log.commits()] == ["append", "append", "finish"] and log.commits()[0].metadata == {"k": 1}
    (tmp_path / "t_1_m_x" / "steps" / log.live()[1].step / "_SUCCESS").unlink()
    assert state(log) == {i: 0 for i in range(10)}  # a step that lost its end doesn't count
    log.compact("idx")
    assert log.finished() and [c.action for c in log.live()] == ["replace"]
    log.append(part(spark, 2))
    assert not log.finished()


def test_runs_in_progress_are_not_pruned(spark, tmp_path, quiet):
    root = f"file://{tmp_path}"
    for i in range(4):
        checkpoints.save(part(spark, i), root, "done", str(i), keep=None)
    going = runlog.RunLog(spark, root, "going", "m")
    going.append(part(spark, 0))
    assert checkpoints.prune(spark, root, 2) == 2
    assert {p.rsplit("/", 1)[-1] for p, _ in checkpoints.listed(spark, root)} == {"done_2", "done_3", "going_m"}
    got = {r["run"]: (r["commits"], r["n_rows"], r["finished"]) for r in runlog.runs(spark, root).collect()}
    assert got["done_3"] == (2, 10, True) and got["going_m"] == (1, 10, False)
    assert runlog.runs(spark, f"{root}/none").count() == 0


def test_steps_write_each_row_once_and_a_failing_save_warns(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    samples = spark.range(20).select(F.col("id").alias("idx"), F.lit("A").alias("text"), F.lit("A").alias("reference"))
    written = []
    write = runlog.Store.write
    monkeypatch.setattr(runlog.Store, "write", lambda self, rows, path: (write(self, rows, path), written.append(self.spark.read.parquet(path).count()))[0])
    rows = lambda p: evaluate.evaluate(p, "multiple_choice", "mc")
    assert evaluate.run(samples, rows, root, "t", "m", every=4, metadata={"parser": "mc"}).count() == 20
    log = runlog.RunLog(spark, root, "t", "m")
    assert written == [4] * 5 and log.finished() and log.commits()[0].metadata == {"parser": "mc"}

    def fail(self, path, text):
        raise OSError("full")

    monkeypatch.setattr(runlog.Store, "create", fail)
    with pytest.warns(UserWarning, match="not saved: OSError: full"):
        got = evaluate.run(samples, rows, root, "t", "other", every=10)
    assert got.count() == 20 and got.where("passed").count() == 20
    assert runlog.RunLog(spark, root, "t", "other").rows() is None


def test_row_failures(spark):
    def parse(text):
        if text == "bad":
            raise ValueError("no such thing")
        return (text[::-1], 0.25) if text else None

    rows = [("abc", "CBA"), ("bad", "x"), ("", "x"), (None, None), ("nan", "x"), ("zero", "x")]
    df = spark.createDataFrame(rows, "text string, reference string")
    own = RowParser(parse, "mine", pre=lambda t: t.strip(), post=str.upper)
    metric = RowMetric(lambda c, r: float("nan") if c == "NAN" else 1 / 0 if c == "OREZ" else c == r)
    got = {r.text: r for r in evaluate.evaluate(df, metric, own).collect()}
    assert (got["abc"].content, got["abc"].confidence, got["abc"].parser_used, got["abc"].score, got["abc"].passed, got["abc"].error) == ("CBA", 0.25, "mine", 1.0, True, None)
    assert (got["bad"].content, got["bad"].confidence, got["bad"].score, got["bad"].passed, got["bad"].error) == (None, 0.0, 0.0, False, "parser: ValueError: no such thing")
    assert (got[""].content, got[""].confidence, got[""].score) == (None, 0.0, 0.0) and got[None].passed  # null equals null
    assert got["nan"].error == "metric: ValueError: the score is no number" and got["zero"].error == "metric: ZeroDivisionError: division by zero" and got["zero"].content is None
    assert evaluate.evaluate(df.where("false"), metric, own).count() == 0


def test_pass_at_1_needs_code_and_an_entry_point(spark):
    check = "def check(f):\n    assert f(1) == 2\n"
    rows = [("def f(x):\n    return 2 * x", check, "f"), ("def f(x):\n    return x", check, "f"), ("def f(x):\n    return x", check, None), ("def f(x):\n    return x", check, " "), (None, check, "f"), ("x = 1", "assert x == 1", None), (None, None, None)]
    df = spark.createDataFrame([(i, *r, None) for i, r in enumerate(rows)], "idx int, text string, test string, entry_point string, reference string")
    got = [(r.passed, r.error if r.error is None or r.error.startswith("no ") else "raised") for r in evaluate.evaluate(df, "pass_at_k", "raw").orderBy("idx").collect()]
    assert got == [(True, None), (False, "raised"), (False, "no entry point for check()"), (False, "no entry point for check()"), (False, "no code"), (True, None), (True, None)]


def test_unknown_names_fail_before_anything_runs(spark):
    df = spark.createDataFrame([("x", "x", "a")], "text string, reference string, task string")
    for call in (lambda: evaluate.evaluate(df, "nope"), lambda: evaluate.evaluate(df, "exact_match", "nope"), lambda: manytasks.evaluate_tasks(df, {"a": ("mc", "nope")}), lambda: manytasks.evaluate_tasks(df, {"a": ("nope", "default")}), lambda: robust.Chain(("code", "nope")), lambda: robust.Chain(())):
        with pytest.raises(ValueError, match="unknown|none"):
            call()
    assert [r.passed for m in ("default", "composite", "exact_match") for r in evaluate.evaluate(df, m, "raw").collect()] == [True] * 3


def test_chains_of_parsers(spark):
    mine = lambda c: F.struct(F.upper(c).alias("content"), F.when(c.contains("!"), 0.9).otherwise(0.1).alias("confidence"), F.lit("mine").alias("parser_used"))
    chain = robust.Chain().add("refused", mine, 0)
    assert chain.order == ("refused", "code", "mc", "json") and chain.without("code").order == ("refused", "mc", "json") and chain.ordered("mc", "refused").order == ("mc", "refused")
    df = spark.createDataFrame([("wow! that is it",), ("The answer is B",), ("I cannot help with that.",)], "text string")
    got = [(r.content, r.parser_used) for r in robust.parsed(df, "text", chain=chain).collect()]
    assert got == [("WOW! THAT IS IT", "mine"), ("B", "mc"), ("I cannot help with that.", "refusal_fallback")] or got[0] == ("WOW! THAT IS IT", "refused")


TASKS = {"a": ("mc", "multiple_choice"), "b": ("code", "pass_at_k"), "c": ("json", "json_validity"), "d": ("robust", "composite"), "e": (RowParser(lambda t: t[0]), "default"), "f": ("raw", RowMetric(lambda c, r: 1 / len(c))), "g": ("json", "function_call_match")}


def test_many_tasks_are_one_scan(spark, tmp_path):
    check = "def check(c):\n    assert c(3) == 6\n"
    fence = "```python\ndef f(x):\n    return {}\n```"
    rows = [("a", "The answer is B", "B"), ("b", fence.format("2*x"), ""), ("b", fence.format("x"), ""), ("c", '{"a": 1}', ""), ("c", "no", ""), ("d", "The answer is C", "C"), ("e", "", ""), ("e", "good", "g"), ("f", "", ""), ("f", "x", ""), ("g", '{"name":"f","arguments":{"k":1}}', '[{"f":{"k":[1]}}]')]
    schema = "idx int, task string, text string, reference string, test string, entry_point string, finish_reason string, error string"
    spark.createDataFrame([(i, *r, check, "f", "error" if i == 3 else "stop", None) for i, r in enumerate(rows)], schema).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    out = manytasks.evaluate_tasks(df, TASKS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    got = {r.idx: r for r in out.collect()}
    assert len(got) == len(rows)
    for name, (parser, metric) in TASKS.items():
        alone = evaluate.evaluate(df.where(F.col("task") == name), metric, parser)
        for r in alone.collect():
            for c in ("content", "confidence", "parser_used", "refusal_detected", "score", "passed", "error"):
                a, b = got[r.idx][c], r[c]
                if c == "error" and a and "Traceback" in a:
                    a, b = a.splitlines()[-1], b.splitlines()[-1]
                assert a == b, (name, r.idx, c)
    more = spark.createDataFrame([(1, "zz", "q", "q"), (2, None, None, None)], "idx int, task string, text string, reference string")
    assert [r.error for r in manytasks.evaluate_tasks(more, {"a": ("mc", "default")}).orderBy("idx").collect()] == ["no task zz", "no task null"]


@pytest.mark.parametrize("code,error", ESCAPES[:-1])
def test_escapes_end_inside_the_run(code, error):
    ok, _, wrong, *_ = execution.execute(code, 10, 512)
    assert ok == (error is None) and (error is None or wrong.strip().splitlines()[-1].startswith(error))


def test_what_programs_may_do():
    run = lambda x: execution.execute(x, 10, 1024)
    library = "import bisect, calendar, collections, contextlib, copy, dataclasses, datetime, decimal, enum, fractions, functools, hashlib, heapq, inspect, itertools, json, math, operator, random, re, statistics, string, struct, textwrap, time, traceback, typing, unicodedata, uuid\nfrom collections import namedtuple\nP = namedtuple('P', 'a b', defaults=[1])\n@dataclasses.dataclass\nclass D:\n    x: int = 1\nprint(D(2), P(3), decimal.Decimal('1.5'), datetime.date(2020, 1, 2))"
    assert run(library)[:2] == (True, "D(x=2) P(a=3, b=1) 1.5 2020-01-02\n")
    ok, said, *_ = run("print('x' * 2_000_000)")
    assert ok and len(said) == execution.KEPT
    assert run("import sys")[0] is False and run("raise SystemExit(3)")[3] == 3
    assert run("import numpy as np\nprint(np.arange(4).sum())")[1] == "6\n"


def test_programs_share_an_interpreter_and_nothing_else():
    with execution.Sandbox() as box:
        run = lambda x, t=5.0: box.run(x, t, 512)
        assert run("import math\nmath.pi = 3\nprint(math.pi)")[1] == "3\n"
        server = box.server.pid
        assert run("import math\nprint(math.pi > 3)")[1] == "True\n"
        assert run("while True:\n    pass", 0.5)[5] and run("x = 'a' * 10**10")[0] is False
        assert run("import atexit\natexit.register(print, 'late')\nraise SystemExit(3)")[1:4] == ("late\n", None, 3)
        assert run("print('é' * 3, end='\\r')")[1] == "ééé\r" and "surrogates" in run("\ud800")[2]
        assert [len(run("print('x' * 3_000_000)")[1]), run("print(1)")[1]] == [execution.KEPT, "1\n"]
        assert box.server.pid == server and box.server.poll() is None
        box.server.kill()
        assert run("print(2)")[:4] == (True, "2\n", None, 0)
        server = box.server
    assert server.poll() is not None


def faults(box):
    """Pages that the programs of a sandbox have touched."""
    return int(open(f"/proc/{box.server.pid}/stat").read().rsplit(")", 1)[1].split()[8])


@pytest.mark.parametrize("end,ok", [("", True), ("import math\nmath.x = f", True), ("assert f(1) == 2", False), ("raise SystemExit(3)", False)])
def test_a_program_ends_without_taking_the_interpreter_apart(end, ok):
    with execution.Sandbox() as box:
        box.run("", 5.0, 512)
        before = faults(box)
        assert [box.run(f"def f(x):\n    return x\n{end}", 5.0, 512)[0] for _ in range(20)] == [ok] * 20
        # a function that a module of the library holds might still act, so the interpreter is taken apart
        assert ((faults(box) - before) / 20 < 1000) == ("math" not in end)


SAYS = "class A:\n    def __del__(self):\n        print('gone')\na = A()\n"
ENDS = [
    (SAYS, True, "gone\n", 0),
    (SAYS + "a.a = a", True, "gone\n", 0),
    (SAYS + "a.a = a\n1 / 0", False, "gone\n", 1),
    (SAYS + "import math\nmath.a = a\ndel a\nraise SystemExit(4)", False, "gone\n", 4),
    ("import math\ndef g():\n    try:\n        yield\n    finally:\n        print('closed')\nmath.g = g()\nnext(math.g)", True, "closed\n", 0),
    ("import atexit, weakref\nclass A: pass\na = A()\nweakref.finalize(a, print, 'fin')\natexit.register(print, 'late')\nprint('no end', end=' ')\n1 / 0", False, "no end late\nfin\n", 1),
    ("import atexit\natexit._run_exitfuncs()\nprint('still here')", True, "still here\n", 0),
    ("import inspect, io\nprint('first')\ninspect.sys.stdout = io.StringIO()\nprint('lost')", True, "first\n", 0),
    ("import inspect\ndef hook(*a): raise SystemExit(9)\ninspect.sys.excepthook = hook\n1 / 0", False, "", 9),
    ("raise SystemExit('no')", False, "", 1),
    ("raise SystemExit(256)", True, "", 0),
    ("raise SystemExit", True, "", 0),
    ("raise KeyboardInterrupt", False, "", -2),
]


def test_ends_of_programs_are_as_ever():
    with execution.Sandbox() as box:
        for code, ok, said, status in ENDS:
            got = box.run(code, 5.0, 512)
            assert (got[0], got[1], got[3]) == (ok, said, status), code


def test_programs_of_one_row_group_are_dealt_out(spark, tmp_path):
    """Of the splits of a file with one row group one holds all rows, so their number says nothing of how the programs are spread."""
    pd.DataFrame({"s_suppkey": range(800), "s_name": [f"{k:>60}" for k in range(800)]}).to_parquet(tmp_path / "supplier.parquet")
    names = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        for query in (evaluation.evaluate_pass_at_1, runs.sandbox_escapes):
            out = query(spark, str(tmp_path))
            counts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(counts) == 800 and max(counts) <= 200
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_outcomes_in_bounded_pieces(monkeypatch):
    monkeypatch.setattr(execution, "PIECE_ROWS", 3), monkeypatch.setattr(execution, "PIECE_CHARS", 100)
    codes = ["print('x' * 99)", "print(1)", None, "print(3)", "import os", "print(5)", "print(6)"]
    frames = [pd.DataFrame({"i": range(k, k + 7), "code": codes}, index=range(7, 14)) for k in (0, 7)] + [pd.DataFrame({"i": [], "code": []})]
    got = list(execution.outcomes(iter(frames), "code", 5.0, 512, set(execution.BLOCKED_MODULES), set(execution.BLOCKED_CALLS)))
    assert [len(x) for x in got] == [1, 3, 3] * 2
    rows = pd.concat(got)
    assert list(rows["i"]) == list(range(14)) and list(rows["output"].fillna("null")) == ["x" * 99 + "\n", "1\n", "null", "3\n", "", "5\n", "6\n"] * 2


CASES = [
    ({"type": ["integer", "null"], "minimum": 2}, ["2", "2.0", "null", "1", "2.5", "true", '"2"'], [None, None, None, "$: less than 2", "$: not of type integer or null", "$: not of type integer or null", "$: not of type integer or null"]),
    ({"required": ["k", "it's"], "properties": {"k": {"enum": [1, "b", None, [1, 2], {"z": 1, "a": True}]}}}, ['{"k": [1, 2], "it\'s": 0}', '{"k": {"a": true, "z": 1}, "it\'s": null}', '{"k": 2, "it\'s": 0}', '{"k": 1}', "[]"], [None, None, "$.k: not one of [1, 'b', None, [1, 2], {'z': 1, 'a': True}]", "$: it's is missing", None]),
    ({"items": {"properties": {"x": {"type": "string"}}, "additionalProperties": False}}, ['[{"x": "a"}, {}]', '[{"x": "a"}, {"x": 1}]', '[{"y": 1}]', "3"], [None, "$[1].x: not of type string", "$[0]: y not expected", None]),
    ({"oneOf": [{"minLength": 3, "type": "string"}, {"$ref": "#/definitions/n"}], "definitions": {"n": {"type": ["number", "string"], "exclusiveMaximum": 5, "multipleOf": 0.5}}}, ['"ab"', '"abc"', "4.5", "5", "4.3"], [None, "$: fits more than one of the schemas given", None, "$: fits none of the schemas given", "$: fits none of the schemas given"]),
    ({"allOf": [{"maxLength": 2}, {"not": {"const": "no"}}], "pattern": "^[a-z]"}, ['"ok"', '"no"', '"abc"', '"Ab"', "7"], [None, "$: fits a schema that it must not fit", "$: longer than 2", "$: does not match ^[a-z]", None]),
    ({"minItems": 2, "maxItems": 3, "uniqueItems": True, "anyOf": [{"type": "array"}]}, ["[1, 2]", "[1]", "[1, 1]", "[1, 2, 3, 4]", "{}"], [None, "$: fewer than 2 items", "$: items that repeat", "$: more than 3 items", "$: fits none of the schemas given"]),
    ({"minProperties": 1, "maxProperties": 1, "exclusiveMinimum": 0, "maximum": 9, "additionalProperties": {"type": "integer"}}, ['{"a": 1}', "{}", '{"a": 1, "b": 2}', '{"a": "x"}', "0", "10", "nope"], [None, "$: fewer than 1 fields", "$: more than 1 fields", "$.a: not of type integer", "$: not more than 0", "$: more than 9", "not JSON"]),
    ({"properties": {"a": {"properties": {"b": {"type": "string"}}}, "c": {"anyOf": [{"type": "null"}]}, "d": {"const": 1}}}, ['{"a": {"b": 1}, "c": 1, "d": 2}', '{"a": {"b": 1}, "c": 1}'], ["$.d: not 1", "$.c: fits none of the schemas given"]),
    (True, ["1", "null"], [None, None]),
    (False, ["1"], ["$: nothing is allowed here"]),
]


@pytest.mark.parametrize("schema,values,errors", CASES)
def test_schemas(spark, schema, values, errors):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = df.select("i", schemas.validate(F.col("v"), schema).alias("r")).orderBy("i").collect()
    assert [r.r.error for r in got] == errors and all(r.r.is_valid == (r.r.error is None) for r in got)


def test_schemas_that_cannot_be_compiled(spark):
    for schema in ({"if": {}}, {"patternProperties": {}}, {"type": "text"}, {"$ref": "#/x"}, {"$ref": "http://x"}, {"properties": {"a": {"$ref": "#"}}}, {"items": [{}]}, {"resolve": 1}):
        with pytest.raises(ValueError):
            schemas.errors(F.parse_json(F.lit("1")), schema)
    every = spark.createDataFrame([("{}",)], "v string").select(F.transform(schemas.errors(F.parse_json("v"), {"required": ["a", "b"], "minProperties": 1}), schemas.text_of).alias("e")).first().e
    assert every == ["$: a is missing", "$: b is missing", "$: fewer than 1 fields"]


def document(**parts):
    doc = {"name": "n", "task_type": "coding", "dataset": {"path": "p", "loader": "humaneval", "split": "test", "subset": None, "num_samples": None}, "prompt": {"template": "{prompt}", "system_message": "s", "few_shot": []}, "generation": {"max_tokens": 512, "temperature": 0.0, "top_p": 1.0, "stop_sequences": ["\nclass"], "num_return_sequences": 1}, "parsing": {"parser": "code", "extraction_mode": "last_block", "language": "python"}, "evaluation": {"metric": "pass_at_k", "k": 1, "timeout": 5.0, "sandbox": True}, "metadata": {"version": "1.0", "author": "a", "tags": ["x"]}}
    for k, v in parts.items():
        doc[k] = doc[k] | v if isinstance(v, dict) else v
    return doc


#: Documents of the shapes that configurations have: coding in full and small, calls of three sizes, endings of three sizes.
VALID = [document(), document(name="small", dataset={"num_samples": 20}), *[document(name=f"calls{n}", task_type="function_call", dataset={"loader": "bfcl", "subset": s, "num_samples": n}, parsing={"parser": "json", "language": None}, evaluation={"metric": "function_call_match"}) for n, s in ((None, "simple"), (20, None), (5, "parallel"))], *[document(name=f"choice{n}", task_type="multiple_choice", dataset={"loader": "hellaswag", "num_samples": n}, parsing={"parser": "mc"}, evaluation={"metric": "multiple_choice"}) for n in (None, 100, 20)]]


def test_configurations(spark, tmp_path):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(VALID)], "i int, doc string")
    assert [r.errors for r in config.validate_documents(df, "doc").collect()] == [[]] * len(VALID)
    wrong = [
        (document(generation={"temperature": 3}), ["$.generation.temperature: more than 2"]),
        (document(parsing={"parser": "mc"}), ["coding cannot use parser mc"]),
        (document(parsing={"parser": "other"}, evaluation={"k": 0}), ["$.parsing.parser: not one of ['code', 'mc', 'json', 'robust']", "coding cannot use parser other"]),
        ({"task_type": "reasoning"}, ["missing name", "missing dataset", "missing evaluation", "$: name is missing"]),
        (document(dataset={"num_samples": True}), ["$.dataset.num_samples: not of type integer or null"]),
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(wrong)] + [(9, None)], "i int, doc string")
    assert [r.errors for r in config.validate_documents(df, "doc").orderBy("i").collect()] == [e for _, e in wrong] + [["not JSON"]]
    (tmp_path / "a.yaml").write_text(json.dumps(VALID[0]))  # JSON is YAML
    (tmp_path / "b.yml").write_text("name: b\n")
    (tmp_path / "empty.yaml").write_text("")
    path = str(tmp_path)
    got = {r.file: r.errors for r in config.scan(spark, path).collect()}
    assert got["a.yaml"] == [] and got["b.yml"][:2] == ["missing task_type", "missing dataset"] and got["empty.yaml"] == ["empty configuration"]
    assert config.check_file(spark, f"{path}/empty.yaml") == (False, ["empty configuration"])
    assert config.check_file(spark, f"{path}/none.yaml")[1] == [f"no such file: {path}/none.yaml"]
    assert config.scan(spark, f"{path}/none").first()["errors"] == [f"no such folder: {path}/none"]
    (tmp_path / "b.yml").unlink(), (tmp_path / "empty.yaml").unlink()
    task = config.tasks(spark, path)["n"]
    assert (task.parser, task.metric, task.split, task.timeout, task.max_tokens) == ("code", "pass_at_k", "test", 5.0, 512)
    assert config.Task.of({"name": "x"}) == config.Task("x") and config.Task.of({"name": "x", "dataset": None}).metric == "exact_match"
    assert config.task_schema() == config.TASK_SCHEMA and config.task_schema() is not config.TASK_SCHEMA
