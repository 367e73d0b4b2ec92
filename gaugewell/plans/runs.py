"""Queries of runs: error rows, many tasks in one plan, logs, the sandbox's guard, and schemas of documents."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from ..functions import choice, schemas
from ..operators import execution, manytasks
from ..operators.evaluate import evaluate
from ..operators.isolation import RowMetric, RowParser
from ..sources import runlog
from ..sources.derived import MODEL_OUTPUTS_SQL as OUT
from ..sources.derived import dealt, model_outputs, table
from . import config
from .catalog import _BLOCKS, _CLEAN, _T, JSON, SCORED, _q, _strip, _valid, query


def _first_words(text: str) -> str:
    if "SORRY" in text:
        raise ValueError("an apology")
    return text[:9]


def _tenth(content: str | None, reference: str | None) -> float:
    if "{" in content:
        raise KeyError("brace")
    return len(content) / 10


@query(f"""select idx, case when wrong is null then content end as content, case when wrong is null then score else 0 end::double as score, wrong is null and score >= 1 as passed, wrong as error
 from (select *, length(content) / 10 as score, case when contains(upper(raw_output), 'SORRY') then 'parser: ValueError: an apology' when contains(content, '{{') then 'metric: KeyError: ''brace''' end as wrong
  from (select *, left(upper(raw_output), 9) || '!' as content from {OUT}))""")
def evaluate_error_rows(spark, d):
    """A parser with hooks and a metric in Python, which raise on some rows: these become error rows, and the rest is scored."""
    rows = model_outputs(spark, d).select("idx", F.col("raw_output").alias("text"), F.col("ref").alias("reference"))
    own = RowParser(_first_words, "first_words", pre=str.upper, post=lambda c: c + "!")
    return evaluate(rows, RowMetric(_tenth), own).select("idx", "content", "score", "passed", "error")


_CODE = f"coalesce({_BLOCKS}[-1].code, {_CLEAN})"
_ROBUST = f"""case when refusal_detected then {_strip('raw_output')} when code_conf >= 0.5 then code when mc_conf >= 0.5 then pred else json end"""
TASKS = {"task_0": ("mc", "multiple_choice"), "task_1": ("json", "json_validity"), "task_2": ("robust", "composite"), "task_3": ("code", "default")}


@query(f"""select idx, task, content, case when right_ then 1.0 else 0.0 end::double as score, right_ as passed from (select *, case task when 'task_1' then {_valid('content')} else content = ref end as right_
 from (select *, case task when 'task_0' then pred when 'task_1' then json when 'task_2' then {_ROBUST} else code end as content
 from (select *, (case when raw_output = '' then 0.0 when len({_BLOCKS}) > 0 then 0.95 else 0.3 end) as code_conf, {_CODE} as code, {JSON} as json,
  case when pred = '' then 0.0 {' '.join(f'when regexp_matches({_T}, {_q(p)}) then {v}' for p, v in choice.PATTERNS)} else 0.3 end as mc_conf from {SCORED})))""")
def evaluate_many_tasks(spark, d):
    """Four tasks with parsers and metrics of their own over one scan."""
    rows = model_outputs(spark, d).select("idx", "task", F.col("raw_output").alias("text"), F.col("ref").alias("reference"))
    return manytasks.evaluate_tasks(rows, TASKS).select("idx", "task", "content", "score", "passed")


@query(f"select task, count(*) as total, count(*) filter (passed) as passed from (select task, case when task in ('task_0', 'task_2') then pred = ref else false end as passed from {SCORED}) where task <> 'task_3' group by task")
def evaluate_tasks_unknown(spark, d):
    """Rows of a task that nobody has configured are error rows; here they are told by their error and left out."""
    rows = model_outputs(spark, d).select("task", F.col("raw_output").alias("text"), F.col("ref").alias("reference"))
    out = manytasks.evaluate_tasks(rows, {"task_0": ("mc", "multiple_choice"), "task_2": ("mc", "exact_match"), "task_1": ("mc", lambda c, r: F.lit(0))})
    out = out.where("error is null or error not like 'no task%'")
    return out.groupBy("task").agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"))


_BUILTIN = "g = __import__\nimp = getattr(g, '__defa' + 'ults__')[-3]\n"
_OS = _BUILTIN + "os = imp('os')\n"
#: Programs that look for a way out, each past the check of names, and the error that they end with.
ESCAPES = [
    ("print(sum(range(10)))", None),
    ("g = __import__; getattr(g, '__glo' + 'bals__')['real']('os')", "KeyError"),
    (_OS + "os.system('true')", "PermissionError"),
    (_OS + "os.fork()", "PermissionError"),
    (_OS + "os.open('/etc/hostname', 0)", "PermissionError"),
    (_OS + "os.listdir('/')", "PermissionError"),
    (_OS + "os.kill(os.getppid(), 0)", "PermissionError"),
    (_OS + "os.open(getattr(os, '__fi' + 'le__') + '/../../../../../../../etc/hostname', 0)", "PermissionError"),
    (_BUILTIN + "imp('builtins').open('/etc/hostname')", "PermissionError"),
    (_BUILTIN + "imp('builtins').open('x', 'w')", "PermissionError"),
    (_BUILTIN + "imp('subprocess').run(['true'])", "ImportError"),
    (_BUILTIN + "imp('socket').socket()", "PermissionError"),
    (_BUILTIN + "imp('ctypes')", "ImportError"),
    (_BUILTIN + "imp('gc').get_objects()", "PermissionError"),
    ("for c in getattr(object, '__subcla' + 'sses__')():\n    if 'wrap_close' in repr(c):\n        getattr(getattr(c, '__in' + 'it__'), '__glo' + 'bals__')['system']('true')", "PermissionError"),
    (_BUILTIN + "try:\n    imp('builtins').open('/etc/hostname')\nexcept PermissionError as e:\n    f = getattr(e, '__trace' + 'back__').tb_next.tb_frame\n    f.f_locals['refused'] = ('z',)\n    f.f_locals['prefixes'] = ('/',)\nimp('builtins').open('/etc/hostname')", "PermissionError"),
    ("print('x' * 2000000)", None),
]
_ended = " ".join(f"when {i} then {_q(e)}" for i, (_, e) in enumerate(ESCAPES) if e)


@query(f"select s_suppkey, error is null as success, error from (select s_suppkey, case s_suppkey % {len(ESCAPES)} {_ended} end as error from supplier)")
def sandbox_escapes(spark, d):
    """Programs that reach for files, processes, sockets or foreign code by other names end with an error inside their run; what they may do runs."""
    rows = table(spark, d, "supplier").select("s_suppkey", F.get(F.array(*[F.lit(c) for c, _ in ESCAPES]), (F.col("s_suppkey") % len(ESCAPES)).cast("int")).alias("code"))
    ran = execution.sandbox(dealt(rows), "code")
    last = F.regexp_extract(F.coalesce("error", F.lit("")), r"(?s).*\n(\w+Error)\b", 1)
    return ran.select("s_suppkey", "success", F.when(last != "", last).alias("error"))


class _Stopped(Exception):
    pass


class _StopsAtCommit(runlog.Store):
    """A writer that ends after its rows are written and before they are committed."""

    def create(self, path, text):
        raise _Stopped(path)


def _log(spark, d):
    """A run over all outputs in steps: two that hold, one that was stopped, one that writes some rows again with an added column, and a torn commit."""
    out = model_outputs(spark, d).select("idx", "task", F.col("execution_time").alias("seconds"), (F.col("idx") % 4).alias("step"))
    log = runlog.RunLog(spark, runlog.shared_root(spark), "all/outputs", "m:1")
    log.append(out.where("step = 0"), {"every": 4})
    log.append(out.where("step = 1"))
    try:
        runlog.RunLog(spark, log.path.rsplit("/", 1)[0], "all/outputs", "m:1", _StopsAtCommit(spark)).append(out.where("step = 2"))
    except _Stopped:
        pass
    log.append(out.where("step = 3 or step = 0 and idx % 3 = 0").withColumn("again", F.col("step") == 0), {"every": 4})
    log.store.create(f"{log.path}/log/{9:020d}.json", '{"commit": 9, "action": "app')
    return log


@query(f"select idx, task, execution_time as seconds, case when idx % 4 = 3 or idx % 3 = 0 and idx % 4 = 0 then idx % 4 = 0 end as again from {OUT} where idx % 4 <> 2")
def run_log_rows(spark, d):
    """What a run's log holds after a writer was stopped and a commit torn: committed steps, the last of each sample, with columns that came later."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return _log(spark, d).rows("idx").select("idx", "task", "seconds", "again")


@query(f"""select * from (select 0::bigint as commit, 'append' as action, count(*) filter (idx % 4 = 0) as n_rows, '{{"every": 4}}' as metadata from {OUT}
 union all select 1, 'append', count(*) filter (idx % 4 = 1), '{{}}' from {OUT} union all select 2, 'append', count(*) filter (idx % 4 = 3 or idx % 12 = 0), '{{"every": 4}}' from {OUT}
 union all select 10, 'replace', count(*) filter (idx % 4 <> 2), '{{"compacted": true}}' from {OUT})""")
def run_log_history(spark, d):
    """The commits of a run and the one that put its rows together; a torn one keeps its number and doesn't count."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        log = _log(spark, d)
        log.compact("idx", {"compacted": True})
        return log.history().select("commit", "action", "n_rows", "metadata")


_DOCS = [
    '{{"name": "n{k}", "task_type": "coding", "dataset": {{"path": "p", "loader": "humaneval"}}, "evaluation": {{"metric": "pass_at_k"}}, "parsing": {{"parser": "code"}}}}',
    '{{"name": "n{k}", "task_type": "coding", "dataset": {{"path": "p", "loader": "humaneval"}}, "evaluation": {{"metric": "multiple_choice"}}, "parsing": {{"parser": "mc"}}}}',
    '{{"name": {k}, "task_type": "multiple_choice", "dataset": {{"path": "p", "loader": "hellaswag"}}, "evaluation": {{"metric": "multiple_choice"}}, "parsing": {{"parser": "robust"}}}}',
    '{{"name": "n{k}", "task_type": "function_call", "dataset": {{"path": "p", "loader": "bfcl", "num_samples": 0}}, "evaluation": {{"metric": "json_validity"}}}}',
    '{{"name": "n{k}", "task_type": "reasoning", "dataset": {{"loader": "gsm8k"}}, "evaluation": {{"metric": "exact_match", "k": 1.5}}, "generation": {{"temperature": {k}}}}}',
    '{{"name": "n{k}", "task_type": "other", "dataset": {{"path": "p", "loader": "generic"}}}}',
    '["n{k}"]',
    '{{"name": "n{k}"',
    '{{"name": "n{k}", "task_type": "reasoning", "dataset": {{"path": "p", "loader": "generic", "subset": null}}, "evaluation": {{"metric": "composite"}}, "prompt": {{"few_shot": [{{"input": "a", "output": "b"}}, {{"input": {k}}}]}}, "metadata": {{"tags": ["a"]}}}}',
]
_FOUND = [
    [],
    ["coding cannot use parser mc", "coding cannot use metric multiple_choice"],
    ["$.name: not of type string"],
    ["$.dataset.num_samples: less than 1", "function_call cannot use parser none"],
    ["$.dataset: path is missing"],
    ["missing evaluation", "$: evaluation is missing"],
    ["$: not of type object"],
    ["not JSON"],
    ["$.prompt.few_shot[1].input: not of type string"],
]


def _documents(spark, d):
    k = F.col("p_partkey").cast("string")
    forms = []
    for form in _DOCS:
        parts = form.format(k="\0").split("\0")
        forms.append(F.concat(*[x for i, p in enumerate(parts) for x in ([k] if i else []) + [F.lit(p)]]))
    return table(spark, d, "part").select("p_partkey", F.get(F.array(*forms), (F.col("p_partkey") % len(_DOCS)).cast("int")).alias("doc"))


@query(f"select p_partkey, case p_partkey % {len(_DOCS)} {' '.join(f'when {i} then {_q('; '.join(e))}' for i, e in enumerate(_FOUND))} end as errors from part")
def config_documents(spark, d):
    """Configuration documents: missing fields, the one schema error that says most, and parsers and metrics that a task type doesn't allow."""
    return config.validate_documents(_documents(spark, d), "doc").select("p_partkey", F.array_join("errors", "; ").alias("errors"))


_PART_SCHEMA = {
    "type": "object",
    "required": ["size", "tags"],
    "additionalProperties": False,
    "properties": {"size": {"allOf": [{"type": "integer"}, {"minimum": 1, "exclusiveMaximum": 40}]}, "brand": {"type": "string", "pattern": "#[1-4]"}, "tags": {"type": "array", "maxItems": 2, "uniqueItems": True, "items": {"$ref": "#/definitions/tag"}}},
    "definitions": {"tag": {"anyOf": [{"type": "string", "minLength": 2}, {"const": None}]}},
}


@query("""select p_partkey, case when p_partkey % 5 = 1 then '$: tags is missing' when p_partkey % 5 = 2 then '$: more not expected' when p_size >= 40 then '$.size: not less than 40'
 when not regexp_matches(p_brand, '#[1-4]') then '$.brand: does not match #[1-4]' when p_partkey % 5 = 3 then '$.tags: items that repeat' when p_partkey % 5 = 4 then '$.tags[1]: fits none of the schemas given' end as error from part""")
def schema_of_parts(spark, d):
    """Documents made of parts against a schema with references, choices and limits; of several errors the one that says most."""
    k = F.col("p_partkey") % 5
    tags = F.when(k == 3, '["ab", "ab"]').when(k == 4, '["ab", "c"]').otherwise('["ab", null]')
    more = F.when(k == 1, "").otherwise(F.concat(F.lit(', "tags": '), tags))
    extra = F.when(k == 2, ', "more": 1').otherwise("")
    doc = F.concat(F.lit('{"size": '), F.col("p_size").cast("string"), F.lit(', "brand": "'), "p_brand", F.lit('"'), more, extra, F.lit("}"))
    return table(spark, d, "part").select("p_partkey", schemas.validate(doc, _PART_SCHEMA)["error"].alias("error"))
