"""All queries of the evaluation engine by name, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import choice, code, jsons, refusal, robust, scoring, templates, text
from ..operators import diagnostics, execution, leaderboard, metrics, resume
from ..sources import reports
from ..sources.derived import MODEL_OUTPUTS_SQL as OUT
from ..sources.derived import CODE_OK_SQL, SCORES_SQL, attempts, chat_messages, latency_runs, model_outputs, scores, table
from . import config

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# --- pieces of SQL for other engines, made from the same fixed values


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_T = "upper(raw_output)"
_LETTERS = "('A', 'B', 'C', 'D', 'E')"
_last = lambda p: f"upper(regexp_extract_all({_T}, {_q(p)}, 1)[-1])"
MC = "coalesce(" + ", ".join([f"case when {_last(p)} in {_LETTERS} then {_last(p)} end" for p, _ in choice.PATTERNS] + [rf"case when regexp_matches({_T}, '\b{x}\b') then '{x}' end" for x in reversed(choice.CHOICES)] + [rf"regexp_extract({_T}, '(?s).*([ABCDE])', 1)"]) + ")"
_L = f"lower({_strip('raw_output')})"
_refusals = [(f"regexp_matches({_L}, {_q(p)})", p, v) for p, v in refusal.EMPTY + [x for x in refusal.PATTERNS if x[1] >= 0.7]]
_refusals.append((f"length({_L}) < 20 and regexp_matches({_L}, {_q('|'.join(refusal.KEYWORDS))})", "short_refusal", 0.6))
REFUSAL_PATTERN = "case when raw_output = '' then 'empty_input' " + " ".join(f"when {c} then {_q(p)}" for c, p, _ in _refusals) + " end"
REFUSAL_CONFIDENCE = "case when raw_output = '' then 1.0 " + " ".join(f"when {c} then {v}" for c, _, v in _refusals) + " else 0.0 end"
SCORED = f"(select *, pred = ref as passed, case when pred = ref then 1.0 else 0.0 end as score, ({REFUSAL_PATTERN}) is not null as refusal_detected from (select *, {MC} as pred from {OUT}))"
_HAY = "lower(concat_ws(' ', nullif(error, ''), nullif(parse_error, ''), nullif(raw_output, '')))"
CATEGORY = "case when error <> '' then 'execution_error' when refusal_detected then 'refusal' when parse_error <> '' then 'parsing_error' else 'incorrect_output' end"
_family = {k: f"regexp_matches({_HAY}, {_q('|'.join(f'(?:{p})' for p in ps))})" for k, ps in diagnostics.FAMILIES.items()}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = model_outputs(spark, sf_dir).withColumn("pred", choice.extract(F.col("raw_output")))
    out = out.withColumn("passed", scoring.choice(F.col("pred"), F.col("ref")))
    return out.withColumn("score", F.col("passed").cast("double")).withColumn("refusal_detected", refusal.is_refusal(F.col("raw_output")))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- metrics

_CORE = "round(avg(passed::int), 6) as accuracy, count(*) as total, count(*) filter (passed) as passed, count(*) filter (not passed) as failed"


@query(f"select {_CORE}, round(avg(execution_time), 6) as avg_execution_time from {SCORED}")
def core_metrics(spark, d):
    return rounded(metrics.core(scored(spark, d)), "accuracy", "avg_execution_time")


@query(f"select task, {_CORE}, round(avg(execution_time), 6) as avg_execution_time from {SCORED} group by task")
def core_metrics_by_task(spark, d):
    return rounded(metrics.core(scored(spark, d), "task"), "accuracy", "avg_execution_time")


@query(f"select task, round(avg(passed::int), 6) as accuracy, count(*) as total_samples, count(*) filter (passed) as passed, count(*) filter (not passed) as failed, count(*) filter (refusal_detected) as refusals, count(*) filter (parse_error <> '') as parsing_errors from {SCORED} group by task")
def eval_summary(spark, d):
    return rounded(metrics.summary(scored(spark, d), "task"), "accuracy")


@query(f"select task, count(*) as total, count(*) filter (passed) as passed, count(*) filter (not passed) as failed, round(avg(passed::int), 6) as accuracy from {SCORED} group by rollup (task)")
def overall_rollup(spark, d):
    return rounded(metrics.rollup(scored(spark, d), "task"), "accuracy")


@query(f"select idx, {MC} as letter_found from {OUT}")
def mc_extract(spark, d):
    return model_outputs(spark, d).select("idx", choice.extract(F.col("raw_output")).alias("letter_found"))


@query(f"select idx, case when pred = '' then 0.0 {' '.join(f'when regexp_matches({_T}, {_q(p)}) then {v}' for p, v in choice.PATTERNS)} else 0.3 end::double as confidence from {SCORED}")
def mc_confidence(spark, d):
    return scored(spark, d).select("idx", choice.confidence(F.col("raw_output"), F.col("pred")).alias("confidence"))


_ALT = " union all ".join(f"select idx, {k} as k, unnest(range(len(l))) as i, unnest(l) as x from (select idx, regexp_extract_all({_T}, {_q(p)}, 1) as l from {OUT})" for k, (p, _) in enumerate(choice.PATTERNS))


@query(f"""with found as (select idx, k, i, upper(x) as x, (case k {' '.join(f'when {k} then {v}' for k, (_, v) in enumerate(choice.PATTERNS))} end)::double as v from ({_ALT})),
 firsts as (select idx, x, row_number() over (partition by idx, x order by v desc, k, i) as r, v, k, i from found),
 top as (select idx, x, row_number() over (partition by idx order by v desc, k, i) as r from firsts where r = 1)
 select o.idx, coalesce(string_agg(x, ',' order by r) filter (r <= 3), '') as alternatives from {OUT} o left join top using (idx) group by o.idx""")
def mc_alternatives(spark, d):
    return model_outputs(spark, d).select("idx", F.array_join(choice.alternatives(F.col("raw_output")), ",").alias("alternatives"))


@query(f"select round(avg(passed::int), 6) as accuracy, count(*) as total, count(*) filter (passed) as correct from {SCORED}")
def mc_accuracy(spark, d):
    return rounded(metrics.accuracy(scored(spark, d), choice.normalise(F.col("pred")) == choice.normalise(F.col("ref"))), "accuracy")


@query(f"select ref, round(avg((ref = pred)::int), 6) as accuracy, count(*) as n from {SCORED} group by ref")
def mc_per_choice(spark, d):
    return rounded(metrics.per_choice(scored(spark, d), "ref", "pred"), "accuracy")


@query(f"select ref, pred, count(*) as n from {SCORED} group by ref, pred")
def mc_confusion(spark, d):
    return metrics.confusion(scored(spark, d), "ref", "pred")


@query("select quality as ref, toxic as pred, count(*) as n from labels group by all")
def label_confusion(spark, d):
    return metrics.confusion(table(spark, d, "labels").select(F.col("quality").alias("ref"), F.col("toxic").alias("pred")), "ref", "pred")


@query(f"select pred, count(*) as n from {SCORED} group by pred")
def mc_distribution(spark, d):
    return metrics.distribution(scored(spark, d), "pred")


@query(f"select idx, pred, ref from {SCORED} where pred <> ref")
def mc_errors(spark, d):
    return metrics.choice_errors(scored(spark, d), "ref", "pred").select("idx", "pred", "ref")


_norm = lambda x: rf"trim(regexp_replace(lower({_strip(x)}), '\s+', ' ', 'g'))"
_TURNS = "(select a.conv_id, a.turn, a.text as x, b.text as y from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1)"


def _turns(spark, d):
    c = table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"))
    return c.select("conv_id", "turn", F.col("text").alias("x")).join(nxt, ["conv_id", "turn"])


@query(f"select conv_id, turn, {_norm('x')} = {_norm('y')} as matched, {_norm('x')} as normalised from {_TURNS}")
def exact_match_default(spark, d):
    return _turns(spark, d).select("conv_id", "turn", text.exact_match(F.col("x"), F.col("y")).alias("matched"), text.normalise(F.col("x")).alias("normalised"))


@query(f"select count(*) as total, count(*) filter ({_norm('x')} = {_norm('y')}) as correct, round(avg(({_norm('x')} = {_norm('y')})::int), 6) as accuracy from {_TURNS}")
def exact_match_accuracy(spark, d):
    return rounded(metrics.accuracy(_turns(spark, d), text.exact_match(F.col("x"), F.col("y"))), "accuracy")


@query(r"select conv_id, turn, regexp_replace(text, '\s+', ' ', 'g') as normalised from conversations")
def exact_match_strict(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.normalise(F.col("text"), case=False, trim=False).alias("normalised"))


@query()
def exact_match_normalised(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", text.normalise(F.col("text"), punctuation=True, compatibility=True).alias("normalised"))


# --- refusals


@query(f"select idx, ({REFUSAL_PATTERN}) is not null as is_refusal, {REFUSAL_PATTERN} as pattern_matched, ({REFUSAL_CONFIDENCE})::double as confidence from {OUT}")
def refusal_detect(spark, d):
    return refusal.detected(model_outputs(spark, d), "raw_output", "r").select("idx", "r.*")


@query(f"select category, count(*) filter (refusal_detected) as refusals, count(*) as total from {SCORED} group by category")
def refusal_stats(spark, d):
    return scored(spark, d).groupBy("category").agg(F.count_if("refusal_detected").alias("refusals"), F.count(F.lit(1)).alias("total"))


@query(f"select idx, raw_output from {SCORED} where not refusal_detected")
def non_refusals(spark, d):
    return model_outputs(spark, d).where(~refusal.is_refusal(F.col("raw_output"))).select("idx", "raw_output")


@query(f"select idx, {' + '.join(f'regexp_matches({_L}, {_q(p)})::int' for p, _ in refusal.PATTERNS)} as n_patterns, length(raw_output) as n_chars from {OUT}")
def refusal_all_matches(spark, d):
    return model_outputs(spark, d).select("idx", F.size(refusal.all_matches(F.col("raw_output"))).alias("n_patterns"), F.length("raw_output").cast("long").alias("n_chars"))


# --- JSON and function calls

_J = "raw_output"
_FENCE = _strip(rf"regexp_extract({_J}, '(?s)```(?:json)?\s*(.*?)```', 1)")
_fix = _strip(_J)
for _p, _to in jsons.REPAIRS:
    _to_sql = _to.replace("$1", "\\1").replace("$2", "\\2").replace("$3", "\\3")
    _fix = f"regexp_replace({_fix}, {_q(_p)}, {_q(_to_sql)}, 'g')"
# this engine's own test lets a last comma pass
_strict = lambda x: rf"(json_valid({x}) and not regexp_matches({x}, ',\s*[}}\]]'))"
_valid = lambda x: f"coalesce({_strict(x)}, false)"
_flat = lambda p: f"(list_sort([{{'n': -length(x), 'i': i, 'x': x}} for x, i in regexp_extract_all({_J}, {_q(p)}, 1) if {_strict('x')}])[1]).x"
JSON = rf"coalesce(case when {_valid(_J)} then {_strip(_J)} end, case when contains({_J}, '```') and {_valid(_FENCE)} then {_FENCE} end, {_flat(r'(\[[^\[\]]*\])')}, {_flat(r'(\{[^{}]*\})')}, case when {_valid(_fix)} then {_fix} end, {_J})"


@query(f"select idx, {JSON} as json from {OUT}")
def json_extract(spark, d):
    return jsons.with_json(model_outputs(spark, d), "raw_output", "json").select("idx", "json")


@query(f"select idx, (case when {_valid(_J)} then 1.0 when contains({_J}, '```json') then 0.9 when regexp_matches({_J}, '[{{\\[]') then 0.7 else 0.5 end)::double as confidence from {OUT}")
def json_confidence(spark, d):
    return model_outputs(spark, d).select("idx", jsons.confidence(F.col("raw_output")).alias("confidence"))


@query(f"select idx, {_valid(_J)} as valid from {OUT}")
def json_validity(spark, d):
    return model_outputs(spark, d).select("idx", scoring.json_validity(F.col("raw_output")).alias("valid"))


@query(f"select idx, case when {_valid(_fix)} then {_fix} end as repaired from {OUT}")
def json_repair(spark, d):
    return model_outputs(spark, d).select("idx", jsons.repair(F.col("raw_output")).alias("repaired"))


@query("select event_id, case when (props->>'$.k')::int % 3 = event_id % 3 then 1.0 else 0.0 end::double as score, (props->>'$.k')::int % 3 = event_id % 3 as passed from events")
def func_call_match(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    calls = F.array(F.struct(F.lit("f").alias("name"), F.create_map(F.lit("k"), (F.col("k") % 3).cast("string"), F.lit("extra"), F.lit("1")).alias("args")))
    expected = F.create_map(F.lit("f"), F.create_map(F.lit("k"), F.array((F.col("event_id") % 3).cast("string"))))
    return e.select("event_id", scoring.function_calls(calls, expected).alias("score")).withColumn("passed", F.col("score") > 0)


@query(f"select idx, coalesce(j->>'$.name', case when len(json_keys(j)) = 1 then json_keys(j)[1] end) as name, j->'$.arguments'->>'$.k' as k from (select *, case when {_valid(_J)} and {_J}[1] = '{{' then {_J}::json end as j from {OUT})")
def func_call_parse(spark, d):
    """Null where an output is no call."""
    return model_outputs(spark, d).select("idx", jsons.call_name(F.col("raw_output")).alias("name"), F.get_json_object(jsons.call_arguments(F.col("raw_output")), "$.k").alias("k"))


# --- code

_SEG = "[x for x, i in string_split(raw_output, '```') if i % 2 = 0]"
_TAGGED = "contains(x, chr(10)) and split_part(x, chr(10), 1) <> '' and not contains(split_part(x, chr(10), 1), ' ') and length(split_part(x, chr(10), 1)) < 20"
_BODY = _strip(f"case when {_TAGGED} then substr(x, length(split_part(x, chr(10), 1)) + 2) else x end")
_TAG = f"case when {_TAGGED} then lower({_strip('split_part(x, chr(10), 1)')}) end"
_ALLB = f"[{{'code': {_BODY}, 'lang': {_TAG}}} for x in {_SEG} if {_BODY} <> '']"
_KEEP = f"[b for b in {_ALLB} if b.lang is null or b.lang not in ({', '.join(map(_q, code.DATA_FORMATS))})]"
_BLOCKS = f"(case when len({_KEEP}) > 0 then {_KEEP} else {_ALLB} end)"
_CLEAN = _J
for _p in (r"(?m)^\s*```\w*\s*", r"(?m)\s*```\s*$", r"(?m)^\s*[\"']+", r"(?m)[\"']+\s*$"):
    _CLEAN = f"regexp_replace({_CLEAN}, {_q(_p)}, '', 'g')"
_CLEAN = _strip(_CLEAN)


@query(f"select idx, coalesce({_BLOCKS}[-1].code, {_CLEAN}) as code from {OUT}")
def code_extract_last(spark, d):
    return model_outputs(spark, d).select("idx", code.extract(F.col("raw_output")).alias("code"))


@query(f"select idx, coalesce({_BLOCKS}[1].code, {_CLEAN}) as code from {OUT}")
def code_extract_first(spark, d):
    return model_outputs(spark, d).select("idx", code.extract(F.col("raw_output"), "first_block").alias("code"))


@query(f"select idx, case when len({_BLOCKS}) > 0 then array_to_string([b.code for b in {_BLOCKS}], chr(10) || chr(10)) else {_CLEAN} end as code from {OUT}")
def code_extract_all(spark, d):
    return model_outputs(spark, d).select("idx", code.extract(F.col("raw_output"), "all_blocks").alias("code"))


@query(f"select idx, (case when raw_output = '' then 0.0 when len({_BLOCKS}) > 0 then 0.95 else 0.3 end)::double as confidence from {OUT}")
def code_confidence(spark, d):
    return model_outputs(spark, d).select("idx", code.confidence(F.col("raw_output")).alias("confidence"))


_LANG = "case when regexp_matches(x, '^#!\\s*/usr/bin/env\\s+(\\w+)') then regexp_extract(x, '^#!\\s*/usr/bin/env\\s+(\\w+)', 1) " + " ".join(f"when regexp_matches(x, {_q(p)}) then '{k}'" for k, ps in code.LANGUAGES.items() for p in ps) + " end"


@query(f"select idx, {_LANG} as language from (select idx, coalesce({_BLOCKS}[-1].code, {_CLEAN}) as x from {OUT})")
def detect_language(spark, d):
    rows = model_outputs(spark, d).select("idx", code.extract(F.col("raw_output")).alias("x"))
    return rows.select("idx", code.detect_language(F.col("x")).alias("language"))


@query(f"select idx, {CODE_OK_SQL} as ok from {OUT}")
def syntax_check(spark, d):
    """Null where an output holds no code."""
    rows = model_outputs(spark, d)
    return rows.select("idx", F.when(F.size(code.blocks(F.col("raw_output"))) > 0, code.syntax_ok(code.extract(F.col("raw_output")))).alias("ok"))


_PLAIN = "replace(raw_output, '```', '')"
_COMMENT = """(?s)^((?:[^"'#]|"[^"]*"|'[^']*')*)#.*$"""
BARE = lambda x: rf"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: case when regexp_matches(l, {_q(_COMMENT)}) then regexp_replace(regexp_replace(l, {_q(_COMMENT)}, '\1'), '\s+$', '') else l end), lambda l: regexp_matches(l, '\S')), chr(10))"
_INDENTED = rf"length(list_filter(string_split(regexp_replace(plain, '\n(\S)', chr(10) || chr(1) || '\1', 'g'), chr(10) || chr(1)), lambda s: regexp_matches(s, '(?s)(^|\n)(    |\t).*\S')))"


@query(rf"""select idx, (case when n > 0 then n else {_INDENTED} + length(regexp_extract_all(plain, '(?is)<code>(.*?)</code>')) end)::int as n_blocks, {BARE('plain')} as bare
 from (select *, length(regexp_extract_all(plain, '(def\s+\w+\s*\([^)]*\)\s*:(?:\n(?:    |\t).+)+)')) as n from (select idx, {_PLAIN} as plain from {OUT}))""")
def unfenced_code(spark, d):
    rows = model_outputs(spark, d).withColumn("plain", F.replace("raw_output", F.lit("```"), F.lit("")))
    return rows.select("idx", F.size(code.unfenced(F.col("plain"))).alias("n_blocks"), code.strip_comments(F.col("plain")).alias("bare"))


@query(f"""select idx, case when refusal_detected then 'refusal_fallback' when code_conf >= 0.5 then 'code' when mc_conf >= 0.5 then 'mc' else 'json' end as parser_used,
 case when refusal_detected then {_strip('raw_output')} when code_conf >= 0.5 then code when mc_conf >= 0.5 then pred else json end as content
 from (select *, (case when raw_output = '' then 0.0 when len({_BLOCKS}) > 0 then 0.95 else 0.3 end) as code_conf, coalesce({_BLOCKS}[-1].code, {_CLEAN}) as code, {JSON} as json,
 case when pred = '' then 0.0 {' '.join(f'when regexp_matches({_T}, {_q(p)}) then {v}' for p, v in choice.PATTERNS)} else 0.3 end as mc_conf from {SCORED})""")
def robust_parse(spark, d):
    return robust.parsed(model_outputs(spark, d), "raw_output").select("idx", "parser_used", "content")


@query(f"""select idx, case when ok is not null then ok and event_id % 3 <> 0 end as is_safe, case when not ok then 'Syntax error' when ok and event_id % 3 = 0 then 'Blocked import: os' when ok then '' end as violations
 from (select *, {CODE_OK_SQL} as ok from {OUT})""")
def safety_check(spark, d):
    """Null where an output holds no code."""
    text = F.concat(F.when(F.col("event_id") % 3 == 0, "import os\n").otherwise(""), code.extract(F.col("raw_output")))
    rows = model_outputs(spark, d).select("idx", text.alias("code"), (F.size(code.blocks(F.col("raw_output"))) > 0).alias("held"))
    checked = execution.safety_check(rows, "code").withColumn("safety", F.when(F.col("held"), F.col("safety")))
    kind = F.transform("safety.violations", lambda v: F.when(v.startswith("Syntax error"), "Syntax error").otherwise(v))
    return checked.select("idx", "safety.is_safe", F.array_join(kind, "; ").alias("violations"))


@query("""select n_nationkey, n_nationkey % 5 in (0, 3) as success, case n_nationkey % 5 when 0 then (n_nationkey * 2)::varchar || chr(10) when 3 then repeat('x', 50) || chr(10) when 1 then 'before' || chr(10) else '' end as output,
 case n_nationkey % 5 when 0 then 0 when 3 then 0 else 1 end as return_code, false as timed_out from nation""")
def sandbox_exec(spark, d):
    """Output, an error after output, a blocked function under another name, a class, and a blocked import."""
    n = F.col("n_nationkey").cast("string")
    forms = [F.concat(F.lit("print("), n, F.lit(" * 2)")), F.lit("print('before')\n1 / 0"), F.lit("e = eval\nprint(e('1'))"), F.lit("class A:\n    def f(self):\n        return 'x' * 50\nprint(A().f())"), F.lit("import os\nprint(1)")]
    rows = table(spark, d, "nation").select("n_nationkey", F.get(F.array(*forms), (F.col("n_nationkey") % 5).cast("int")).alias("code"))
    return execution.sandbox(rows, "code").select("n_nationkey", "success", "output", "return_code", "timed_out")


# --- prompts and templates


@query("select p_partkey, concat('Context: ', p_name, chr(10), chr(10), 'Which ending makes the most sense?', chr(10), 'A. ', p_brand, chr(10), 'B. ', p_type, chr(10), 'C. ', p_size::varchar, chr(10), 'D. N/A') as prompt from part")
def prompt_mc_render(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", templates.choice_prompt(F.col("p_name"), F.array("p_brand", "p_type", F.col("p_size").cast("string"))).alias("prompt"))


@query("select item_id, concat('Complete:', chr(10), text, chr(10)) as prompt from benchmark")
def prompt_template_render(spark, d):
    return table(spark, d, "benchmark").select("item_id", templates.render("Complete:\n{prompt}\n", F.col("text")).alias("prompt"))


def _chat_sql(name: str) -> str:
    forms = {r: f.replace("{content}", "\x00").split("\x00") for r, f in templates.TEMPLATES[name].items()}
    lit = lambda s: _q(s).replace("\n", "' || chr(10) || '")
    fill = lambda r, c: f"({lit(forms[r][0])} || {c} || {lit(forms[r][1])})"
    return f"""select conv_id, (case when s <> '' then {fill('system', 's')} else '' end) || coalesce(t, '') || {lit(forms['assistant'][0])} as prompt from (select conv_id,
 coalesce(string_agg(text, chr(10) || chr(10) order by turn) filter (role = 'system'), '') as s,
 string_agg(case when role = 'user' then {fill('user', 'text')} else {fill('assistant', 'text')} end, '' order by turn) filter (role in ('user', 'assistant')) as t from conversations group by conv_id)"""


@query(_chat_sql("chatml"))
def chat_template_chatml(spark, d):
    return chat_messages(spark, d).select("conv_id", templates.chat(F.col("messages"), "chatml").alias("prompt"))


@query(_chat_sql("llama-2"))
def chat_template_llama(spark, d):
    return chat_messages(spark, d).select("conv_id", templates.chat(F.col("messages"), "llama-2").alias("prompt"))


_NAMES = "concat((['Llama-3-8B-Instruct','llama2-7b-chat','Qwen2-7B','qwen-1','gemma-2-9b','Gemma','Phi-3-mini','phi-2','mistralai/Mixtral-8x7B','other'])[(s_suppkey % 10 + 1)::int], '-', s_suppkey::varchar)"


@query(f"select s_suppkey, case {' '.join(f'when regexp_matches(lower({_NAMES}), {_q(p)}) then {_q(t)}' for p, t in templates.FAMILIES)} else 'default' end as template from supplier")
def template_detect(spark, d):
    names = F.array(*map(F.lit, ["Llama-3-8B-Instruct", "llama2-7b-chat", "Qwen2-7B", "qwen-1", "gemma-2-9b", "Gemma", "Phi-3-mini", "phi-2", "mistralai/Mixtral-8x7B", "other"]))
    name = F.concat(F.get(names, (F.col("s_suppkey") % 10).cast("int")), F.lit("-"), F.col("s_suppkey").cast("string"))
    return table(spark, d, "supplier").select("s_suppkey", templates.detect(name).alias("template"))


@query("select conv_id, turn, (length(text) // 4)::bigint as tokens from conversations")
def token_estimate(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.token_estimate(F.col("text")).alias("tokens"))


# --- pass@k

_ATT = "(select l_orderkey as problem_id, l_returnflag = 'A' as passed from lineitem)"
_PASS = "round(case when c = 0 or n = 0 then 0.0 when c = n then 1.0 when n <= 100 then case when k > n - c then 1.0 else 1 - exp(lgamma(n - c + 1) - lgamma(n - c - k + 1) - lgamma(n + 1) + lgamma(n - k + 1)) end else 1 - pow(1 - c / n::double, k) end, 6)"


@query(f"select n, c, k, {_PASS} as pass_at_k from (select count(*) as n, count(*) filter (passed) as c from {_ATT}), (values (1), (10), (100)) as v(k)")
def pass_at_k_multi(spark, d):
    return rounded(metrics.pass_at_k(attempts(spark, d)), "pass_at_k")


@query(f"select round(avg(p), 6) as pass_at_k, count(*) as total, sum(p)::bigint as correct from (select max(passed::int) as p from {_ATT} group by problem_id)")
def pass_at_k_grouped(spark, d):
    return rounded(metrics.pass_any(attempts(spark, d), "problem_id"), "pass_at_k")


@query(f"select k, round(avg({_PASS}), 4) as pass_at_k, count(*) as total from (select problem_id, count(*) as n, count(*) filter (passed) as c from {_ATT} group by 1), (values (1), (2), (5)) as v(k) group by k")
def pass_at_k(spark, d):
    return metrics.pass_at_k_by(attempts(spark, d), "problem_id", (1, 2, 5)).withColumn("pass_at_k", F.round("pass_at_k", 4))


@query(f"select problem_id, round(1 - pow(1 - c / n::double, 2), 6) as estimate from (select problem_id, count(*) as n, count(*) filter (passed) as c from {_ATT} group by 1)")
def pass_at_k_estimate(spark, d):
    g = attempts(spark, d).groupBy("problem_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("c"))
    return g.select("problem_id", F.round(scoring.pass_at_k_estimate(F.col("n"), F.col("c"), F.lit(2)), 6).alias("estimate"))


# --- diagnostics


@query(" union all ".join(f"select '{k}' as pattern, count(*) as n from {SCORED} where not passed and {c} having count(*) > 0" for k, c in _family.items()))
def error_patterns(spark, d):
    return diagnostics.patterns(scored(spark, d))


@query(f"select {CATEGORY} as category, count(*) as n from {SCORED} where not passed group by 1")
def error_categories(spark, d):
    return diagnostics.categories(scored(spark, d))


@query(f"select count(*) as total, count(*) filter (passed) as passed, count(*) filter (not passed) as failed, round(avg(passed::int), 6) as pass_rate, {', '.join(f'''count(*) filter (not passed and {CATEGORY} = '{k}') as {k}''' for k in ('execution_error', 'refusal', 'parsing_error', 'incorrect_output'))} from {SCORED}")
def error_summary(spark, d):
    return rounded(diagnostics.summary(scored(spark, d)), "pass_rate")


@query(f"select idx, error, parse_error from {OUT} where error <> '' or parse_error <> ''")
def rows_with_errors(spark, d):
    return diagnostics.with_errors(model_outputs(spark, d)).select("idx", "error", "parse_error")


@query(f"""with last as (select sample_id, max_by(passed, idx) as passed from {SCORED} group by 1), members as (select distinct 'm' || (c_nationkey % 4)::varchar as category, 's' || (c_custkey % 7000)::varchar as sample_id from customer)
 select category, count(*) as total, count(*) filter (passed) as passed, count(*) filter (not passed) as failed, round(avg(passed::int), 6) as accuracy from members join last using (sample_id) group by category""")
def category_performance(spark, d):
    members = table(spark, d, "customer").select(F.concat(F.lit("m"), (F.col("c_nationkey") % 4).cast("string")).alias("category"), F.concat(F.lit("s"), (F.col("c_custkey") % 7000).cast("string")).alias("sample_id")).distinct()
    return rounded(diagnostics.category_performance(scored(spark, d), members), "accuracy")


_COUNTS = f"(select coalesce(avg(passed::int), 0) as rate, {', '.join(f'count(*) filter (not passed and {_family[k]}) as {k}' for k in ('syntax_error', 'timeout', 'refusal'))}, count(*) filter (not passed and {CATEGORY} = 'parsing_error') as parsing_error from {SCORED})"
_first = "case " + " ".join(f"when rate < {v} then {_q(a)}" for v, a in diagnostics.ADVICE[:-1]) + f" else {_q(diagnostics.ADVICE[-1][1])} end"
_lines = ", ".join([_first, *[f"case when {k} > 0 then concat({_q(a)}, {k}::varchar, {_q(b)}) end" for k, (a, b) in diagnostics.ERROR_ADVICE.items()]])


@query(f"select unnest(range(len(l)))::int as position, unnest(l) as recommendation from (select [x for x in [{_lines}] if x is not null] as l from {_COUNTS})")
def recommendations(spark, d):
    return diagnostics.recommendations(scored(spark, d))


@query(f"select count(*) filter (finish_reason = 'length') as truncated, count(*) filter (pred = '') as empty_predictions, count(*) as total from {SCORED}")
def generation_counters(spark, d):
    return metrics.counters(scored(spark, d))


# --- latency and memory

_RUNS = "(select event_type as prompt, event_id as run, value as ttft_ms, 1000 / (1 + value) as throughput, event_id % 257 as tokens from events)"
_STATS = ", ".join(f"round(avg({c}), 4) as {c}_mean, round(coalesce(stddev_samp({c}), 0), 4) as {c}_std, round(min({c}), 4) as {c}_min, round(max({c}), 4) as {c}_max" for c in ("ttft_ms", "throughput"))
_NAMES4 = [f"{c}_{s}" for c in ("ttft_ms", "throughput") for s in ("mean", "std", "min", "max")]


def _round4(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.round(n, 4) for n in names})


@query(f"select prompt, {_STATS}, sum(tokens)::bigint as tokens_total, count(*) as runs from {_RUNS} group by rollup (prompt)")
def latency_rollup(spark, d):
    return _round4(metrics.latency(latency_runs(spark, d), "prompt"), _NAMES4)


@query(f"select {_STATS}, sum(tokens)::bigint as tokens_total, count(*) as runs from {_RUNS}")
def latency_overall(spark, d):
    return _round4(metrics.latency(latency_runs(spark, d)), _NAMES4)


@query(f"select prompt, round(avg(ttft_ms), 4) as ttft_mean, round(coalesce(stddev_samp(ttft_ms), 0), 4) as ttft_std, round(avg(throughput), 4) as throughput_mean, round(coalesce(stddev_samp(throughput), 0), 4) as throughput_std, round(avg(tokens), 4) as tokens_mean from {_RUNS} group by prompt")
def latency_per_prompt(spark, d):
    return _round4(metrics.latency_per_prompt(latency_runs(spark, d), "prompt"), ["ttft_mean", "ttft_std", "throughput_mean", "throughput_std", "tokens_mean"])


@query("select event_type, round(greatest(max(value), max(value * 0.9)), 6) as peak_ram_gb, round(greatest(max(value), max(value * 0.9)) - min(value), 6) as ram_usage_gb from events group by event_type")
def peak_ram(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("value") * 0.9).alias("post_load_gb"), F.col("value").alias("rss_gb"), F.col("value").alias("initial_gb"))
    return rounded(metrics.peak_memory(e, "event_type"), "peak_ram_gb", "ram_usage_gb")


@query("select (4096 * pow(2, user_id % 4))::bigint as n_ctx, max(value) as ram_gb from events group by 1")
def context_scaling(spark, d):
    e = table(spark, d, "events").withColumn("n_ctx", (4096 * F.pow(F.lit(2), F.col("user_id") % 4)).cast("long"))
    return metrics.memory_by_context(e, "n_ctx", "value")


# --- leaderboards

_AVG = "coalesce(round(avg(case when accuracy > 0 then accuracy * 100 end), 2), 0.0)"
_WIDE = f"(select model, pos, quantization, ttft_ms, throughput, peak_ram_gb, {', '.join(f'''coalesce(round(max(case when benchmark = '{b}' then accuracy * 100 end), 2), 0.0) as {b}''' for b in leaderboard.BENCHMARKS)}, {_AVG} as avg_accuracy from {SCORES_SQL} group by all)"


def _wide(spark, d):
    return leaderboard.wide(scores(spark, d), "model", "pos", "quantization", "ttft_ms", "throughput", "peak_ram_gb")


@query(f"select model, {_AVG} as avg_accuracy from {SCORES_SQL} group by model")
def leaderboard_avg(spark, d):
    return leaderboard.averages(scores(spark, d), "model")


@query(f"select * from {_WIDE}")
def leaderboard_pivot(spark, d):
    return _wide(spark, d)


@query(f"select model, avg_accuracy, rank::int as rank, case rank when 1 then 'gold' when 2 then 'silver' when 3 then 'bronze' end as medal, case when avg_accuracy >= 70 then 'high' when avg_accuracy >= 50 then 'medium' else 'low' end as class from (select *, row_number() over (order by avg_accuracy desc, model) as rank from {_WIDE})")
def leaderboard_rank(spark, d):
    return leaderboard.ranked(_wide(spark, d)).select("model", "avg_accuracy", "rank", "medal", leaderboard.score_class(F.col("avg_accuracy")).alias("class"))


@query(f"select model, quantization, (row_number() over (order by case quantization when 'BF16' then 0 when 'Q8_0' then 1 else 2 end, pos))::int as display_rank from {_WIDE}")
def display_rank(spark, d):
    return leaderboard.display_rank(_wide(spark, d)).select("model", "quantization", "display_rank")


@query(f"select model, round(2 * avg_accuracy + throughput - ttft_ms / 30 - peak_ram_gb / 4 + 2.2 * humaneval + 2 * throughput - ttft_ms / 15, 6) as score from {_WIDE} order by score desc, pos limit 3")
def recommend_topk(spark, d):
    return leaderboard.recommend(_wide(spark, d), "humaneval", speed=True).select("model", "score")


_VARIANT = "(select p_brand as family, case p_size % 3 when 0 then 'BF16' when 1 then 'Q8_0' else 'Q4_K_M' end as quantization, p_retailprice as size_gb, p_size + 1 as speed from part)"


@query(f"""with v as (select family, quantization, avg(speed) as s, avg(size_gb) as g from {_VARIANT} group by 1, 2)
 select a.family, a.quantization, round(a.s / b.s, 6) as speedup, round(1 - a.g / b.g, 6) as size_saving from v a join v b on a.family = b.family and b.quantization = 'BF16' where a.quantization <> 'BF16'""")
def quant_vs_baseline(spark, d):
    quant = F.get(F.array(F.lit("BF16"), F.lit("Q8_0"), F.lit("Q4_K_M")), F.col("p_size") % 3)
    p = table(spark, d, "part").select(F.col("p_brand").alias("family"), quant.alias("quantization"), F.col("p_retailprice").alias("size_gb"), (F.col("p_size") + 1).alias("speed"))
    return leaderboard.against_baseline(p, "family", "quantization", "size_gb", "speed", "BF16")


@query("select s_suppkey, s_name, case when s_suppkey % 3 = 0 then s_suppkey::double else s_acctbal end as s_acctbal from supplier")
def leaderboard_upsert(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = s.where("s_suppkey % 3 = 0").select("s_suppkey", F.col("s_suppkey").cast("double").alias("s_acctbal"))
    return leaderboard.upsert(s, new, "s_suppkey", ["s_acctbal"])


@query("select s_suppkey, case when s_suppkey < 3 then 'replaced' else s_name end as s_name from supplier")
def replace_models(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return leaderboard.replace(s, s.where("s_suppkey < 3").withColumn("s_name", F.lit("replaced")), "s_suppkey")


@query(f"select model, benchmark, printf('%.2f%%', accuracy * 100) as accuracy_text, case when accuracy >= 0.8 then 'good' when accuracy >= 0.5 then 'fair' else 'poor' end as status from {SCORES_SQL}")
def leaderboard_detail(spark, d):
    return leaderboard.detail(scores(spark, d))


# --- resuming, combining, sampling


@query("select o_orderkey from orders where o_orderkey not in (select event_id from events where event_type = 'purchase')")
def resume_anti_join(spark, d):
    done = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("o_orderkey"))
    return resume.remaining(table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query("select event_id, event_type from events")
def resume_union(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    first = e.where("event_id < 1000")
    return resume.combine(first, resume.remaining(e, first, "event_id"))


@query(f"select idx, task, (sum(passed::int) over w)::bigint as passed_so_far, (sum((not passed)::int) over w)::bigint as failed_so_far from {SCORED} window w as (partition by task order by idx)")
def running_pass_counts(spark, d):
    return metrics.running_counts(scored(spark, d), "task", "idx").select("idx", "task", "passed_so_far", "failed_so_far")


@query("select user_id, max(event_id) as event_id, max_by(event_type, event_id) as event_type from events group by user_id")
def last_wins_dedupe(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return resume.last_wins(e, "user_id", "event_id")


@query("select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) <= 5")
def retention_top_n(spark, d):
    return resume.newest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", 5, "o_orderkey").select("o_custkey", "o_orderkey")


@query("select d.doc_id, d.lang, coalesce(l.quality, -1) as quality from documents d left join labels l using (doc_id)")
def question_answer_left_join(spark, d):
    q, a = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality")
    return resume.left_with_default(q, a, "doc_id", "quality", -1, "quality")


@query("select doc_id, lang from documents where length(text) > 100 order by doc_id limit 25")
def first_n_samples(spark, d):
    return resume.first_samples(table(spark, d, "documents").where("length(text) > 100").select("doc_id", "lang"), "doc_id", 25)


@query(f"select task, {', '.join(f'''coalesce(printf('%.4f', avg(passed::int) filter (category = '{c}')), 'N/A') as {c}''' for c in ('click', 'purchase', 'refund'))} from {SCORED} group by task")
def metric_union_columns(spark, d):
    rows = scored(spark, d).groupBy("task", "category").agg(F.avg(F.col("passed").cast("int")).alias("accuracy"))
    return metrics.wide(rows, "task", "category", "accuracy", ["click", "purchase", "refund"])


_TYPES, _METRICS, _PARSERS = [*config.RULES, "other"], ["pass_at_k", "exact_match", "multiple_choice", "json_validity"], ["code", "mc", "json", "robust"]
_at = lambda names, n: f"([{', '.join(map(_q, names))}])[(p_partkey // {n} % {len(names)} + 1)::int]"
_N_ERRORS = " + ".join(["(p_partkey % 11 = 0)::int", "(task_type = 'other')::int"] + [f"(task_type = '{k}' and {c} not in ({', '.join(map(_q, v))}))::int" for k, (ps, ms) in config.RULES.items() for c, v in (("parser", ps), ("metric", ms)) if v])


@query(f"select p_partkey, {_N_ERRORS} as n_errors from (select p_partkey, {_at(_TYPES, 1)} as task_type, {_at(_METRICS, 5)} as metric, {_at(_PARSERS, 20)} as parser from part)")
def config_cross_validation(spark, d):
    """Each task type with each metric and parser, and paths that are missing."""
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (F.floor(F.col("p_partkey") / n) % len(names)).cast("int"))
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), pick(_TYPES, 1).alias("task_type"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_brand")).alias("dataset_path"), pick(_METRICS, 5).alias("metric"), pick(_PARSERS, 20).alias("parser"))
    return config.validate(rows).select("p_partkey", F.size("errors").alias("n_errors"))


@query(r"select page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) as title from pages")
def page_titles(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.coalesce(text.extract_between(F.col("html"), "<title>", "</title>"), F.lit("")).alias("title"))


# --- further scalars and projections


@query(rf"""select idx, pred, {_strip("case when pred = '' then raw_output else " + "regexp_replace(" * 6 + "raw_output" + "".join(f", concat({_q('(?i)' + a)}, pred, {_q(b)}), '', 'g')" for a, b in ((r'\banswer\s*[:=]\s*', ''), (r'\bthe answer is\s*[:=]?\s*', ''), (r'\*\*', r'\*\*'), ('`', '`'), (r'\[', r'\]'), (r'\(', r'\)'))) + " end")} as reasoning from {SCORED}""")
def mc_reasoning(spark, d):
    return scored(spark, d).select("idx", "pred", choice.reasoning(F.col("raw_output"), F.col("pred")).alias("reasoning"))


@query(f"select idx, upper(left(trim(raw_output), 1)) in ('A', 'B', 'C', 'D') and upper(left(trim(raw_output), 1)) = ref as matched from {OUT}")
def first_letter_match(spark, d):
    return model_outputs(spark, d).select("idx", scoring.first_letter(F.col("raw_output"), F.col("ref")).alias("matched"))


_MESSAGE = "concat('I have ', (event_id % 64)::varchar, ' cores and ', (event_id % 128)::varchar, case when event_id % 3 = 0 then ' GB RAM' else ' disks' end, case when event_id % 2 = 0 then ', need FAST code' else ', need logic' end)"


@query(rf"""select event_id, try_cast(regexp_extract(lower(m), '(\d+)\s*(?:cpu|core|vcpu|processor)', 1) as int) as cpu, try_cast(nullif(regexp_extract(lower(m), '(\d+)\s*(?:gb|gigabytes?)\s*(?:ram|memory)', 1), '') as int) as ram,
 {', '.join(f"({' or '.join(f'contains(lower(m), {_q(w)})' for w in ws)}) as wants_{k}" for k, ws in text.INTENTS.items())} from (select event_id, {_MESSAGE} as m from events)""")
def message_intents(spark, d):
    e = table(spark, d, "events").select("event_id", F.expr(_MESSAGE.replace("::varchar", "").replace("(event_id % 64)", "cast(event_id % 64 as string)").replace("(event_id % 128)", "cast(event_id % 128 as string)")).alias("m"))
    wants = [c.alias(f"wants_{k}") for k, c in text.intents(F.col("m")).items()]
    return e.select("event_id", text.hardware(F.col("m")).alias("h"), *wants).select("event_id", "h.cpu", "h.ram", *[f"wants_{k}" for k in text.INTENTS])


_MODEL = "concat((['qwen36_27b_', 'qwen3.6-35b-a3b-', 'qwen3.5-35b-a3b-', 'gemma4-26b-a4b-', 'other/x-'])[(s_suppkey % 5 + 1)::int], (['bf16', 'q8', 'q4', ''])[(s_suppkey % 4 + 1)::int])"


@query(rf"""with m as (select s_suppkey, {_MODEL} as name from supplier), q as (select *, case when contains(name, 'bf16') then 'BF16' when contains(name, 'q8') then 'Q8_0' else 'Q4_K_M' end as quantization from m)
 select s_suppkey, quantization, case {' '.join(f"when contains(name, {_q(a)}) then concat({_q(b + ' (')}, quantization, ')')" for a, b in leaderboard.DISPLAY)} else name end as display_name, regexp_replace(name, '[^\p{{L}}\p{{N}}_-]', '_', 'g') as file_name from q""")
def model_names(spark, d):
    family = F.array(*map(F.lit, ["qwen36_27b_", "qwen3.6-35b-a3b-", "qwen3.5-35b-a3b-", "gemma4-26b-a4b-", "other/x-"]))
    kind = F.array(*map(F.lit, ["bf16", "q8", "q4", ""]))
    name = F.concat(F.get(family, (F.col("s_suppkey") % 5).cast("int")), F.get(kind, (F.col("s_suppkey") % 4).cast("int")))
    m = table(spark, d, "supplier").select("s_suppkey", name.alias("name"))
    return m.select("s_suppkey", leaderboard.quantization(F.col("name")).alias("quantization"), leaderboard.display_name(F.col("name")).alias("display_name"), text.safe_name(F.col("name")).alias("file_name"))


@query("select s_suppkey, s_nationkey::varchar as nation, 'true' as verbose from supplier")
def key_value_arguments(spark, d):
    s = table(spark, d, "supplier").withColumn("m", text.key_values(F.concat(F.lit("nation="), F.col("s_nationkey").cast("string"), F.lit(",verbose"))))
    return s.select("s_suppkey", F.col("m")["nation"].alias("nation"), F.col("m")["verbose"].alias("verbose"))


@query("select event_id, event_id % 3 <> 2 and (event_id % 3 <> 1 or event_id % 2 = 0) as valid from events")
def func_call_validate(spark, d):
    """A call is of an unknown function where event_id % 3 is 2, and of a wrong type where it is 1 and event_id is odd."""
    name = F.when(F.col("event_id") % 3 == 2, "g").otherwise("f")
    value = F.when((F.col("event_id") % 3 == 1) & (F.col("event_id") % 2 == 1), '"x"').otherwise(F.col("event_id").cast("string"))
    known = F.array(F.struct(F.lit("f").alias("name"), F.array(F.lit("k")).alias("required"), F.create_map(F.lit("k"), F.lit("integer")).alias("types")))
    return table(spark, d, "events").select("event_id", scoring.call_is_valid(name, F.create_map(F.lit("k"), value), known).alias("valid"))


@query(r"""select conv_id, coalesce(string_agg(role || ': ' || t, chr(10) order by turn, role, text) filter (role in ('user', 'assistant') and t <> ''), '') as history
 from (select *, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') as t, row_number() over (partition by conv_id order by turn desc, role desc, text desc) as r from conversations) where r <= 8 group by conv_id""")
def chat_history(spark, d):
    """The last entries of a conversation, and of those the turns with a text: the cut comes before the filter."""
    kept = templates.history(F.col("messages"))
    return chat_messages(spark, d).select("conv_id", F.array_join(F.transform(kept, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("history"))


@query(f"select sum(pos)::bigint as total_samples_evaluated, count(distinct model) as models_compared from {SCORES_SQL}")
def leaderboard_totals(spark, d):
    return leaderboard.totals(scores(spark, d).withColumn("samples", F.col("pos")))


@query(f"select category as error_category, count(*) as n from (select {CATEGORY} as category from {SCORED} where not passed) group by 1 order by n desc, 1 limit 3")
def top_error_categories(spark, d):
    return diagnostics.top_categories(scored(spark, d), 3).withColumnRenamed("category", "error_category")


@query("select s_nationkey, min_by(s_name, (case s_suppkey % 3 when 0 then 0 when 1 then 1 else 2 end) * 1000000 + s_acctbal) as file from supplier group by s_nationkey")
def preferred_file(spark, d):
    """One file for each model: by order of preference, then the smallest."""
    rank = F.when(F.col("s_suppkey") % 3 == 0, 0).when(F.col("s_suppkey") % 3 == 1, 1).otherwise(2)
    return execution.preferred(table(spark, d, "supplier"), "s_nationkey", "s_name", rank, F.col("s_acctbal")).withColumnRenamed("s_name", "file")


@query(f"select task as task_name, category as model_name, count(*) as completed, max(idx)::varchar as timestamp from {OUT} group by 1, 2")
def checkpoint_progress(spark, d):
    rows = model_outputs(spark, d).select(F.col("task").alias("task_name"), F.col("category").alias("model_name"), "idx")
    return resume.completed(rows, "task_name", "model_name", order="idx").withColumn("timestamp", F.col("timestamp").cast("string"))


@query(f"""select idx, {MC} as mc, coalesce({_BLOCKS}[-1].code, {_CLEAN}) as code, {JSON} as json from {OUT}""")
def parse_all(spark, d):
    """Every parser's own answer side by side."""
    found = robust.attempts(F.col("raw_output"))
    return model_outputs(spark, d).select("idx", *[r["content"].alias(k) for k, r in found.items()])


@query(rf"select conv_id, turn, length({_strip('text')}) as n, left(lower({_strip('text')}), 20) as head from conversations")
def text_preprocess(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.length(text.preprocess(F.col("text"))).cast("long").alias("n"), text.preprocess(F.col("text"), lower=True, limit=20).alias("head"))


@query("select event_id, round(case when value > 0 then (event_id % 257) / value else 0 end, 6) as tokens_per_second, round(value * 1e9 / 1073741824, 6) as gb from events")
def throughput_and_memory(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.round(scoring.throughput(F.col("event_id") % 257, F.col("value")), 6).alias("tokens_per_second"), F.round(scoring.gigabytes(F.col("value") * 1e9), 6).alias("gb"))


@query(f"select to_json({{'sample_id': sample_id, 'passed': passed, 'score': score::double, 'execution_time': execution_time, 'error': error}})::varchar as json from {SCORED}")
def diagnostic_json(spark, d):
    """Results as the lines of a diagnostic report's JSON."""
    return reports.diagnostics_json(scored(spark, d))


@query("select s_suppkey, s_name from supplier where s_suppkey not in (select c_custkey from customer where c_custkey % 2 = 0)")
def upsert_skipped(spark, d):
    board = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("s_suppkey"))
    return leaderboard.skipped(board, table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey")


from . import documents, evaluation, parts, runs  # noqa: E402, F401  their queries register themselves above
