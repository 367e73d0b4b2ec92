"""Queries of single parts: loaders, scripts, backends, options of checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import choice, code, refusal, scoring, templates
from ..operators import evaluate, execution, metrics
from ..sources import benchmarks
from ..sources.derived import MODEL_OUTPUTS_SQL as OUT
from ..sources.derived import model_outputs, spread, table
from .catalog import BARE, SCORED, _L, _q, _strip, query, rounded, scored


@query(f"select idx, pred, ref from {SCORED}")
def positional_pairs(spark, d):
    """Predictions beside references by position, both of the same number."""
    rows = scored(spark, d)
    return metrics.positional(rows.select("idx", "pred"), rows.select("idx", "ref"), "idx").select("idx", "pred", "ref")


@query(f"select round(avg((pred = ref)::int), 6) as accuracy, count(*) as total, count(*) filter (pred = ref) as correct from {SCORED}")
def quick_accuracy(spark, d):
    return rounded(evaluate.quick_choice_accuracy(model_outputs(spark, d).select("raw_output", "ref"), "raw_output", "ref"), "accuracy")


@query(f"select event_id, upper(trim(substr('aB eZ', (event_id % 6 + 1)::int, 1))) in ({', '.join(map(_q, choice.CHOICES))}) as ok from events")
def choice_is_valid(spark, d):
    letter = F.substring(F.lit("aB eZ"), (F.col("event_id") % 6 + 1).cast("int"), F.lit(1))
    return table(spark, d, "events").select("event_id", choice.is_valid(letter).alias("ok"))


@query(f"select idx, {_strip(BARE(_strip('raw_output')))} as code from {OUT}")
def code_post_process(spark, d):
    """Texts without comments, null or not."""
    return model_outputs(spark, d).select("idx", code.post_process(F.col("raw_output"), without_comments=True).alias("code"))


@query(f"select idx, pred is not distinct from nullif(ref, 'A') as same from {SCORED}")
def strict_equality(spark, d):
    """A missing reference equals a missing prediction only."""
    return scored(spark, d).select("idx", scoring.equal(F.col("pred"), F.nullif("ref", F.lit("A"))).alias("same"))


_FORMS = ["import os", "import math", "from socket import x\nimport json", "eval('1')", "x = 1"]


@query("select event_id, event_id % 5 in (0, 4) as is_safe, ([NULL, 'Blocked import: math', 'Blocked import: socket', 'Blocked function: eval', NULL])[(event_id % 5 + 1)::int] as violation from events")
def safety_options(spark, d):
    """A module blocked besides, and one allowed that is blocked without it."""
    rows = spread(table(spark, d, "events").select("event_id")).withColumn("code", F.get(F.array(*map(F.lit, _FORMS)), (F.col("event_id") % 5).cast("int")))
    out = execution.safety_check(rows, "code", blocked=["math"], allowed=("os",))
    return out.select("event_id", "safety.is_safe", F.get("safety.violations", F.lit(0)).alias("violation"))


_LEFT_OUT = r"^sorry[,\s]"
_RULES = [p for p, _ in refusal.EMPTY] + [p for p, v in refusal.PATTERNS if v >= 0.7 and p != _LEFT_OUT] + ["done"]
_SHORT = f"length({_L}) < 20 and regexp_matches({_L}, {_q('|'.join(refusal.KEYWORDS))})"


@query(f"select idx, case when raw_output = '' then 'empty_input' {' '.join(f'when regexp_matches({_L}, {_q(p)}) then {_q(p)}' for p in _RULES)} when {_SHORT} then 'short_refusal' end as pattern from {OUT}")
def refusal_options(spark, d):
    """A pattern of a user's own after the fixed ones, and one of these left out."""
    rows = refusal.detected(model_outputs(spark, d), "raw_output", "r", custom=[("done", 0.9)], without=(_LEFT_OUT,))
    return rows.select("idx", F.col("r.pattern_matched").alias("pattern"))


@query("""select s_suppkey as idx, case when s_suppkey % 3 = 0 then 'humaneval_' || s_suppkey else 'T/' || s_suppkey end as id, s_name as prompt, case when s_suppkey % 4 = 0 then '' else s_nationkey::varchar end as reference,
 case when s_suppkey % 2 = 0 then '' else 'def check(c): pass' end as test, case when s_suppkey % 7 = 0 then '' else 'f' end as entry_point from supplier where s_suppkey % 5 <> 0""")
def load_code_items(spark, d):
    """Code problems: ids by place, empty texts for what is missing, none without a prompt."""
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(k.alias("idx"), F.when(k % 3 != 0, F.concat(F.lit("T/"), k.cast("string"))).alias("task_id"), F.when(k % 5 != 0, F.col("s_name")).alias("prompt"), F.when(k % 4 != 0, F.col("s_nationkey").cast("string")).alias("canonical_solution"), F.when(k % 2 != 0, F.lit("def check(c): pass")).alias("test"), F.when(k % 7 != 0, F.lit("f")).alias("entry_point"))
    return benchmarks.humaneval(rows)


@query("""select p_partkey as idx, 'hellaswag_' || p_partkey as id, 'Context: ' || case when p_partkey % 3 = 0 then p_brand || ' ' || p_type else p_name end || chr(10) || chr(10) || 'Which ending makes the most sense?' || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type
 || chr(10) || 'C. c' || chr(10) || 'D. ' || case when p_partkey % 2 = 0 then 'N/A' else 'd' end as prompt, substr('ABCD', (p_partkey % 4 + 1)::int, 1) as reference from part""")
def load_choice_items(spark, d):
    """Endings to choose from: contexts whole or in two parts, labels as numbers or letters, a missing ending."""
    k = F.col("p_partkey")
    label = F.when(k % 8 < 4, (k % 4).cast("string")).otherwise(F.lower(F.substring(F.lit("ABCD"), (k % 4 + 1).cast("int"), F.lit(1))))
    endings = F.array("p_brand", "p_type", F.lit("c"))
    rows = table(spark, d, "part").select(k.alias("idx"), F.when(k % 3 != 0, F.col("p_name")).alias("ctx"), F.col("p_brand").alias("ctx_a"), F.col("p_type").alias("ctx_b"), F.when(k % 2 == 0, endings).otherwise(F.concat(endings, F.array(F.lit("d")))).alias("endings"), label.alias("label"), F.lit("").alias("activity_label"))
    return benchmarks.hellaswag(rows).drop("activity_label")


@query("""select p_partkey as idx, case p_partkey % 5 when 4 then '' else 'q ' || p_partkey end as prompt, case p_partkey % 3 when 2 then '' when 1 then 'f' else 'f,unknown' end as names,
 case p_partkey % 3 when 2 then '' when 1 then '{}' else '{"type":"object"},{}' end as parameters from part""")
def load_call_items(spark, d):
    """Questions in each of their shapes, and the functions that they may call."""
    k = F.col("p_partkey")
    said = lambda a, b: F.concat(F.lit(a), F.lit("q "), k.cast("string"), F.lit(b))
    shapes = F.array(said('[[{"role": "user", "content": "', '"}]]'), said('[{"role": "user", "content": "', '"}]'), said('"', '"'), said('["', '"]'), F.lit("[]"))
    functions = F.array(F.lit('[{"name": "f", "parameters": {"type": "object"}}, {"description": "x"}]'), F.lit('{"name": "f"}'), F.lit("7"))
    rows = table(spark, d, "part").select(k.alias("idx"), F.parse_json(F.get(shapes, (k % 5).cast("int"))).alias("q"), F.parse_json(F.get(functions, (k % 3).cast("int"))).alias("f"))
    found = rows.select("idx", benchmarks.bfcl_question(F.col("q")).alias("prompt"), benchmarks.bfcl_functions(F.col("f")).alias("f"))
    return found.select("idx", "prompt", F.array_join("f.name", ",").alias("names"), F.array_join("f.parameters", ",").alias("parameters"))


@query("select n_nationkey as idx, n_name as prompt, n_regionkey::varchar as reference, null::varchar as test from nation")
def map_fields(spark, d):
    """Standard names from a source's own; a field that a source lacks is null."""
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("question"), F.col("n_regionkey").cast("string").alias("reference"))
    return benchmarks.mapped(rows, {"idx": "idx", "prompt": "question", "reference": "answer", "test": "tests"})


@query("select s_suppkey, s_name || chr(10) || chr(10) || case when s_suppkey % 2 = 0 then 'def check(c): pass' || chr(10) || 'check(' || 'f' || ')' || chr(10) else 'assert f' end as script from supplier")
def test_scripts(spark, d):
    """Completions with their tests, which are called where they define check()."""
    tests = F.when(F.col("s_suppkey") % 2 == 0, F.lit("def check(c): pass")).otherwise("assert f")
    return table(spark, d, "supplier").select("s_suppkey", execution.test_script(F.col("s_name"), tests, F.lit("f")).alias("script"))


@query("select event_id, case when event_id % 3 = 0 then '' else event_type end as text, case when event_id % 3 = 0 then 'error' else 'stop' end as finish_reason from events")
def replayed_generations(spark, d):
    """Samples with texts that were generated before; one without is a failure."""
    e = table(spark, d, "events")
    before = e.where("event_id % 3 <> 0").select("event_id", F.col("event_type").alias("text"), F.lit(7).alias("tokens_generated"), F.lit(0.5).alias("generation_time"), F.lit("stop").alias("finish_reason"))
    return execution.replay(before, e.select("event_id"), "event_id").select("event_id", "text", "finish_reason")


def _answers(prompt: str) -> tuple[str, int, str]:
    if prompt.endswith("7"):
        raise OSError("no answer")
    return prompt.upper(), len(prompt), "stop"


_ANSWERED = "select s_suppkey, case when bad then '' else upper(p) end as text, case when bad then 0 else length(p) end::int as tokens_generated, case when bad then 'error' else 'stop' end as finish_reason from (select *, {0} as bad from (select s_suppkey, 'say ' || s_name as p from supplier))"


@query(_ANSWERED.format("p like '%7'"))
def generated_texts(spark, d):
    """A backend's texts, one prompt at a time; a prompt that keeps failing is a row's failure."""
    prompts = spread(table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("say "), "s_name").alias("prompt")))
    return execution.generate(prompts, _answers, retries=2, delay=0.0).select("s_suppkey", "text", "tokens_generated", "finish_reason")


@query(_ANSWERED.format("false"))
def generated_batches(spark, d):
    """A backend that takes lists of prompts."""
    prompts = spread(table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("say "), "s_name").alias("prompt")))
    return execution.batched(lambda ps: [(p.upper(), len(p), "stop") for p in ps], prompts).select("s_suppkey", "text", "tokens_generated", "finish_reason")


@query("select conv_id, turn, length(text) // 4 + 16 <= 64 as fits from conversations")
def context_fits(spark, d):
    """Whether prompts and what is to be generated fit a model's context."""
    model = execution.ModelInfo("m", context_length=64)
    return table(spark, d, "conversations").select("conv_id", "turn", model.fits(F.col("text"), 16).alias("fits"))


_OWN = {"system": "<<{content}>>\n", "user": "Q: {content}\n", "assistant": "A: {content}\n"}


@query("select s_suppkey, '<<' || s_name || '>>' || chr(10) || 'Q: ' || s_nationkey || chr(10) || 'A: ' as prompt from supplier")
def chat_template_custom(spark, d):
    """A template of a user's own."""
    templates.register("own", _OWN)
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).cast("string").alias("content"))
    return table(spark, d, "supplier").select("s_suppkey", templates.chat(F.array(turn("system", "s_name"), turn("user", "s_nationkey")), "own").alias("prompt"))
