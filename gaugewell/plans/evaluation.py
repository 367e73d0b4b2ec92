"""Queries of the evaluator, its loaders and its reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calls, refusal, schemas, templates, text
from ..operators import evaluate, execution, leaderboard, report
from ..sources import benchmarks, inference
from ..sources.derived import MODEL_OUTPUTS_SQL as OUT
from ..sources.derived import SCORES_SQL, dealt, model_outputs, scores, spread, table
from .catalog import CATEGORY, JSON, SCORED, _family, _J, _L, _q, _valid, query, rounded, scored

_BROKEN = "case when event_id % 13 = 0 then 'error' else finish_reason end"


def _samples(spark, d):
    out = model_outputs(spark, d).withColumn("finish_reason", F.when(F.col("event_id") % 13 == 0, "error").otherwise(F.col("finish_reason")))
    return out.select("idx", "sample_id", "finish_reason", F.col("raw_output").alias("text"), F.col("ref").alias("reference"))


@query(f"""select idx, case when bad then null else pred end as content, case when bad then null else 'mc' end as parser_used, refusal_detected,
 case when not bad and pred = ref then 1.0 else 0.0 end::double as score, not bad and pred = ref as passed, case when bad then 'generation failed' end as error
 from (select *, ({_BROKEN}) = 'error' as bad from {SCORED})""")
def evaluate_multiple_choice(spark, d):
    """Generated text to letters, flags and scores; rows whose generation failed are error rows."""
    out = evaluate.evaluate(_samples(spark, d), "multiple_choice", "mc")
    return out.select("idx", "content", "parser_used", "refusal_detected", "score", "passed", "error")


@query(f"select idx, json as content, case when {_valid('json')} then 1.0 else 0.0 end::double as score, {_valid('json')} as passed from (select *, {JSON} as json from {OUT})")
def evaluate_json_validity(spark, d):
    return evaluate.evaluate(_samples(spark, d).drop("finish_reason"), "json_validity", "json").select("idx", "content", "score", "passed")


@query(f"select task, round(avg((pred = ref)::int), 6) as accuracy, count(*) as total from {SCORED} group by task")
def evaluate_custom_metric(spark, d):
    """A metric of a user's own: the content equals the reference."""
    rows = model_outputs(spark, d).select("task", F.col("raw_output").alias("text"), F.col("ref").alias("reference"))
    out = evaluate.evaluate(rows, lambda content, reference: content.eqNullSafe(reference), "mc")
    return rounded(out.groupBy("task").agg(F.avg("score").alias("accuracy"), F.count(F.lit(1)).alias("total")), "accuracy")


_K = "(event_id // 6) % 3"


def _call_texts(spark, d):
    k = (F.floor(F.col("event_id") / 6) % 3).cast("string")
    forms = [
        F.concat(F.lit('{"name": "f", "arguments": {"k": '), k, F.lit(', "more": "x"}}')),
        F.concat(F.lit('Calls: [{"name": "f", "arguments": {"k": '), k, F.lit('.0}}, {"name": "g", "arguments": {}}] as asked.')),
        F.lit('{"name": "h", "arguments": {}}'),
        F.lit("[]"),
        F.lit("no call"),
        F.concat(F.lit('{"f": {"k": '), k, F.lit("}}")),
    ]
    text = F.get(F.array(*forms), (F.col("event_id") % 6).cast("int"))
    reference = F.lit('[{"g": {}}, {"f": {"k": [0]}}, {"f": {"k": [1, 2]}}]')
    return spread(table(spark, d, "events")).select("event_id", text.alias("text"), reference.alias("reference"))


@query(f"""select event_id, score, score > 0 as passed from (select event_id, (case event_id % 6 when 0 then case when {_K} in (1, 2) then 1.0 else 0.0 end
 when 1 then case when {_K} in (1, 2) then 1.0 else 0.5 end else 0.0 end)::double as score from events)""")
def evaluate_function_calls(spark, d):
    """Calls in text against references in JSON, of which the last entry of a function counts."""
    return evaluate.evaluate(_call_texts(spark, d), "function_call_match", "json").select("event_id", "score", "passed")


@query(f"""select event_id, (case event_id % 6 when 0 then 1 when 1 then 2 when 2 then 1 when 5 then 1 else 0 end)::int as n_calls,
 case event_id % 6 when 0 then 'f' when 1 then 'f' when 2 then 'h' when 5 then 'f' end as first_name, case when event_id % 6 in (0, 1, 5) then ({_K})::bigint end as k from events""")
def func_call_forms(spark, d):
    """The calls that a text holds, in any of their forms."""
    found = _call_texts(spark, d).withColumn("calls", calls.parse(F.col("text")))
    first = F.get("calls", F.lit(0))
    k = F.try_variant_get(F.try_element_at(first["args"], F.lit("k")), "$", "double").cast("long")
    return found.select("event_id", F.size("calls").alias("n_calls"), first["name"].alias("first_name"), k.alias("k"))


@query("""select s_suppkey, s_suppkey % 7 = 0 as passed, case when s_suppkey % 7 = 0 then 1.0 else 0.0 end::double as score, s_suppkey % 7 = 3 as blocked,
 case s_suppkey % 7 when 5 then 'no entry point for check()' when 6 then 'no code' end as fault from supplier""")
def evaluate_pass_at_1(spark, d):
    """Completions in fences run with their tests: right, wrong, no Python, a blocked import, an error; and rows without an entry point or a text, which can't be run."""
    bodies = ["def f(x):\n    return x * 2", "def f(x):\n    return x + 2", "def f(x) return", "import os\ndef f(x):\n    return x * 2", "def f(x):\n    raise ValueError(x)", "def f(x):\n    return x + 2"]
    forms = F.array(*[F.lit(f"Here it is:\n```python\n{b}\n```\nDone.") for b in bodies], F.lit(None).cast("string"))
    k = (F.col("s_suppkey") % 7).cast("int")
    rows = table(spark, d, "supplier").select("s_suppkey", F.get(forms, k).alias("text"), F.lit("").alias("reference"), F.lit("def check(candidate):\n    assert candidate(3) == 6\n").alias("test"), F.when(k != 5, "f").alias("entry_point"))
    parser = lambda c: F.when(c.isNotNull(), evaluate.PARSERS["code"](c))
    out = evaluate.evaluate(dealt(rows), "pass_at_k", parser)
    fault = F.when(F.col("error").startswith("no "), F.col("error"))
    return out.select("s_suppkey", "passed", "score", F.coalesce(F.col("error").startswith("Blocked"), F.lit(False)).alias("blocked"), fault.alias("fault"))


@query("""select id, prompt, (row_number() over (order by pos) - 1)::bigint as idx from (select *, concat('item_', pos::varchar) as id from (select row_number() over () - 1 as pos, item_id, text as prompt from benchmark))
 where item_id % 7 <> 3 qualify row_number() over (order by pos) <= 200""")
def loader_samples(spark, d):
    """Ids by place in the file; rows without a prompt go before the cap; the resume index counts the rest."""

    def extract(rows):
        prompt = F.when(F.col("item_id") % 7 != 3, F.col("text"))
        return rows.select("idx", F.concat(F.lit("item_"), F.col("idx").cast("string")).alias("id"), prompt.alias("prompt")).where("prompt is not null")

    return benchmarks.samples(table(spark, d, "benchmark"), extract, 200).select("id", "prompt", "idx")


_PARAMS = r"""'{' || chr(10) || '  "type": "object",' || chr(10) || '  "size": ' || p_size::varchar || chr(10) || '}'"""


@query(f"""select p_partkey, {_q(templates.CALL_HEAD)} || 'Function: ' || p_brand || chr(10) || 'Description: ' || p_type || chr(10) || 'Parameters: ' || {_PARAMS} || chr(10) || chr(10)
 || 'Function: g' || chr(10) || 'Description: ' || chr(10) || 'Parameters: {{}}' || chr(10) || {_q(templates.CALL_QUERY)} || p_name || {_q(templates.CALL_FOOT)} as prompt from part""")
def prompt_function_calls(spark, d):
    parameters = F.concat(F.lit('{"type": "object", "size": '), F.col("p_size").cast("string"), F.lit("}"))
    one = F.struct(F.col("p_brand").alias("name"), F.col("p_type").alias("description"), parameters.alias("parameters"))
    two = F.struct(F.lit("g").alias("name"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("parameters"))
    return table(spark, d, "part").select("p_partkey", templates.function_prompt(F.col("p_name"), F.array(one, two)).alias("prompt"))


_counts = ", ".join([f"count(*) filter (not passed and {c}) as {k}" for k, c in _family.items()] + [f"count(*) filter (not passed and category = '{k}') as kind_{k}" for k in report.KINDS])


@query(f"select count(*) as total, count(*) filter (passed) as passed, count(*) filter (not passed) as failed, round(coalesce(avg(passed::int), 0), 6) as pass_rate, {_counts} from (select * replace ({CATEGORY} as category) from {SCORED})")
def diagnostic_report(spark, d):
    """All counts of a diagnostic report, by one aggregation."""
    return rounded(report.report_row(scored(spark, d)), "pass_rate")


@query(f"select idx, left(sample_id, 30) as sample_id, case when passed then 'pass' else 'fail' end as status, printf('%.2f', score) as score, printf('%.2f', execution_time) as time, 'mc' as parser from {SCORED} order by idx limit 10")
def report_details(spark, d):
    """The first results of a run as the console shows them."""
    return report.details(scored(spark, d).withColumn("parser_used", F.lit("mc"))).orderBy("idx").limit(10)


@query(f"select idx, sample_id, left(coalesce(nullif(error, ''), nullif(parse_error, '')), 200) as message from {SCORED} where error <> '' or parse_error <> ''")
def report_errors(spark, d):
    return report.errors(scored(spark, d))


@query("select s_suppkey as model, n_name, case when s_suppkey % 3 = 0 then null else s_acctbal end as throughput from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 3 <> 0")
def models_with_throughput(spark, d):
    """Models beside their own inference metrics, those that have any."""
    s = table(spark, d, "supplier")
    board = s.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("model"), "n_name")
    metrics = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("model"), F.col("s_acctbal").alias("throughput"))
    return leaderboard.measured(inference.with_metrics(board, metrics))


_RUN = "(select event_type as prompt, event_type <> 'error' as success, value as ttft_ms, 1000 / (1 + value) as throughput, event_id % 257 as tokens, 1.5 as initial_gb, 3.0 + event_id % 4 as post_load_gb, 2.0 + event_id % 9 as ram_gb from events)"


@query(f"""select prompt, {', '.join(f'round({f}({c}), 6) as {c}_{n}' for c in ('ttft_ms', 'throughput') for n, f in (('mean', 'avg'), ('min', 'min'), ('max', 'max'), ('std', 'stddev_samp')))},
 greatest(max(post_load_gb), max(ram_gb))::double as peak_ram_gb, (greatest(max(post_load_gb), max(ram_gb)) - min(initial_gb))::double as model_ram_usage_gb, (max(post_load_gb) - min(initial_gb))::double as load_delta_gb,
 round(avg(tokens), 6) as tokens_mean, sum(tokens)::bigint as tokens_total, count(*) as runs from {_RUN} where success group by prompt""")
def inference_run_stats(spark, d):
    """Statistics of successful benchmark runs, with memory over the start and tokens."""
    e = table(spark, d, "events")
    runs = e.select(F.col("event_type").alias("prompt"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("ttft_ms"), (1000 / (1 + F.col("value"))).alias("throughput"), (F.col("event_id") % 257).alias("tokens"), F.lit(1.5).alias("initial_gb"), (3.0 + F.col("event_id") % 4).alias("post_load_gb"), (2.0 + F.col("event_id") % 9).alias("ram_gb"))
    return rounded(inference.run_stats(runs, "prompt"), "ttft_ms_mean", "ttft_ms_min", "ttft_ms_max", "ttft_ms_std", "throughput_mean", "throughput_min", "throughput_max", "throughput_std", "tokens_mean")


@query("select event_id, round(case when event_id % 5 = 0 then 0 else 100 * value / (event_id % 5 * 16) end, 6) as percent from events")
def memory_utilisation(spark, d):
    return table(spark, d, "events").select("event_id", F.round(inference.memory_utilisation(F.col("value"), F.col("event_id") % 5 * 16), 6).alias("percent"))


_TARGET = f"(select s_suppkey, ([{', '.join(map(_q, [*leaderboard.TARGETS, 'other', 'gemma4:e4b']))}])[(s_suppkey % 14 + 1)::int] as model from supplier)"


@query(f"select s_suppkey, model from {_TARGET} where model in ({', '.join(map(_q, leaderboard.TARGETS))})")
def leaderboard_targets(spark, d):
    names = F.array(*map(F.lit, [*leaderboard.TARGETS, "other", "gemma4:e4b"]))
    return leaderboard.targets(table(spark, d, "supplier").select("s_suppkey", F.get(names, (F.col("s_suppkey") % 14).cast("int")).alias("model")))


@query(f"""select model as name, round(avg(accuracy), 6) as avg_accuracy, max(accuracy) filter (benchmark = 'humaneval') as humaneval, max(accuracy) filter (benchmark = 'hellaswag') as hellaswag, max(accuracy) filter (benchmark = 'bfcl') as bfcl,
 max(throughput) as throughput_tok_s, max(ttft_ms) as ttft_ms, max(peak_ram_gb) as memory_gb, null::double as model_size_gb from {SCORES_SQL} group by model""")
def models_for_chat(spark, d):
    """What an assistant is told of each model."""
    one = lambda b: F.max(F.when(F.col("benchmark") == b, F.col("accuracy"))).alias(b)
    wide = scores(spark, d).groupBy(F.col("model").alias("display_name")).agg(F.round(F.avg("accuracy"), 6).alias("avg_accuracy"), *map(one, ("humaneval", "hellaswag", "bfcl")), F.max("throughput").alias("throughput"), F.max("ttft_ms").alias("ttft_ms"), F.max("peak_ram_gb").alias("memory_gb"))
    return leaderboard.compact(wide)


@query(f"""select model, upper(benchmark) as benchmark, printf('%.2f', accuracy * 100) || '%' as accuracy, pos as passed, pos * 2 as total, case when pos % 4 = 0 then 'N/A' else printf('%.1f', ttft_ms / 10 + 1) || 's' end as avg_time,
 case when accuracy > 0 then 'Complete' else 'Pending' end as status from {SCORES_SQL}""")
def leaderboard_detail_rows(spark, d):
    rows = scores(spark, d).withColumn("passed", F.col("pos")).withColumn("samples", F.col("pos") * 2)
    return leaderboard.detail_rows(rows.withColumn("avg_time", F.when(F.col("pos") % 4 != 0, F.col("ttft_ms") / 10 + 1)))


@query(f"select idx, {' + '.join(f'regexp_matches({_L}, {_q(p)})::int' for p, _ in refusal.PATTERNS)} as n_matches, length({_J}) as n_chars, left({_J}, 200) as preview from {OUT}")
def refusal_analysis(spark, d):
    r = refusal.analysed(model_outputs(spark, d), "raw_output")
    return r.select("idx", F.size("analysis.matches").alias("n_matches"), "analysis.n_chars", "analysis.preview")


@query("select event_id, case event_id % 3 when 0 then 'json,os.path,re' when 1 then '' else 'math' end as imports from events")
def sorted_imports(spark, d):
    """The modules that a text imports; none of a text that is no Python."""
    forms = F.array(F.lit("import re, json\nfrom os.path import join"), F.lit("import ("), F.lit("def f():\n    import math\n    from . import x"))
    return table(spark, d, "events").select("event_id", F.array_join(execution.sorted_imports(F.get(forms, (F.col("event_id") % 3).cast("int"))), ",").alias("imports"))


@query("select event_id, case event_id % 4 when 0 then true when 3 then false else false end as is_valid, case event_id % 4 when 0 then null when 1 then '$: k is missing' when 2 then '$.k: not of type integer' else 'not JSON' end as error from events")
def schema_validation(spark, d):
    """JSON against a schema: valid, a missing field, a wrong type, no JSON."""
    forms = F.array(F.col("props"), F.lit('{"j": 1}'), F.lit('{"k": "x"}'), F.lit("{"))
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}}
    rows = table(spark, d, "events").withColumn("v", schemas.validate(F.get(forms, (F.col("event_id") % 4).cast("int")), schema))
    return rows.select("event_id", "v.is_valid", F.when(F.col("v.error").startswith("not JSON"), "not JSON").otherwise(F.col("v.error")).alias("error"))


@query(f"select idx, (case when event_id % 5 = 0 then 0.0 when {_J} <> '' then 0.8 else 0.5 end)::double as confidence, event_id % 5 <> 0 and event_id % 7 <> 0 and ({_L} <> '') as valid from {OUT}")
def default_confidences(spark, d):
    c = F.when(F.col("event_id") % 5 != 0, F.col("raw_output"))
    wrong = F.when(F.col("event_id") % 7 == 0, "parse error")
    refused = text.strip(F.col("raw_output")) == ""
    return model_outputs(spark, d).select("idx", report.default_confidence(c).alias("confidence"), report.valid_result(c, wrong, refused).alias("valid"))
