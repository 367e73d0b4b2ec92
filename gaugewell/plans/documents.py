"""Queries of documents and streams: dashboards, results as JSON, token events, datasets' subsets, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import templates
from ..operators import dashboard
from ..sources import datasets, result_json
from ..sources.derived import MODEL_OUTPUTS_SQL as OUT
from ..sources.derived import model_outputs, table
from ..streaming import tokens
from .catalog import SCORED, _q, query, rounded, scored

_K = "s_suppkey"
_ACC = {"humaneval": 7, "hellaswag": 13, "bfcl": 29}
_acc = lambda b: f"(({_K} * {_ACC[b]}) % 101) / 100.0"


def _comparison(spark, d):
    """A document per supplier, and for every fourth a newer one of one benchmark; scores as objects or numbers, some benchmarks missing, some documents broken."""
    k = F.col(_K)
    text = lambda c: c.cast("string")
    acc = {b: text(F.round((k * m) % 101 / 100, 2)) for b, m in _ACC.items()}
    as_object = lambda b, n: F.concat(F.lit(f'"{b}": {{"accuracy": '), acc[b], F.lit(', "samples": '), text(n), F.lit("}"))
    as_number = lambda b: F.concat(F.lit(f'"{b}": '), acc[b])
    parts = F.array_compact(F.array(as_object("humaneval", k % 50), F.when(k % 3 != 0, as_number("hellaswag")), F.when(k % 5 != 0, as_object("bfcl", k % 20)), F.lit('"note": "x"')))
    doc = F.concat(F.lit('{"models": {"'), "s_name", F.lit('": {'), F.array_join(parts, ", "), F.lit('}}, "generated_at": "2024-01-01"}'))
    doc = F.when(k % 11 == 0, F.lit('{"models": ')).otherwise(doc)
    newer = F.concat(F.lit('{"generated_at": "2024-06-01", "models": {"'), "s_name", F.lit('": {"bfcl": {"accuracy": 0.5, "samples": 7}}}}'))
    s = table(spark, d, "supplier")
    both = s.select(F.lit("all.json").alias("source"), doc.alias("doc")).unionAll(s.where(k % 4 == 0).select(F.lit("newer.json").alias("source"), newer.alias("doc")))
    return both.withColumn("doc", F.try_parse_json("doc"))


def _measured(spark, d):
    k = F.col(_K)
    value = (k % 400).cast("string")
    one = F.concat(F.lit('{"model_name": "'), "s_name", F.lit('", "summary": {"ttft_ms": '), value, F.lit(', "throughput_tok_s": 2.5}}'))
    two = F.concat(F.lit('{"model": "'), "s_name", F.lit('", "overall_metrics": {"ttft_ms": {"mean": '), value, F.lit('}, "throughput_tokens_per_sec": {"mean": 3.5}}, "timestamp": "t"}'))
    return table(spark, d, "supplier").where("s_suppkey % 3 > 0").select(F.concat(F.lit("m"), (k % 3).cast("string")).alias("source"), F.try_parse_json(F.when(k % 3 == 1, one).otherwise(two)).alias("doc"))


_SCORES = f"""(select *, case when b4 then 0.5 when {_K} % 5 <> 0 and ok then {_acc('bfcl')} end as a3, case when b4 then 7 when {_K} % 5 <> 0 and ok then {_K} % 20 end as n3 from
 (select *, case when ok then {_acc('humaneval')} end as a1, case when ok and {_K} % 3 <> 0 then {_acc('hellaswag')} end as a2 from (select {_K}, s_name, {_K} % 4 = 0 as b4, {_K} % 11 <> 0 as ok from supplier)) where ok or b4)"""


@query(f"""select s_name as model, round(coalesce(a1, 0) * 100, 6)::double as humaneval, round(coalesce(a2, 0) * 100, 6)::double as hellaswag, round(coalesce(a3, 0) * 100, 6)::double as bfcl,
 round(coalesce((coalesce(a1, 0) + coalesce(a2, 0) + coalesce(a3, 0)) * 100 / nullif((coalesce(a1, 0) > 0)::int + (coalesce(a2, 0) > 0)::int + (coalesce(a3, 0) > 0)::int, 0), 0), 6)::double as avg_accuracy,
 (case when ok then {_K} % 50 else 0 end)::bigint as humaneval_samples, 0::bigint as hellaswag_samples, coalesce(n3, 0)::bigint as bfcl_samples,
 (case when {_K} % 3 > 0 then {_K} % 400 end)::double as ttft_ms, (case {_K} % 3 when 1 then 2.5 when 2 then 3.5 end)::double as throughput, case when {_K} % 3 > 0 then 'm' || {_K} % 3 end as measured_in from {_SCORES}""")
def dashboard_join(spark, d):
    """Benchmarks and measurements of models from documents of differing shapes; newer ones win, broken ones are passed over."""
    out = dashboard.combined(_comparison(spark, d), _measured(spark, d))
    return rounded(out, "humaneval", "hellaswag", "bfcl", "avg_accuracy")


@query(f"select error, count(*) as n, min(idx) as first_at from {OUT} group by error")
def error_histogram(spark, d):
    return dashboard.histogram(model_outputs(spark, d), "error", "idx")


_OLD = "idx % 3 = 1"


@query(f"""select idx, case when {_OLD} then 1 else 2 end as version, sample_id, pred as content, case when {_OLD} then null else 0.5 end::double as confidence, score::double as score, passed,
 case when {_OLD} then '[1,' || idx % 5 || ']' end as extra from {SCORED}""")
def result_documents(spark, d):
    """Results as JSON and back: documents of this version, and flat ones of the version before with a field that nobody knows."""
    rows = scored(spark, d).withColumn("content", F.col("pred")).withColumn("confidence", F.lit(0.5))
    old = F.to_json(F.struct("idx", "sample_id", "content", "score", "passed", F.array(F.lit(1), F.col("idx") % 5).alias("later")))
    docs = rows.select(F.when(F.expr(_OLD), old).otherwise(result_json.to_json(rows.select(*[c for c in result_json.FIELDS if c in rows.columns]))).alias("doc"))
    got = result_json.from_json(docs, "doc")
    again = result_json.from_json(got.select(result_json.to_json(got).alias("doc"), F.col("version").alias("said")), "doc")
    return again.select("idx", F.col("said").alias("version"), "sample_id", "content", "confidence", "score", "passed", F.col("more")["later"].alias("extra"))


def _events(spark, d):
    k = F.col("event_id") % 10
    kind = F.when(k == 0, "start").when(k == 9, "end").otherwise("token")
    text = F.when(k == 9, F.when(F.floor(F.col("event_id") / 10) % 4 == 0, "length").otherwise("stop")).otherwise(F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("event_type")))
    return table(spark, d, "events").select(F.floor(F.col("event_id") / 10).cast("string").alias("request_id"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("time"), text.alias("text"))


_REQUESTS = """(select (event_id // 10)::varchar as request_id, min(epoch_us(ts)) filter (event_id % 10 = 0) as s, min(epoch_us(ts)) filter (event_id % 10 between 1 and 8) as f, max(epoch_us(ts)) filter (event_id % 10 = 9) as e,
 count(*) filter (event_id % 10 between 1 and 8 and event_id % 7 <> 0) as tokens, coalesce(bool_or(event_id // 10 % 4 = 0) filter (event_id % 10 = 9), false) as truncated from events group by 1)"""


@query(f"select request_id, round((f - s) / 1000.0, 6)::double as ttft_ms, tokens, round((e - s) / 1e6, 6)::double as seconds, round(case when e > s then tokens / ((e - s) / 1e6) else 0 end, 6)::double as throughput, truncated, e is not null as ended from {_REQUESTS}")
def token_requests(spark, d):
    """First-token time, throughput and truncation of requests from their token events."""
    return rounded(tokens.requests(_events(spark, d)), "ttft_ms", "seconds", "throughput")


@query(f"select truncated, count(*) as requests, round(avg((f - s) / 1000.0), 4)::double as ttft_ms_mean, round(median((f - s) / 1000.0), 4)::double as ttft_ms_median, sum(tokens)::bigint as tokens from {_REQUESTS} where e is not null group by truncated")
def token_summary(spark, d):
    out = tokens.summary(tokens.requests(_events(spark, d)), "truncated")
    return out.select("truncated", "requests", F.round("ttft_ms_mean", 4).alias("ttft_ms_mean"), F.round("ttft_ms_median", 4).alias("ttft_ms_median"), "tokens")


_NAMES = [*datasets.SUBSETS, "tiny", "mini", "other", None]
_names = ", ".join("null" if n is None else _q(n) for n in _NAMES)


@query(f"select p_partkey, coalesce(case when n in ({', '.join(map(_q, datasets.SUBSETS))}) then 'BFCL_v3_' || n || '.json' end, 'BFCL_v3_simple.json') as file from (select p_partkey, ([{_names}])[(p_partkey % {len(_NAMES)} + 1)::int] as n from part)")
def subset_files(spark, d):
    """The file of a subset; of an unknown one, and of none, the simple one."""
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES)).cast("int"))
    files = F.create_map(*[F.lit(x) for pair in datasets.SUBSETS.items() for x in pair])
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.try_element_at(files, name), F.lit(datasets.subset_file(None))).alias("file"))


_MODELS = ["Qwen2.5-7B", "gemma-2-9b", "Phi-3-mini", "mistral-7b", "unknown"]


@query(f"""select s_suppkey, case s_suppkey % 5 when 0 then case when sys <> '' then '<|im_start|>system' || chr(10) || sys || '<|im_end|>' || chr(10) else '' end || '<|im_start|>user' || chr(10) || s_name || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)
 when 1 then case when sys <> '' then '<start_of_turn>model' || chr(10) || sys || '<end_of_turn>' || chr(10) else '' end || '<start_of_turn>user' || chr(10) || s_name || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10)
 when 2 then case when sys <> '' then '<|system|>' || chr(10) || sys || '<|end|>' || chr(10) else '' end || '<|user|>' || chr(10) || s_name || '<|end|>' || chr(10) || '<|assistant|>' || chr(10)
 when 3 then case when sys <> '' then '<s>[INST] ' || sys || chr(10) || chr(10) else '' end || s_name || ' [/INST] '
 else case when sys <> '' then 'System: ' || sys || chr(10) || chr(10) else '' end || 'User: ' || s_name || chr(10) || 'Assistant: ' end as prompt
 from (select s_suppkey, s_name, case when s_suppkey % 3 = 0 then '' when s_suppkey % 3 = 1 then 'Be brief.' else '' end as sys from supplier)""")
def one_shot_prompts(spark, d):
    """A prompt in the form of the family that a model's name tells, with and without a system message."""
    k = F.col("s_suppkey")
    model = F.get(F.array(*map(F.lit, _MODELS)), (k % 5).cast("int"))
    system = F.when(k % 3 == 0, "").when(k % 3 == 1, "Be brief.")
    return table(spark, d, "supplier").select("s_suppkey", templates.one_shot(model, F.col("s_name"), system).alias("prompt"))
