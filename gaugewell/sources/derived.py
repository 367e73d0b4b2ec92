"""Evaluation tables derived from the driver's tables: deterministic, and with the same text in every SQL engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name -> SQL expression over events, in the functions that all engines share.
MODEL_OUTPUTS = {
    "idx": "event_id",
    "sample_id": "concat('s', cast(event_id % 7000 as string))",
    "task": "concat('task_', cast(user_id % 4 as string))",
    "category": "event_type",
    "ref": "substr('ABCD', cast(event_id % 4 + 1 as int), 1)",
    "letter": "substr('ABCD', cast((event_id * 7 + user_id) % 4 + 1 as int), 1)",
    "finish_reason": "case when event_id % 11 = 0 then 'length' else 'stop' end",
    "tokens_generated": "cast(event_id % 257 as bigint)",
    "execution_time": "value",
    "error": "case when event_type = 'error' and event_id % 3 = 0 then 'Timed out: exceeded limit' when event_type = 'error' and event_id % 3 = 1 then 'SyntaxError: invalid syntax' else '' end",
    "parse_error": "case when event_id % 29 = 0 then 'could not parse' else '' end",
}
RAW_OUTPUT = """case cast(event_id % 14 as int)
 when 0 then concat('The answer is ', letter, '.')
 when 1 then concat('I think it is (', letter, ').')
 when 2 then concat('Answer: ', letter)
 when 3 then concat('**', letter, '**')
 when 4 then concat(chr(96), letter, chr(96))
 when 5 then 'I cannot help with that.'
 when 6 then 'Sorry, no.'
 when 7 then ''
 when 8 then '...'
 when 9 then concat('Here:', chr(10), '```python', chr(10), 'def f(x):', chr(10), '    return x + ', cast(event_id as string), chr(10), '```', chr(10), 'Done.')
 when 10 then concat('{"name": "f', cast(event_id % 5 as string), '", "arguments": {"k": ', cast(event_id % 3 as string), '}}')
 when 11 then concat('{"k": ', cast(event_id as string), ',}')
 when 12 then concat('Option ', letter, ' or [', substr('ABCD', cast(event_id % 4 + 1 as int), 1), '] maybe.')
 else concat('```', chr(10), 'const a = ', cast(event_id as string), ';', chr(10), '```', chr(10), 'and', chr(10), '```json', chr(10), '{"a": 1}', chr(10), '```')
 end"""


def _literal(x: str) -> str:
    """An SQL expression for a text; line ends and backquotes as chr(), {L} as the row's letter, {N} as its number."""
    parts, out = [x], []
    for mark, sql in (("{L}", "letter"), ("{N}", "cast(event_id as string)"), ("\n", "chr(10)"), ("`", "chr(96)")):
        parts = [y for p in parts for y in ([p] if isinstance(p, tuple) else [z for i, q in enumerate(p.split(mark)) for z in (([(sql,)] if i else []) + [q])])]
    for p in parts:
        if p:
            out.append(p[0] if isinstance(p, tuple) else "'" + p.replace("'", "''") + "'")
    return "concat(" + ", ".join(out or ["''"]) + ")"


#: Shapes beside those above: each refusal, each form of a choice, empty answers, JSON of all kinds, code in each language.
SHAPES = [
    *["I can't do that.", "I am unable to see it, number {N}.", "I'm not able to run this here.", "I will not write it at all.", "As an AI language model I hold no views.", "As an assistant, I would rather stop.", "I don't have enough information, I cannot tell.", "That is not possible for me, sorry.", "Sorry, but this is a longer answer about {N}.", "I don't know which of these is meant.", "I'm not sure about the second one.", "I do not understand what is asked here.", "I'm not familiar with this library.", "This is beyond my capabilities as it stands.", "That lies outside my knowledge of the field.", "I don't have access to the files.", "I would need more information to decide.", "I can't provide specific advice on {N}.", "I cannot generate code for that.", "I won't generate code of this kind.", "Here code generation is not allowed.", "I apologize, but that will not work."],
    *["The answer is: {L}", "Correct answer: {L}", "Option: {L} fits", "choice: {L}", "[{L}]", "{L}) because of {N}", "{L}.", "it must be {L} today", "answer {L}", "**{L}** or `A`", "(A) no, (B) no, ({L}) yes", "Neither: none of the above 42", "x y z {N}", "the answer is b."],
    *["[ ]", "{}", "null", "none", "N/A", "   ", "\n\n"],
    *['{"a": {"b": [1, 2, {"c": {N}}]}}', '[1, 2, [3, {N}]]', "{'name': 'f', 'k': {N}}", '{name: "f", k: {N}}', 'Result: {"k": {N}} and {"longer": "text", "k": 1}', 'see [1] and [1, 2, {N}] there', '```json\n{"k": {N}}\n```', '```json\n[{N}, 2]\n```\nThat is all.', '"only a string {N}"', "{N}", "true", '{"open": [1, 2', '{"k": 1, // note\n "j": {N}}', '{"k": 1 /* note */, "j": {N},}'],
    *[f"```{tag}\n{body}\n```" for tag, body in (("python", "import math\nprint(math.pi + {N})"), ("", "def g(a, b):\n    return a + b"), ("javascript", "function f() { return {N}; }"), ("java", "public class A { int x = {N}; }"), ("cpp", "#include <vector>\nint main() { return 0; }"), ("rust", "fn main() { let x = {N}; }"), ("go", "package main\nfunc main() {}"), ("", "#!/usr/bin/env ruby\nputs {N}"), ("sql", "select {N} from t"))],
    *["```python\na = 1\n```\nthen\n```python\nb = {N}\n```", "```python\nopen = {N}", "```\n```", "```yaml\nk: {N}\n```", "Text, then ```inline {N}``` and more."],
]
_shapes = " ".join(f"when {i} then {_literal(x)}" for i, x in enumerate(SHAPES))
RAW_OUTPUT = f"case when cast(event_id % 100 as int) < 60 then {RAW_OUTPUT} else case cast((event_id % 100 - 60 + 40 * cast(floor(event_id / 100) as bigint)) % {len(SHAPES)} as int) {_shapes} end end"

#: Whether the code that a shape holds is Python, for those that hold code: all with a fence that holds something.
CODE_OK = {"```json\n{": True, "```json\n[": True, "```python\nimport": True, "```\ndef": True, "```javascript": False, "```java\n": False, "```cpp": False, "```rust": False, "```go": False, "```\n#!": False, "```sql": False, "```python\na": True, "```python\nopen": True, "```yaml": True, "Text, then ```": False}
_held = {i: ok for i, x in enumerate(SHAPES) for start, ok in CODE_OK.items() if x.startswith(start)}
_at = f"(event_id % 100 - 60 + 40 * floor(event_id / 100)::bigint) % {len(SHAPES)}"
CODE_OK_SQL = f"case when event_id % 100 < 60 then case event_id % 14 when 9 then true when 13 then false end else case {_at} {' '.join(f'when {i} then {str(ok).lower()}' for i, ok in _held.items())} end end"

_inner = ", ".join(f"{sql} as {name}" for name, sql in MODEL_OUTPUTS.items())
#: A view for other engines; string is varchar there.
MODEL_OUTPUTS_SQL = f"(select *, {RAW_OUTPUT} as raw_output from (select event_id, {_inner} from events))".replace("as string", "as varchar")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer than half as many partitions; larger inputs stay as they are read, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """df dealt out row by row, at least two tasks a core, for rows that cost milliseconds each.

    The number of partitions doesn't tell where rows are: of the splits of a file with one row group a single one holds them all.
    """
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spread(table(spark, sf_dir, "events"))
    inner = events.select("event_id", *[F.expr(sql).alias(name) for name, sql in MODEL_OUTPUTS.items()])
    # the condition always holds; no filter is pushed below it, so a text is made once, as if it were read
    return inner.withColumn("raw_output", F.when(F.monotonically_increasing_id() >= 0, F.expr(RAW_OUTPUT)))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    return lineitem.select(F.col("l_orderkey").alias("problem_id"), F.col("l_linenumber").alias("attempt"), (F.col("l_returnflag") == "A").alias("passed"))


def latency_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("prompt"), F.col("event_id").alias("run"), F.col("value").alias("ttft_ms"), (1000 / (1 + F.col("value"))).alias("throughput"), (F.col("event_id") % 257).alias("tokens"))


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return rows


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, pos, benchmark, accuracy, ttft_ms, throughput, peak_ram_gb) by supplier."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("model"),
        key.alias("pos"),
        F.element_at(F.array(F.lit("BF16"), F.lit("Q8_0"), F.lit("Q4_K_M")), (key % 3 + 1).cast("int")).alias("quantization"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("benchmark"), (((key * m) % 101) / 100.0).alias("accuracy")) for n, m in (("humaneval", 7), ("hellaswag", 13), ("bfcl", 29))])).alias("x"),
        (key * 37 % 400).cast("double").alias("ttft_ms"),
        (key * 11 % 30).cast("double").alias("throughput"),
        (key * 17 % 60).cast("double").alias("peak_ram_gb"),
    ).select("model", "pos", "quantization", "x.*", "ttft_ms", "throughput", "peak_ram_gb")


SCORES_SQL = """(select s_name as model, s_suppkey as pos, case s_suppkey % 3 when 0 then 'BF16' when 1 then 'Q8_0' else 'Q4_K_M' end as quantization,
 b.benchmark, (s_suppkey * b.m % 101) / 100.0::double as accuracy, (s_suppkey * 37 % 400)::double as ttft_ms, (s_suppkey * 11 % 30)::double as throughput, (s_suppkey * 17 % 60)::double as peak_ram_gb
 from supplier, (values ('humaneval', 7), ('hellaswag', 13), ('bfcl', 29)) as b(benchmark, m))"""
