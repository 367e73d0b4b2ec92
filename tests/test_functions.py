"""Scalar cases: our own strings for each rule."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from gaugewell.functions import choice, code, jsons, refusal, robust, scoring, templates, text


def ask(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def each(spark, cases, f):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string")
    got = [r["y"] for r in df.orderBy("i").select("i", f(F.col("x")).alias("y")).collect()]
    assert got == [y for _, y in cases]


def test_choice_letters(spark):
    each(
        spark,
        [("So the answer is C.", "C"), ("(b)", "B"), ("Answer: D", "D"), ("E.", "E"), ("I choose [a]", "A"), ("answer: A, no, answer: B", "B"), ("**C** or `D`", "C"), ("xyz", ""), (None, ""), ("", ""), ("hmm bad", "D")],
        choice.extract,
    )


def test_choice_confidence_and_alternatives(spark):
    each(spark, [("answer: A", 1.0), ("**A**", 0.95), ("(A)", 0.9), ("zzz", 0.0)], lambda c: choice.confidence(c, choice.extract(c)))
    each(spark, [("answer: A or (B) or C.", ["A", "B", "C"]), ("zzz", [])], choice.alternatives)
    each(spark, [("because", "B"), (" c ", "C"), (None, ""), ("xyz", "X")], choice.normalise)
    each(spark, [("It is so. **B**", "It is so.")], lambda c: choice.reasoning(c, choice.extract(c)))


def test_refusals(spark):
    cases = [("I cannot do this", True), ("Sorry, I can't", True), ("I don't know the result of it", True), ("As an AI I AM UNABLE TO say", True), ("def f(): return 1 + 2 + 3 + 4", False), ("", True), (None, True), ("  ... ", True), ("{}", True), ("not now", True), ("I would need more information on the whole thing", False)]
    each(spark, cases, refusal.is_refusal)
    assert ask(spark, "zap it at once, whatever it is", lambda c: refusal.detect(c, custom=[("zap", 0.9)])["is_refusal"])
    assert ask(spark, "i cannot say anything about this", lambda c: refusal.detect(c, threshold=0.99)["is_refusal"]) is False


def test_code_blocks(spark):
    each(
        spark,
        [
            ("a\n```python\nx = 1\n```\nb", "x = 1"),
            ("```\nx = 1\n```\n```python\ny = 2\n```", "y = 2"),
            ("```json\n{}\n```\n```python\ny = 2\n```", "y = 2"),
            ("```json\n{}\n```", "{}"),
            ("```x = 1```", "x = 1"),
            ("```python\nx = 1", "x = 1"),
            ("So:\ndef f(a):\n    return a\nend", "def f(a):\n    return a"),
            ("say <code>z = 3</code>", "z = 3"),
            ("just prose", "just prose"),
            (None, ""),
        ],
        code.extract,
    )
    each(spark, [("#!/usr/bin/env ruby\n", "ruby"), ("import x", "python"), ("let a = 1", "javascript"), ("#include <x>", "c"), ("package main", "go"), ("zzz", None)], code.detect_language)
    each(spark, [("x = 1  # one\n\n# two\ny = '#'", "x = 1\ny = '#'")], code.strip_comments)
    long = "x = '" + "a#" * 200_000
    each(spark, [(long, long), (long + "' # b", long + "'"), ("a \"#\" 'b' # c \" d", "a \"#\" 'b'"), ("a 'b # c", "a 'b # c"), (None, None), ("", ""), ("\t\n#\n", "")], code.strip_comments)
    each(spark, [("x = 1", True), ("x = = 1", False), ("", True)], code.syntax_ok)
    each(spark, [("a\ndef g(x):\n    return 1\n\nb", "def g(x):\n    return 1")], lambda c: code.extract_function(c, "g"))


def test_json(spark):
    each(
        spark,
        [('{"a": 1}', '{"a": 1}'), ("```json\n[1]\n```", "[1]"), ("{'a': 1}", '{"a": 1}'), ('{"a": 1,}', '{"a": 1}'), ('so [1, 2] or {"b": 2}', "[1, 2]"), ("prose", "prose"), ("1 2", "1 2"), ("{a: 1}", '{"a": 1}')],
        jsons.extract,
    )
    each(spark, [("1 2", False), ("[1]", True), ("", False), (None, False), ("nul", False), ('"x"', True)], jsons.is_json)
    each(spark, [('{"name": "f", "arguments": {"a": 1}}', "f"), ('{"g": {"a": 1}}', "g")], jsons.call_name)
    each(spark, [("NaN", True), ("{", False)], jsons.is_json_exact)


def test_robust(spark):
    each(spark, [("```\nx\n```", "code"), ("The answer is B", "mc"), ('[1, "q"]', "json"), ("I cannot", "refusal_fallback")], lambda c: robust.parse(c)["parser_used"])


def test_text(spark):
    each(spark, [("  Ab\t\n c  ", "ab c"), (None, "")], text.normalise)
    each(spark, [("ﬁne!", "fine")], lambda c: text.normalise(c, punctuation=True, compatibility=True))
    each(spark, [("a<b>c</b>", "c"), ("none", None)], lambda c: text.extract_between(c, "<b>", "</b>"))
    each(spark, [("12345678", 2), (None, 0)], text.token_estimate)
    assert ask(spark, "a=1,b", text.key_values) == {"a": "1", "b": "true"}
    assert ask(spark, "8 cores, 32 GB RAM", text.hardware).asDict() == {"cpu": 8, "ram": 32, "gpu": None}
    assert ask(spark, "fast code", lambda c: F.array(*text.intents(c).values())) == [True, True, False, False, False]


def test_templates(spark):
    each(spark, [("Llama-3-8B-Instruct", "llama"), ("mistralai/Mixtral-8x7B", "mistral"), ("Qwen2.5", "qwen2"), ("x", "default")], templates.detect)
    messages = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in (("user", "u"), ("system", "s"), ("assistant", "a"))])
    got = ask(spark, "", lambda _: templates.chat(messages, "phi"))
    assert got == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\na<|end|>\n<|assistant|>\n"
    assert ask(spark, "", lambda _: templates.chat(messages, "default", False, True)) == "User: s\n\nu\nAssistant: a\n"
    assert ask(spark, "q", lambda c: templates.render("{prompt}|{other}\n", c)) == "q|{other}\n"


@pytest.mark.parametrize("n,c,k", [*itertools.product((0, 1, 5, 100, 101), (0, 1, 5), (0, 1, 3, 10))])
def test_pass_at_k(spark, n, c, k):
    if c > n:
        return
    if n == 0 or c == 0 or k == 0:
        want = 0.0
    elif c == n:
        want = 1.0
    elif n <= 100:
        want = 1.0 if k > n - c else 1 - math.comb(n - c, k) / math.comb(n, k)
    else:
        want = 1 - (1 - c / n) ** k
    got = spark.range(1).select(scoring.pass_at_k(F.lit(n), F.lit(c), F.lit(k)).alias("p")).first()["p"]
    assert got == pytest.approx(want, abs=1e-12)


def test_scoring(spark):
    row = spark.sql("select array(named_struct('name','f','args',map('k','1','z','9')), named_struct('name','g','args',map('k','1'))) c, map('f', map('k', array('1','2'))) e")
    assert row.select(scoring.function_calls(F.col("c"), F.col("e")).alias("s")).first()["s"] == 0.5
    row = spark.sql("select map('a','1') args, array(named_struct('name','f','required',array('a'),'types',map('a','integer'))) fs")
    ok = lambda name: row.select(scoring.call_is_valid(F.lit(name), F.col("args"), F.col("fs")).alias("v")).first()["v"]
    assert ok("f") and not ok("g")
    each(spark, [(" b", True), ("C", False), (None, False)], lambda c: scoring.choice(c, F.lit("B")))
    each(spark, [("B", True), ("", False)], lambda c: scoring.first_letter(c, F.lit("B")))
