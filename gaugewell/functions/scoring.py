"""Scoring rules and pass@k."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsons import is_json


def choice(pred: Column, ref: Column) -> Column:
    form = lambda x: F.upper(F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", ""))
    return form(pred) == form(ref)


def first_letter(pred: Column, ref: Column) -> Column:
    a, b = (F.upper(F.left(F.trim(F.coalesce(x, F.lit(""))), F.lit(1))) for x in (pred, ref))
    return a.isin("A", "B", "C", "D") & (a == b)


def json_validity(pred: Column) -> Column:
    return F.when(pred.isNull(), True).otherwise(is_json(pred))


def equal(pred: Column, ref: Column) -> Column:
    return pred.eqNullSafe(ref)


def function_calls(calls: Column, expected: Column) -> Column:
    """The share of predicted calls that are right.

    calls: array<struct(name, args map<string,string>)>; expected: map<string, map<string, array<string>>>. A
    call is right if its name is expected and each expected parameter has one of its valid values; other
    parameters don't matter. No call or no expectation scores 0.
    """

    def right(call: Column) -> Column:
        wanted = F.try_element_at(expected, call["name"])
        held = lambda p: F.array_contains(p["value"], F.try_element_at(call["args"], p["key"]))
        return F.coalesce(wanted.isNotNull() & F.forall(F.map_entries(wanted), lambda p: F.coalesce(held(p), F.lit(False))), F.lit(False))

    n = F.size(F.filter(calls, right))
    return F.when((F.size(calls) > 0) & (F.size(expected) > 0), n / F.size(calls)).otherwise(0.0)


def call_is_valid(name: Column, args: Column, functions: Column) -> Column:
    """A known function (the first of its name), its required parameters present, primitive types right.

    functions: array<struct(name, required array<string>, types map<string,string>)>; args: map<string,string> of JSON values.
    """
    f = F.try_element_at(F.filter(functions, lambda x: x["name"] == name), F.lit(1))
    forms = {"string": '^".*"$', "integer": r"^(-?\d+|true|false)$", "number": r"^(-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false)$", "boolean": "^(true|false)$", "array": r"(?s)^\[.*\]$", "object": r"(?s)^\{.*\}$"}

    def typed(p: Column) -> Column:
        kind = F.try_element_at(f["types"], p["key"])
        ok = F.lit(True)
        for k, form in forms.items():
            ok = F.when(kind == k, p["value"].rlike(form)).otherwise(ok)
        return ok

    return F.coalesce(f.isNotNull() & F.forall(f["required"], lambda r: F.map_contains_key(args, r)) & F.forall(F.map_entries(args), typed), F.lit(False))


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """1 - C(n-c, k) / C(n, k) up to n = 100, the approximation beyond."""
    n, c = n.cast("double"), c.cast("double")
    product = F.aggregate(F.sequence(F.lit(0), k.cast("int") - 1), F.lit(1.0), lambda acc, i: acc * (n - c - i) / (n - i))
    exact = F.when(k > n - c, 1.0).otherwise(1 - product)
    return F.when((n == 0) | (c == 0) | (k <= 0), 0.0).when(c == n, 1.0).when(n <= 100, exact).otherwise(1 - F.pow(1 - c / n, k))


def pass_at_k_estimate(n: Column, c: Column, k: Column) -> Column:
    return F.when(n > 0, 1 - F.pow(1 - c / n, k)).otherwise(0.0)


def throughput(tokens: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, tokens / seconds).otherwise(0.0)


def gigabytes(n: Column) -> Column:
    return n / float(1 << 30)


def recommendation(avg: Column, throughput: Column, ttft: Column, memory: Column, benchmark: Column | None = None, speed: bool = False, small: bool = False) -> Column:
    """A model's composite score for a question."""
    out = 2 * avg + throughput - ttft / 30 - memory / 4
    out = out + 2.2 * benchmark if benchmark is not None else out
    out = out + 2 * throughput - ttft / 15 if speed else out
    return out - 1.2 * memory if small else out
