"""Function calls in JSON text: their forms, and their match with what is expected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jsons

_ANY = "map<string,variant>"


def _of(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body of c, where c is computed once however often body uses it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def _object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def _list(v: Column) -> Column:
    """The elements of a list, or an object alone; null for anything else."""
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), _of(v, "$", "array<variant>")).when(_object(v), F.array(v))


def canonical(v: Column) -> Column:
    """A JSON value as a text that equal values share: numbers by value, with true as 1, and anything else as JSON."""

    def text(kind: Column) -> Column:
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        return F.when(number, _of(v, "$", "double").cast("string")).when(kind == "BOOLEAN", _of(v, "$", "boolean").cast("double").cast("string")).otherwise(F.to_json(v))

    return _let(F.schema_of_variant(v), text)


def _call(v: Column) -> Column:
    """struct(name, args) of a call object in any of its forms; null of anything else."""
    m = _of(v, "$", _ANY)
    has = lambda k: F.map_contains_key(m, k)
    form = lambda name, args: F.struct(F.coalesce(_of(m[name], "$", "string"), F.to_json(m[name])).alias("name"), m[args].alias("args"))
    only = F.map_keys(m)[0]
    alone = F.struct(only.alias("name"), F.map_values(m)[0].alias("args"))
    found = F.when(has("name") & has("arguments"), form("name", "arguments")).when(has("function") & has("arguments"), form("function", "arguments"))
    return found.when(has("name") & has("args"), form("name", "args")).when(F.size(m) == 1, alone)


def parse(c: Column, named: bool = True) -> Column:
    """array<struct(name, args map<string, variant>)> of the calls in a text.

    named: the text may hold JSON among other text, calls may have any of their forms, and what is no call goes; no JSON gives
    an empty array. Otherwise the text must be JSON, calls have name and arguments, others count as calls without a name, and a
    text that is no list or object gives null.
    """
    value = lambda text: F.when(jsons.shaped(text), F.try_parse_json(text))
    if named:
        found = _let(_let(jsons.extract(c), value), lambda v: F.filter(F.transform(F.filter(_list(v), _object), _call), lambda x: x.isNotNull()))
        shaped = F.transform(found, lambda x: F.struct(x["name"].alias("name"), _of(x["args"], "$", _ANY).alias("args")))
        return F.coalesce(shaped, F.array().cast(f"array<struct<name:string,args:{_ANY}>>"))
    return _let(value(c), _unnamed)


def _unnamed(v: Column) -> Column:
    return F.transform(_list(v), lambda x: F.struct(_of(x, "$.name", "string").alias("name"), _of(x, "$.arguments", _ANY).alias("args")))


def _entries(v: Column) -> Column:
    """The fields of the objects in a list, one after another."""
    items = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.filter(_of(v, "$", "array<variant>"), _object))
    return F.flatten(F.transform(items, lambda x: F.map_entries(_of(x, "$", _ANY))))


def _last(pairs: Column) -> Column:
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.transform(last, lambda p: F.struct(p["key"].alias("name"), _of(p["value"], "$", _ANY).alias("params")))


def expected(c: Column) -> Column:
    """array<struct(name, params map<string, variant>)> of a reference in JSON: a list of objects by function name; of one function the last counts."""
    return _let(_entries(F.try_parse_json(c)), _last)


def match(found: Column, wanted: Column) -> Column:
    """The share of found calls that are right.

    A call is right if its name is wanted and each wanted parameter is there with one of its valid values, or equal to its value if that
    is no list. Other parameters and calls that are missing don't matter. No list, no call and no reference score 0.
    """

    def held(call: Column, p: Column) -> Column:
        own = F.try_element_at(call["args"], p["key"])
        valid = F.when(F.schema_of_variant(p["value"]).startswith("ARRAY"), F.transform(_of(p["value"], "$", "array<variant>"), canonical)).otherwise(F.array(canonical(p["value"])))
        return F.coalesce(F.array_contains(valid, canonical(own)), F.lit(False))

    def right(call: Column) -> Column:
        one = F.try_element_at(F.filter(wanted, lambda w: w["name"] == call["name"]), F.lit(1))
        return F.coalesce(F.forall(F.map_entries(one["params"]), lambda p: held(call, p)), F.lit(False))

    return F.when((F.size(found) > 0) & (F.size(wanted) > 0), F.size(F.filter(found, right)) / F.size(found)).otherwise(0.0)


def with_match(df: DataFrame, content: Column, reference: Column, name: str) -> DataFrame:
    """df with the match of a content's calls (parse without named) and a reference's, each text parsed once a row and each step a column of its own."""
    df = df.withColumns({"x_found": F.when(jsons.shaped(content), F.try_parse_json(content)), "x_pairs": F.try_parse_json(reference)})
    df = df.withColumns({"x_found": _unnamed(F.col("x_found")), "x_pairs": _entries(F.col("x_pairs"))})
    df = df.withColumn("x_wanted", F.when(F.size("x_found") > 0, _last(F.col("x_pairs"))))
    return df.withColumn(name, match(F.col("x_found"), F.col("x_wanted"))).drop("x_found", "x_pairs", "x_wanted")
