"""JSON Schema as an expression over VARIANT: a schema is compiled once to SQL, values are checked in the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR = "struct<path:string,keyword:string,message:string,depth:int>"
#: Keywords that only describe.
NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "format", "definitions", "$defs", "readOnly", "writeOnly", "deprecated"}
#: Keywords of a choice between schemas: their errors say less than others at the same place.
CHOICES = ("anyOf", "oneOf")
KINDS = ("object", "array", "string", "integer", "number", "boolean", "null")
NONE = f"cast(array() as array<{ERROR}>)"


def quoted(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _get(v: str, key: str) -> str:
    """A field of an object, by any name; null where it is missing. A JSON null is a variant and not null."""
    if "'" in key and '"' in key:
        raise ValueError(f"a field name with both kinds of quotes: {key}")
    quote = '"' if "'" in key else "'"
    return f"try_variant_get({v}, {quoted(f'$[{quote}{key}{quote}]')}, 'variant')"


_fields = lambda v: f"try_variant_get({v}, '$', 'map<string,variant>')"
_elements = lambda v: f"try_variant_get({v}, '$', 'array<variant>')"
_number = lambda v: f"try_variant_get({v}, '$', 'double')"
_text = lambda v: f"try_variant_get({v}, '$', 'string')"


def _is(k: str, v: str, kind: str) -> str:
    """Whether a value of type text k is of a kind; 2.0 is an integer."""
    if kind not in KINDS:
        raise ValueError(f"unknown type {kind}")
    if kind in ("object", "array"):
        return f"startswith({k}, '{kind.upper()}')"
    if kind == "number":
        return f"not (startswith({k}, 'OBJECT') or startswith({k}, 'ARRAY') or {k} in ('STRING', 'BOOLEAN', 'VOID'))"
    if kind == "integer":
        return f"(startswith({k}, 'BIGINT') or {_is(k, v, 'number')} and {_number(v)} = floor({_number(v)}))"
    return f"{k} = '{ {'string': 'STRING', 'boolean': 'BOOLEAN', 'null': 'VOID'}[kind] }'"


def _equals(k: str, v: str, value: object) -> str:
    """Whether a value is this one: numbers by value, objects and arrays by their text with sorted keys."""
    if value is None:
        return _is(k, v, "null")
    if isinstance(value, bool):
        return f"({_is(k, v, 'boolean')} and try_variant_get({v}, '$', 'boolean') = {str(value).lower()})"
    if isinstance(value, (int, float)):
        return f"({_is(k, v, 'number')} and {_number(v)} = {float(value)!r}D)"
    if isinstance(value, str):
        return f"({_is(k, v, 'string')} and {_text(v)} = {quoted(value)})"
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return f"({_is(k, v, 'array' if isinstance(value, list) else 'object')} and to_json({v}) = {quoted(text)})"


class Compiler:
    """One schema as SQL; references go to places in it. Every value is bound to a name before its rules look at it, so that none of them computes it again."""

    def __init__(self, schema: object) -> None:
        self.root = schema
        self.names = count()

    def resolve(self, ref: str) -> object:
        if not ref.startswith("#"):
            raise ValueError(f"only references into the schema itself can be followed: {ref}")
        at: object = self.root
        for part in ref.lstrip("#").strip("/").split("/") if ref != "#" else []:
            part = part.replace("~1", "/").replace("~0", "~")
            if not isinstance(at, dict) or part not in at:
                raise ValueError(f"no such place in the schema: {ref}")
            at = at[part]
        return at

    def errors(self, v: str, schema: object, path: str = "'$'", depth: int = 0, refs: tuple[str, ...] = ()) -> str:
        """What of a value breaks a schema, in the schema's order; nothing of a null, which is a value that isn't there."""
        if schema is True or schema == {}:
            return NONE
        n = next(self.names)
        told = f"transform(filter(array({v}), f{n} -> f{n} is not null), w{n} -> struct(w{n} as v, schema_of_variant(w{n}) as k))"
        return f"flatten(transform({told}, s{n} -> {self._rules(f's{n}.v', f's{n}.k', schema, path, depth, refs)}))"

    def _rules(self, v: str, k: str, schema: object, path: str, depth: int, refs: tuple[str, ...]) -> str:
        def one(keyword: str, wrong: str, message: str) -> str:
            return f"case when {wrong} then array(cast(struct({path}, '{keyword}', {message}, {depth}) as {ERROR})) else {NONE} end"

        if schema is False:
            return one("false", "true", "'nothing is allowed here'")
        if not isinstance(schema, dict):
            raise ValueError(f"a schema is an object or a boolean: {schema!r}")
        inner = lambda value, s, where=path, down=0: self.errors(value, s, where, depth + down, refs)
        found: list[str] = []
        for keyword, given in schema.items():
            if keyword in NOTES or keyword == "additionalProperties":
                continue
            if keyword == "$ref":
                if given in refs:
                    raise ValueError(f"{given} refers to itself; a recursive schema has no expression of bounded size")
                found.append(self.errors(v, self.resolve(given), path, depth, (*refs, given)))
            elif keyword in LIMITS:
                kind, wrong, message = LIMITS[keyword]
                found.append(one(keyword, f"{_is(k, v, kind)} and {wrong(v, given)}", quoted(message.format(given))))
            elif (rule := getattr(self, f"_{keyword}", None)) and keyword in RULES:
                found.append(rule(v, k, given, path, one, inner))
            else:
                raise ValueError(f"keyword {keyword} is not supported")
        if "additionalProperties" in schema:
            found.append(self._additional(v, k, schema, path, one, inner))
        return f"concat({', '.join([NONE, *found])})"

    def _type(self, v, k, given, path, one, inner):
        names = given if isinstance(given, list) else [given]
        return one("type", f"not ({' or '.join(_is(k, v, n) for n in names)})", quoted(f"not of type {' or '.join(names)}"))

    def _enum(self, v, k, given, path, one, inner):
        return one("enum", f"not ({' or '.join(['false', *(_equals(k, v, x) for x in given)])})", quoted(f"not one of {given}"))

    def _const(self, v, k, given, path, one, inner):
        return one("const", f"not {_equals(k, v, given)}", quoted(f"not {json.dumps(given, ensure_ascii=False)}"))

    def _allOf(self, v, k, given, path, one, inner):
        return f"concat({', '.join([NONE, *(inner(v, s) for s in given)])})"

    def _anyOf(self, v, k, given, path, one, inner):
        return one("anyOf", " and ".join(f"size({inner(v, s)}) > 0" for s in given), "'fits none of the schemas given'")

    def _oneOf(self, v, k, given, path, one, inner):
        n = next(self.names)
        fitting = " + ".join(f"int(size({inner(v, s)}) = 0)" for s in given)
        wrong = one("oneOf", f"n{n} <> 1", f"case when n{n} = 0 then 'fits none of the schemas given' else 'fits more than one of the schemas given' end")
        return f"flatten(transform(array({fitting}), n{n} -> {wrong}))"

    def _not(self, v, k, given, path, one, inner):
        return one("not", f"size({inner(v, given)}) = 0", "'fits a schema that it must not fit'")

    def _required(self, v, k, given, path, one, inner):
        missing = [one("required", f"{_get(v, key)} is null", quoted(f"{key} is missing")) for key in given]
        return f"case when {_is(k, v, 'object')} then concat({', '.join([NONE, *missing])}) else {NONE} end"

    def _properties(self, v, k, given, path, one, inner):
        held = [inner(_get(v, key), s, f"concat({path}, {quoted(f'.{key}')})", 1) for key, s in given.items()]
        return f"case when {_is(k, v, 'object')} then concat({', '.join([NONE, *held])}) else {NONE} end"

    def _additional(self, v, k, schema, path, one, inner):
        n = next(self.names)
        known = ", ".join(quoted(key) for key in schema.get("properties", {}))
        more = f"map_entries({_fields(v)})"
        more = f"filter({more}, m{n} -> m{n}.key not in ({known}))" if known else more
        given = schema["additionalProperties"]
        if given is False:
            wrong = one("additionalProperties", f"size(a{n}) > 0", f"concat(array_join(transform(a{n}, e{n} -> e{n}.key), ', '), ' not expected')")
            return f"case when {_is(k, v, 'object')} then flatten(transform(array({more}), a{n} -> {wrong})) else {NONE} end"
        each = inner(f"e{n}.value", given, f"concat({path}, '.', e{n}.key)", 1)
        return f"case when {_is(k, v, 'object')} then flatten(transform({more}, e{n} -> {each})) else {NONE} end"

    def _items(self, v, k, given, path, one, inner):
        if isinstance(given, list):
            raise ValueError("items must be one schema")
        n = next(self.names)
        each = inner(f"x{n}", given, f"concat({path}, '[', i{n}, ']')", 1)
        return f"case when {_is(k, v, 'array')} then flatten(transform({_elements(v)}, (x{n}, i{n}) -> {each})) else {NONE} end"

    def _uniqueItems(self, v, k, given, path, one, inner):
        if not given:
            return NONE
        n = next(self.names)
        wrong = one("uniqueItems", f"size(array_distinct(t{n})) < size(t{n})", "'items that repeat'")
        return f"case when {_is(k, v, 'array')} then flatten(transform(array(transform({_elements(v)}, y{n} -> to_json(y{n}))), t{n} -> {wrong})) else {NONE} end"


#: Keyword to the kind of value that it limits, when it is broken, and what is said then.
LIMITS: dict[str, tuple[str, Callable[[str, object], str], str]] = {
    "minProperties": ("object", lambda v, x: f"size({_fields(v)}) < {int(x)}", "fewer than {} fields"),
    "maxProperties": ("object", lambda v, x: f"size({_fields(v)}) > {int(x)}", "more than {} fields"),
    "minItems": ("array", lambda v, x: f"size({_elements(v)}) < {int(x)}", "fewer than {} items"),
    "maxItems": ("array", lambda v, x: f"size({_elements(v)}) > {int(x)}", "more than {} items"),
    "pattern": ("string", lambda v, x: f"not rlike({_text(v)}, {quoted(x)})", "does not match {}"),
    "minLength": ("string", lambda v, x: f"char_length({_text(v)}) < {int(x)}", "shorter than {}"),
    "maxLength": ("string", lambda v, x: f"char_length({_text(v)}) > {int(x)}", "longer than {}"),
    "minimum": ("number", lambda v, x: f"{_number(v)} < {float(x)!r}D", "less than {}"),
    "maximum": ("number", lambda v, x: f"{_number(v)} > {float(x)!r}D", "more than {}"),
    "exclusiveMinimum": ("number", lambda v, x: f"{_number(v)} <= {float(x)!r}D", "not more than {}"),
    "exclusiveMaximum": ("number", lambda v, x: f"{_number(v)} >= {float(x)!r}D", "not less than {}"),
    "multipleOf": ("number", lambda v, x: f"{_number(v)} / {float(x)!r}D <> round({_number(v)} / {float(x)!r}D)", "not a multiple of {}"),
}
#: The other keywords that assert something, but for $ref and additionalProperties.
RULES = {"type", "enum", "const", "allOf", "anyOf", "oneOf", "not", "required", "properties", "items", "uniqueItems"}


def _each(value: Column, name: str, body: str) -> Column:
    """body over a value that is bound to a name; null for a null."""
    held = F.filter(F.array(value), lambda x: x.isNotNull())
    return F.try_element_at(F.call_function("transform", held, F.expr(f"{name} -> {body}")), F.lit(1))


def errors(value: Column, schema: dict | bool) -> Column:
    """All that a VARIANT breaks of a schema: array<struct(path, keyword, message, depth)>, in the schema's order; null for a null.

    Draft 7's type, enum, const, allOf, anyOf, oneOf, not, required, properties, additionalProperties, items (one schema) and limits
    of numbers, texts, arrays and objects, and references into the schema that aren't recursive. Any other keyword that asserts something is an error here, so no
    rule is passed over in silence.
    """
    return _each(value, "value", Compiler(schema).errors("value", schema))


def best(found: Column) -> Column:
    """The one error that says most: the shallowest, of these one that isn't about a choice of schemas, of these the first. Null without errors."""
    keyed = F.transform(found, lambda e, i: F.struct(e["depth"].alias("d"), e["keyword"].isin(*CHOICES).alias("weak"), i.alias("i"), e.alias("e")))
    return F.try_element_at(F.array_sort(keyed), F.lit(1))["e"]


def text_of(error: Column) -> Column:
    return F.concat(error["path"], F.lit(": "), error["message"])


def told(found: Column) -> Column:
    """The best error as path: message; null without errors."""
    return F.try_element_at(F.transform(F.filter(F.array(best(found)), lambda e: e.isNotNull()), text_of), F.lit(1))


def validate(c: Column, schema: dict | bool | None) -> Column:
    """struct(is_valid, error) of JSON texts: error is the best one as path: message, or says that it is no JSON. Without a schema all are valid."""
    if schema is None:
        return F.struct(F.lit(True).alias("is_valid"), F.lit(None).cast("string").alias("error"))
    found = F.array(F.struct(errors(F.try_parse_json(F.coalesce(c, F.lit(""))), schema).alias("found")))
    error = lambda s: F.when(s["found"].isNull(), "not JSON").otherwise(told(s["found"]))
    out = F.transform(F.transform(found, error), lambda e: F.struct(e.isNull().alias("is_valid"), e.alias("error")))
    return F.try_element_at(out, F.lit(1))
