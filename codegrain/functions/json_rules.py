"""Strict JSON and JSON rules as column expressions over VARIANT: a text is parsed in the JVM, rules are compiled to expressions, no row goes through Python.

The parser refuses repeated keys, NaN, comments, single quotes and leading
zeros. It stops after the first value, though, so a text is parsed within
brackets and within braces: what follows a value could close one of them, never
both. Texts nested deeper than 1,000 levels, or beyond the size that Spark
allows a VARIANT, are faults like other invalid ones.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrain.functions.text import PLACEHOLDER, iso_date, iso_datetime


def value_of(text: Column) -> Column:
    """The VARIANT of a text that is one JSON value, null where it isn't or has a key twice."""
    held = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(listed.isNotNull(), F.try_variant_get(held, "$.v", "variant"))


def kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def object_fault(text: Column) -> Column:
    """What is wrong with the text of a JSON object, the first that holds; null if nothing is. A null text is blank."""
    return _object_fault(text, value_of(text))


def _object_fault(text: Column, value: Column) -> Column:
    return (
        F.when(text.isNull() | ~text.rlike(r"[^\s]"), "blank")
        .when(~F.is_valid_utf8(text), "not UTF-8")
        .when(text.startswith("﻿"), "byte order mark")
        .when(F.contains(text, F.lit("\r")), "carriage return")
        .when(value.isNull(), "invalid, or a key twice")
        .when(~kind_of(value).startswith("OBJECT"), "not an object")
    )


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is reckoned once; both give arrays."""
    return F.flatten(F.transform(F.array(value), body))


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _faults(*checks: tuple[Column, Column]) -> Column:
    """The messages of the conditions that hold."""
    return F.array_compact(F.array(*[F.when(wrong, message) for wrong, message in checks])) if checks else F.array().cast("array<string>")


_LONG = 2**63 - 1


def _integer(v: Column, t: Column) -> Column:
    """Whole numbers as JSON writes them: ``1.0`` is none. Beyond 64 bits, those of up to 38 digits."""
    wide = t.rlike(r"^DECIMAL\(\d+,0\)$") & (F.abs(F.try_variant_get(v, "$", "decimal(38,0)")) > F.lit(_LONG))
    return (t == "BIGINT") | wide


def _is(v: Column, t: Column, kind: str) -> Column:
    if kind == "integer":
        return _integer(v, t)
    if kind == "number":
        return (t == "BIGINT") | (t == "DOUBLE") | t.startswith("DECIMAL")
    if kind in ("object", "array"):
        return t.startswith(kind.upper())
    return t == {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}[kind]


def _equals(v: Column, t: Column, constant) -> Column:
    """Whether a value is a constant, of the same type; arrays and objects go by their canonical text."""
    if constant is None:
        return t == "VOID"
    if isinstance(constant, bool):
        return (t == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(constant))
    if isinstance(constant, str):
        return (t == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(constant))
    if isinstance(constant, int):
        return _integer(v, t) & (F.try_variant_get(v, "$", "decimal(38,0)") == F.lit(str(constant)).cast("decimal(38,0)"))
    if isinstance(constant, float):
        return _is(v, t, "number") & ~_integer(v, t) & (F.try_variant_get(v, "$", "double") == F.lit(constant))
    return F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(constant))))


def _object(v: Column, rules: dict, at: Column) -> Column:
    props, required = rules.get("properties", {}), rules.get("required", ())

    def body(m: Column) -> Column:
        field = lambda k: F.try_element_at(m, F.lit(k))
        parts = [_faults(*[(field(k).isNull(), _text(at, f": missing {k}")) for k in required])]
        if rules.get("additionalProperties") is False:
            extra = F.filter(F.map_keys(m), lambda k: ~k.isin(*props)) if props else F.map_keys(m)
            parts.append(F.transform(extra, lambda k: _text(at, ": extra ", k)))
        for k, own in props.items():
            parts.append(F.when(field(k).isNotNull(), _value(field(k), own, _text(at, f".{k}"))).otherwise(_faults()))
        return F.concat(*parts)

    return _bound(F.try_variant_get(v, "$", "map<string,variant>"), body)


def _array(v: Column, rules: dict, at: Column) -> Column:
    first, rest = rules.get("prefixItems", []), rules.get("items")

    def item(x: Column, i: Column) -> Column:
        place = _text(at, "[", i.cast("string"), "]")
        chosen = _value(x, rest, place) if rest else _faults()
        for n, own in reversed(list(enumerate(first))):
            chosen = F.when(i == n, _value(x, own, place)).otherwise(chosen)
        return chosen

    def body(a: Column) -> Column:
        checks = []
        if "minItems" in rules or "maxItems" in rules:
            outside = F.size(a) < rules.get("minItems", 0)
            outside = outside | (F.size(a) > rules["maxItems"]) if "maxItems" in rules else outside
            checks.append((outside, _text(at, ": ", F.size(a).cast("string"), " items")))
        if rules.get("uniqueItems"):
            told = F.transform(a, lambda x: F.concat(F.regexp_replace(kind_of(x), r"[(<].*", ""), F.lit(" "), F.to_json(x)))
            checks.append((F.size(F.array_distinct(told)) < F.size(a), _text(at, ": repeated item")))
        own = _faults(*checks)
        return F.concat(own, F.flatten(F.transform(a, item))) if first or rest else own

    return _bound(F.try_variant_get(v, "$", "array<variant>"), body)


def _string(v: Column, rules: dict, at: Column) -> Column:
    def body(s: Column) -> Column:
        checks = []
        if "minLength" in rules or "maxLength" in rules:
            outside = F.length(s) < rules.get("minLength", 0)
            outside = outside | (F.length(s) > rules["maxLength"]) if "maxLength" in rules else outside
            checks.append((outside, _text(at, ": length ", F.length(s).cast("string"))))
        if "pattern" in rules:
            checks.append((~s.rlike(rf"\A(?:{rules['pattern']})\z"), _text(at, ": pattern")))
        if rules.get("format") in ("date", "date-time"):
            holds = iso_date(s) if rules["format"] == "date" else iso_datetime(s)
            checks.append((~holds, _text(at, f": {rules['format']}")))
        return _faults(*checks)

    return _bound(F.try_variant_get(v, "$", "string"), body)


def _number(v: Column, t: Column, rules: dict, at: Column) -> Column:
    exact, near = F.try_variant_get(v, "$", "long"), F.try_variant_get(v, "$", "double")
    wrong = F.lit(False)
    for name, beyond in (("minimum", lambda x, n: x < F.lit(n)), ("maximum", lambda x, n: x > F.lit(n))):
        if name in rules:
            wrong = wrong | F.when(t == "BIGINT", beyond(exact, rules[name])).otherwise(beyond(near, float(rules[name])))
    return _faults((wrong, _text(at, ": range")))


_PARTS = {
    "object": ({"properties", "required", "additionalProperties"}, lambda v, t, r, at: _object(v, r, at)),
    "array": ({"items", "prefixItems", "minItems", "maxItems", "uniqueItems"}, lambda v, t, r, at: _array(v, r, at)),
    "string": ({"minLength", "maxLength", "pattern", "format"}, lambda v, t, r, at: _string(v, r, at)),
    "number": ({"minimum", "maximum"}, _number),
}
_OTHERS = {"type", "const", "enum", "$schema", "$id", "title", "description"}


def _value(v: Column, rules: dict, at: Column) -> Column:
    unknown = [(F.lit(True), _text(at, f": unknown keyword {k}")) for k in rules if k not in _OTHERS and not any(k in keys for keys, _ in _PARTS.values())]
    kind = rules.get("type")

    def body(x: Column, t: Column) -> Column:
        checks = []
        if "const" in rules:
            checks.append((~_equals(x, t, rules["const"]), _text(at, ": not the constant")))
        if "enum" in rules:
            one = F.lit(False)
            for e in rules["enum"]:
                one = one | _equals(x, t, e)
            checks.append((~one, _text(at, ": not one of the values")))
        parts = [_faults(*checks)]
        for name, (keys, make) in _PARTS.items():
            if keys & set(rules) and kind in (None, name, "integer" if name == "number" else name):
                parts.append(F.when(_is(x, t, name), make(x, t, rules, at)).otherwise(_faults()))
        rest = F.concat(*parts)
        return rest if kind is None else F.when(_is(x, t, kind), rest).otherwise(F.array(_text(at, f": not {kind}")))

    own = _bound(F.struct(v.alias("v"), kind_of(v).alias("t")), lambda n: body(n["v"], n["t"]))
    return F.concat(_faults(*unknown), own) if unknown else own


def rule_faults(v: Column, schema: dict) -> Column:
    """array<string>: where a VARIANT breaks a closed JSON-Schema subset; empty if it keeps it.

    The same faults, in another order, as validate.schema_errors(): booleans and
    ``1.0`` aren't integers, unknown keywords are faults. Patterns must mean the
    same to Java's and Python's expressions. A null gives null.
    """
    return F.when(v.isNotNull(), _value(v, schema, F.lit("$")))


def text_faults(text: Column, schema: dict) -> Column:
    """array<string>: what is wrong with a JSON object's text, or where its value breaks the schema."""
    parsed = F.struct(text.alias("x"), value_of(text).alias("v"))
    checked = lambda p: F.struct(_object_fault(p["x"], p["v"]).alias("wrong"), p["v"].alias("v"))
    told = lambda c: F.when(c["wrong"].isNotNull(), F.array(c["wrong"])).otherwise(_value(c["v"], schema, F.lit("$")))
    return _bound(parsed, lambda p: _bound(checked(p), told))


def places_of(df: DataFrame, key: str, v: str, stage, pattern: str = PLACEHOLDER) -> DataFrame:
    """key, place: where a nested value still holds a stand-in, found level by level; ``stage(df, name)`` writes a level and reads it back.

    As many rounds as the deepest value has levels, 1,000 at most.
    """
    spark, found, n = df.sparkSession, [], 0
    level = df.where(F.col(v).isNotNull()).select(key, F.lit("$").alias("place"), F.col(v).alias("v"))
    while True:
        level = stage(level.withColumn("t", kind_of(F.col("v"))), f"level_{n}")
        found.append(level.where((F.col("t") == "STRING") & F.try_variant_get("v", "$", "string").rlike(pattern)).select(key, "place"))
        inner = level.where(F.col("t").startswith("OBJECT") | F.col("t").startswith("ARRAY"))
        if inner.isEmpty():
            break
        below = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key").alias("_k"), F.col("value").alias("_v")))
        step = F.when(F.col("_k").isNotNull(), F.concat(F.lit("."), "_k")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level, n = below.select(key, F.concat("place", step).alias("place"), F.col("_v").alias("v")), n + 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
