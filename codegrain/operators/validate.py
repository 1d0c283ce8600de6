"""Checks that give the rows that fail."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrain.functions.text import is_iso_date, is_iso_datetime

KEYWORDS = {"type", "const", "enum", "properties", "required", "additionalProperties", "items", "prefixItems", "minItems", "maxItems", "uniqueItems", "minimum", "maximum", "minLength", "maxLength", "pattern", "format", "$schema", "$id", "title", "description"}
_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        return not isinstance(value, bool) and isinstance(value, int if kind == "integer" else (int, float))
    return isinstance(value, _TYPES[kind])


def _same(a, b) -> bool:
    return type(a) is type(b) and a == b


def schema_errors(value, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a closed JSON-Schema subset; booleans aren't integers, unknown keywords are errors."""
    out = [f"{at}: unknown keyword {k}" for k in schema if k not in KEYWORDS]
    kind = schema.get("type")
    if kind is not None and not _is(value, kind):
        return [*out, f"{at}: not {kind}"]
    if "const" in schema and not _same(value, schema["const"]):
        out.append(f"{at}: not the constant")
    if "enum" in schema and not any(_same(value, e) for e in schema["enum"]):
        out.append(f"{at}: not one of the values")
    if isinstance(value, dict):
        props = schema.get("properties", {})
        out += [f"{at}: missing {k}" for k in schema.get("required", ()) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}: extra {k}" for k in value if k not in props]
        for k in value:
            if k in props:
                out += schema_errors(value[k], props[k], f"{at}.{k}")
    elif isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            out.append(f"{at}: {len(value)} items")
        if schema.get("uniqueItems") and any(_same(a, b) for i, a in enumerate(value) for b in value[:i]):
            out.append(f"{at}: repeated item")
        first = schema.get("prefixItems", [])
        for i, v in enumerate(value):
            own = first[i] if i < len(first) else schema.get("items")
            out += schema_errors(v, own, f"{at}[{i}]") if own else []
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            out.append(f"{at}: length {len(value)}")
        if "pattern" in schema and not re.fullmatch(schema["pattern"], value):
            out.append(f"{at}: pattern")
        if not {"date": is_iso_date, "date-time": is_iso_datetime}.get(schema.get("format"), lambda v: True)(value):
            out.append(f"{at}: {schema['format']}")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{at}: range")
    return out


def contract_errors(schema: dict, at: str = "$") -> list[str]:
    """Where a schema isn't closed and sane: one type each, objects that list all their fields and take no others, ordered bounds."""
    out = [f"{at}: unknown keyword {k}" for k in schema if k not in KEYWORDS]
    kind = schema.get("type")
    if kind is not None and not isinstance(kind, str):
        out.append(f"{at}: several types")
    if kind == "object":
        if schema.get("additionalProperties") is not False:
            out.append(f"{at}: open object")
        if set(schema.get("required", ())) - set(schema.get("properties", {})):
            out.append(f"{at}: required field without a schema")
        for k, s in schema.get("properties", {}).items():
            out += contract_errors(s, f"{at}.{k}")
    if kind == "array" and isinstance(schema.get("items"), dict):
        out += contract_errors(schema["items"], f"{at}[]")
    for lo, hi in (("minItems", "maxItems"), ("minLength", "maxLength"), ("minimum", "maximum")):
        if lo in schema and hi in schema and schema[lo] > schema[hi]:
            out.append(f"{at}: {lo} above {hi}")
    return out


def cap_gate(sizes: dict[str, tuple[Column, int]], total_cap: int) -> tuple[Column, Column]:
    """(total bytes, first component over its cap, "total" for the sum, null if all fit)."""
    total = sum((c for c, _ in sizes.values()), F.lit(0).cast("long"))
    fault = None
    for name, (c, cap) in sizes.items():
        fault = F.when(c > cap, name) if fault is None else fault.when(c > cap, name)
    return total, fault.when(total > total_cap, "total")


def request_faults(parts: list[tuple[str, str]], caps: dict[str, int], total_cap: int) -> list[str]:
    """Why a request can't be sent: its components in another order than the caps', over their caps in bytes, or too large together."""
    names = [name for name, _ in parts]
    out = [] if names == [n for n in caps if n in names] and set(names) <= set(caps) else [f"components {names}"]
    sizes = {name: len(text.encode()) for name, text in parts}
    out += [f"{name}: {n} of {caps[name]}" for name, n in sizes.items() if n > caps.get(name, n)]
    return out + ([f"total: {sum(sizes.values())} of {total_cap}"] if sum(sizes.values()) > total_cap else [])


def repeated_ids(df: DataFrame, *id_cols: str) -> DataFrame:
    return df.groupBy(*id_cols).agg(F.count("*").alias("n")).where("n > 1")


def dangling(child: DataFrame, ref: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference names nothing."""
    return child.join(parent.select(F.col(key).alias("_k")).distinct(), F.col(ref) == F.col("_k"), "left_anti")


def exactly_once(listed: DataFrame, item: str, whole: DataFrame, key: str) -> DataFrame:
    """One row: items listed several times, unknown ones, and ones that no list has."""
    n = listed.groupBy(F.col(item).alias("_i")).agg(F.count("*").alias("_n"))
    both = n.join(whole.select(F.col(key).alias("_k")).distinct(), F.col("_i") == F.col("_k"), "full")
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return both.agg(one(F.col("_n") > 1).alias("n_repeated"), one(F.col("_k").isNull()).alias("n_unknown"), one(F.col("_i").isNull()).alias("n_missing"))
