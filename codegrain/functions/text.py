"""Text and byte functions: column expressions where the JVM has them, Arrow UDFs where a scan is needed."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: White space as str.split() sees it, in Java's and RE2's notation.
JAVA_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
UNDEFINED_CP1252 = b"\x81\x8d\x8f\x90\x9d"


def byte_length(col: Column) -> Column:
    """UTF-8 bytes, the unit of every budget."""
    return F.octet_length(col).cast("long")


def collapse_space(col: Column) -> Column:
    """White space runs become one blank; none at the ends."""
    return F.trim(F.regexp_replace(col, JAVA_SPACE, " "))


def hex_id(prefix: str, *parts: Column, digits: int = 24) -> Column:
    """A content-addressed id: prefix and the first digits of the sha256 of the NUL-joined parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, digits))


def canonical_json(**fields: Column) -> Column:
    """JSON of the fields, keys sorted, no blanks, nulls written."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def blob_oid(raw: Column) -> Column:
    """The id that git gives a blob of these bytes."""
    raw = raw.cast("binary")
    return F.sha1(F.concat(F.lit("blob ").cast("binary"), F.octet_length(raw).cast("string").cast("binary"), F.unhex(F.lit("00")), raw))


def extension(path: Column) -> Column:
    """From the last dot of the last part, with the dot; empty without one."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def path_valid(path: Column) -> Column:
    """Relative, with forward slashes, without parent references."""
    return (F.length(path) > 0) & ~path.rlike(r"^[/\\]|\\") & ~F.array_contains(F.split(path, "/"), "..")


def windows_of(text: str, cap: int) -> list[tuple[int, int, int, int]]:
    """Greedy windows (first and end byte, first and end character) of at most ``cap`` bytes that rebuild the text.

    A window ends after its last newline if it has one and isn't the last;
    otherwise at a character's boundary. A character above ``cap`` is an error.
    """
    raw, out, at, char = text.encode(), [], 0, 0
    while at < len(raw):
        end = at + cap
        if end < len(raw):
            while end > at and raw[end] & 0xC0 == 0x80:
                end -= 1
            if end == at:
                raise ValueError(f"a character is larger than {cap} bytes")
            newline = raw.rfind(b"\n", at, end)
            end = newline + 1 if newline >= 0 else end
        else:
            end = len(raw)
        n = len(raw[at:end].decode())
        out.append((at, end, char, char + n))
        at, char = end, char + n
    return out


def line_windows(cap: int):
    """An Arrow UDF: text to an array of (start_byte, end_byte, start_char, end_char)."""

    @F.pandas_udf("array<struct<start_byte:long,end_byte:long,start_char:long,end_char:long>>")
    def run(texts: pd.Series) -> pd.Series:
        names = ("start_byte", "end_byte", "start_char", "end_char")
        return texts.map(lambda t: [dict(zip(names, w)) for w in windows_of(t or "", cap)])

    return run


def decode(raw: bytes | None) -> tuple[str | None, str | None, str | None]:
    """(text, encoding, error): UTF-8 if valid, else cp1252; NUL and undefined bytes are errors."""
    if raw is None:
        return None, None, "missing"
    if b"\0" in raw:
        return None, None, "nul_byte"
    try:
        return raw.decode("utf-8"), "utf-8", None
    except UnicodeDecodeError:
        pass
    try:
        return raw.decode("cp1252"), "cp1252", None
    except UnicodeDecodeError:
        return None, None, "undecodable"


#: Where cp1252 differs from Latin-1; the five bytes that it leaves open, which decode() refuses, stay as they are.
_CP1252 = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")}


def from_cp1252(raw: Column) -> Column:
    """Bytes of a text that decode() found to be cp1252, decoded in the JVM."""
    return F.translate(F.decode(raw, "ISO-8859-1"), "".join(_CP1252), "".join(_CP1252.values()))


def decode_bytes():
    """An Arrow UDF: bytes to text, with the encoding that fitted or the reason why none did."""

    @F.pandas_udf("struct<text:string,encoding:string,error:string>")
    def run(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode(None if r is None else bytes(r)) for r in raw], columns=["text", "encoding", "error"])

    return run


def byte_prefix(text: str, cap: int) -> str:
    """As many whole characters as fit in ``cap`` bytes."""
    return text.encode()[:cap].decode(errors="ignore")


def prefix_within(col: Column, cap: int) -> Column:
    """As many whole characters as fit in ``cap`` bytes, as an expression: of the first ``cap`` characters those whose bytes fit."""
    cut = F.substring(col, 1, cap)
    keep = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(cut), F.lit(1))), lambda i: F.octet_length(F.substring(cut, F.lit(1), i)) <= cap))
    return F.when(F.octet_length(col) <= cap, col).otherwise(F.substring(cut, F.lit(1), keep))


def normalized(cap: int):
    """An Arrow UDF: text to (collapsed prefix of at most ``cap`` bytes, whether it was cut)."""

    @F.pandas_udf("struct<prefix:string,truncated:boolean>")
    def run(texts: pd.Series) -> pd.DataFrame:
        full = [" ".join((t or "").split()) for t in texts]
        cut = [byte_prefix(t, cap) for t in full]
        return pd.DataFrame({"prefix": cut, "truncated": [a != b for a, b in zip(full, cut)]})

    return run


# ---------------------------------------------------------------- strict JSON


def _no_repeats(pairs):
    out = {}
    for k, v in pairs:
        if k in out:
            raise ValueError(f"key {k!r} twice")
        out[k] = v
    return out


def _no_constants(name):
    raise ValueError(f"{name} is not JSON")


def dump_canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":"))


def strict_json(text: str | None, canonical: bool = False) -> str | None:
    """What is wrong with a JSON object's text; None if nothing is."""
    if text is None or not text.strip():
        return "blank"
    if text.startswith("﻿"):
        return "byte order mark"
    if "\r" in text:
        return "carriage return"
    try:
        value = json.loads(text, object_pairs_hook=_no_repeats, parse_constant=_no_constants)
    except (ValueError, RecursionError) as e:
        return f"invalid: {e}"[:120]
    if not isinstance(value, dict):
        return "not an object"
    if canonical and dump_canonical(value) != text:
        return "not canonical"
    return None


def json_error(canonical: bool = False):
    """An Arrow UDF: why a line isn't a strict JSON object, null if it is one."""

    @F.pandas_udf("string")
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: strict_json(x, canonical))

    return run


PLACEHOLDER = r"(?i)\b(todo|tbd|fixme|placeholder|lorem ipsum|changeme|your[-_ ]\w+[-_ ]here)\b|<[a-z_ ]*(insert|fill)[a-z_ ]*>"


def placeholder(col: Column, pattern: str = PLACEHOLDER) -> Column:
    """Whether a text still holds a stand-in."""
    return F.coalesce(col.rlike(pattern), F.lit(False))


def placeholders(value, pattern: str = PLACEHOLDER, at: str = "$") -> list[str]:
    """Where a nested value of objects, arrays and texts still holds a stand-in."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in placeholders(v, pattern, f"{at}.{k}")]
    if isinstance(value, (list, tuple)):
        return [x for i, v in enumerate(value) for x in placeholders(v, pattern, f"{at}[{i}]")]
    return [at] if isinstance(value, str) and re.search(pattern, value) else []


_DATE, _TIME = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})"


def is_iso_date(text: str) -> bool:
    """A whole date of the calendar, as YYYY-MM-DD."""
    return bool(re.fullmatch(_DATE, text, re.ASCII)) and not pd.isna(pd.to_datetime(text, format="%Y-%m-%d", errors="coerce"))


def iso_date(col: Column) -> Column:
    """Whether a text is a whole date of the calendar, as YYYY-MM-DD; the same as is_iso_date(), in the JVM."""
    return F.coalesce(col.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_timestamp(col, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def is_iso_datetime(text: str) -> bool:
    """A date, a time of day with seconds, and an offset or Z."""
    if not re.fullmatch(f"{_DATE}T{_TIME}", text, re.ASCII):
        return False
    return not pd.isna(pd.to_datetime(text, format="ISO8601", errors="coerce", utc=True))


def iso_datetime(col: Column) -> Column:
    """Whether a text is a date, a time of day with seconds, and an offset or Z; in the JVM."""
    clock = r"^[0-9-]{10}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])\z"
    return iso_date(F.substring(col, 1, 10)) & col.rlike(clock)


def register(spark: SparkSession, cap: int = 3000) -> None:
    """Make the scanning functions callable from SQL."""
    spark.udf.register("line_windows", line_windows(cap))
    spark.udf.register("normalize_text", normalized(cap))
    spark.udf.register("strict_json", json_error())
    spark.udf.register("canonical_json", json_error(True))
    spark.udf.register("decode_bytes", decode_bytes())
