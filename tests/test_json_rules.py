"""Rules over VARIANT against the plain walk, strict lines with their places, and stand-ins in nested values."""

import gzip
import json
import random
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from codegrain.functions import json_rules as jr
from codegrain.functions import text as fn
from codegrain.operators import validate
from codegrain.sources import records
from codegrain.sources.staging import staged

SCHEMA = {
    "type": "object",
    "properties": {
        "n": {"type": "integer", "minimum": -3, "maximum": 5},
        "x": {"type": "number", "minimum": 0.5},
        "s": {"type": "string", "minLength": 1, "maxLength": 4, "pattern": "[a-dé]+"},
        "e": {"enum": ["a", 1, None, True, 1.5]},
        "c": {"const": 2},
        "d": {"type": "string", "format": "date"},
        "w": {"type": "string", "format": "date-time"},
        "l": {"type": "array", "items": {"type": "object", "properties": {"k": {"type": "string"}, "o'd \"k": {"type": "null"}}, "required": ["k"], "additionalProperties": False}, "minItems": 1, "maxItems": 3, "uniqueItems": True},
        "p": {"type": "array", "prefixItems": [{"type": "integer"}, {"type": "boolean"}], "items": {"type": "string"}},
        "any": {"maxLength": 2, "minItems": 2, "maximum": 7},
    },
    "required": ["n", "s"],
    "additionalProperties": False,
}


def _scalar(rng):
    return rng.choice([0, 1, 2, -4, 6, 1.0, 1.5, 0.25, True, False, None, "", "a", "abcd", "abcde", "é", "zz", "2024-02-30", "2024-02-29", "2024-02-29T10:00:00Z", "2024-02-29T25:00:00Z", "2024-01-01T00:00:00.5+01:00", 12345678901234567890, 1e30, 2])


def _any(rng, depth=0):
    r = rng.random()
    if depth < 3 and r < 0.25:
        return [_any(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    if depth < 3 and r < 0.45:
        return {rng.choice(["k", "o'd \"k", "z", "n"]): _any(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    return _scalar(rng)


def test_rules_equal_the_plain_walk(spark):
    rng = random.Random(5)
    values = [{k: _any(rng) for k in rng.sample([*SCHEMA["properties"], "q"], rng.randint(0, 8))} for _ in range(3000)]
    values += [{"n": 1, "s": "ab", "l": [{"k": "a"}, {"k": "b", "o'd \"k": None}], "p": [1, True, "x"]}, {"n": 1, "s": "a", "l": [{"k": "a"}, {"k": "a"}]}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i long, text string").repartition(4)
    got = {r.i: sorted(r.f) for r in df.select("i", jr.text_faults(F.col("text"), SCHEMA).alias("f")).collect()}
    for i, v in enumerate(values):
        assert got[i] == sorted(validate.schema_errors(v, SCHEMA)), v
    assert got[3000] == [] and got[3001] == ["$.l: repeated item"]
    unknown = df.limit(1).select(jr.text_faults(F.col("text"), {"type": "object", "oneOf": []}).alias("f")).first().f
    assert unknown == ["$: unknown keyword oneOf"]


def test_plain_values_of_any_type(spark):
    texts = ["1", "1.0", '"x"', "null", "true", "[]", "{}", "12345678901234567890", "1e2", '["a",1]']
    df = spark.createDataFrame([(x,) for x in [*texts, None]], "x string")
    for schema in ({"type": "integer"}, {"type": "number", "maximum": 50}, {"const": [ "a", 1]}, {"const": 1}, {"enum": [1.0]}, {"type": "null"}, {"type": "array", "minItems": 1}):
        got = {r.x: r.f for r in df.select("x", jr.rule_faults(jr.value_of(F.col("x")), schema).alias("f")).collect()}
        assert got.pop(None) is None
        assert got == {x: validate.schema_errors(json.loads(x), schema) for x in texts}, schema


STRICT = [
    '{"a":1}', ' {"a":1} ', '{"a":1,"a":2}', '{"a":{"b":1,"b":1}}', '{"a":NaN}', '{"a":-Infinity}', '{"a":1} x', '{"a":1}{"a":1}', '{"a":1}]', '{"a":1}}', '{"a":1},', '{"a":1},{"b":1}', '{"a":1},"k":1', '{"a":1}],"v":[',
    "[1]", "1", '"x"', "null", "", "  ", '﻿{"a":1}', '{"a":1}\r', '{"a":01}', "{'a':1}", '{"a":1,}', '{"a":/**/1}', '{"a":"x\ty"}', '{"\\u0061":1,"a":1}', '{"a":"\\ud83d\\ude00"}', '{"a":1e5}', "{a:1}", "{}", "nul", '{"a":tru}',
]


def test_strict_texts_equal_the_plain_parser(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*STRICT, None])], "i int, x string")
    got = {r.i: r.f for r in df.select("i", jr.object_fault(F.col("x")).alias("f")).collect()}
    for i, x in enumerate([*STRICT, None]):
        plain = fn.strict_json(x)
        plain = "invalid, or a key twice" if plain and plain.startswith("invalid") else plain
        assert got[i] == plain, x


def test_lines_keep_file_and_place_over_many_splits(spark, tmp_path):
    rng = random.Random(2)
    bad = {}
    for name in ("a.jsonl", "b.jsonl"):
        lines = []
        for n in range(1, 20001):
            line = json.dumps({"n": n, "t": "é" * rng.randint(0, 40)}, ensure_ascii=False).encode()
            if rng.random() < 0.002:
                line = rng.choice([b'{"n":1,"n":2}', b"", b'{"n":1}\r', b'{"n":"\xff\xfe"}', b'{"n":NaN}', b"\xef\xbb\xbf{}"])
                bad[name, n] = line
            lines.append(line)
        (tmp_path / name).write_bytes(b"\n".join(lines) + b"\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        assert spark.read.text(str(tmp_path), lineSep="\n").rdd.getNumPartitions() > 8
        rows = records.faults(spark, str(tmp_path)).collect()
        assert {(r.file.rsplit("/", 1)[1], r.line) for r in rows} == set(bad)
        assert {r.fault for r in rows} == {"invalid, or a key twice", "blank", "carriage return", "not UTF-8", "byte order mark"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.jsonl").write_bytes(b"")
    assert records.faults(spark, str(tmp_path / "none")).count() == 0


def test_byte_order_mark_at_the_start_of_a_file(spark, tmp_path):
    """The reader of lines drops it there, and only there."""
    mark = b"\xef\xbb\xbf"
    files = {"a.jsonl": mark + b'{"n":1}\n{"n":2}\n' + mark + b"{}\n", "b.jsonl": b'{"n":1}\n', "c d.jsonl": mark, "e.jsonl": mark + b"\n{}\n", "f.jsonl": mark + b'{"n":"\xff"}\n{"n":1', "g.jsonl.gz": gzip.compress(mark + b'{"n":1}\n{"n":2}\n')}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    got = {(unquote(r.file.rsplit("/", 1)[1]), r.line, r.fault) for r in records.faults(spark, str(tmp_path)).collect()}
    mark = "byte order mark"
    assert got == {("a.jsonl", 1, mark), ("a.jsonl", 3, mark), ("c d.jsonl", 1, mark), ("e.jsonl", 1, mark), ("f.jsonl", 1, "not UTF-8"), ("f.jsonl", 2, "invalid, or a key twice"), ("g.jsonl.gz", 1, mark)}
    assert records.read_strict(spark, str(tmp_path / "b.jsonl"), "n long").count() == 1
    with pytest.raises(Exception, match="byte order mark"):
        records.read_strict(spark, str(tmp_path / "g.jsonl.gz"), "n long").collect()


def test_places_of_stand_ins(spark):
    values = [{"a": ["x", {"b": "TODO"}], "c": "fine"}, {"a": {"a": {"a": {"a": ["tbd", "\nfixme"]}}}}, {}, {"TODO": 1}, "placeholder", [[["lorem ipsum"]]]]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(99, None)], "i int, x string").select("i", jr.value_of(F.col("x")).alias("v"))
    got = {(r.i, r.place) for r in jr.places_of(df, "i", "v", staged).collect()}
    assert got == {(i, p) for i, v in enumerate(values) for p in fn.placeholders(v)}


def test_many_rules_stay_in_the_jvm(spark):
    plan = spark.range(5).select(jr.text_faults(F.lit('{"n":1}'), SCHEMA).alias("f"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("text,holds", [("2024-02-29T23:59:59Z", True), ("2023-02-29T00:00:00Z", False), ("2024-01-01T24:00:00Z", False), ("2024-01-01T00:00:00", False), ("2024-01-01T00:00:00.123-23:59", True), ("2024-01-01T00:00:00Z\n", False)])
def test_date_times(spark, text, holds):
    assert spark.range(1).select(fn.iso_datetime(F.lit(text))).first()[0] is holds and fn.is_iso_datetime(text) is holds


def test_rules_of_events_run_on_all_cores(spark, sf_dir):
    """However few pieces the file has."""
    import __spark_entry__

    assert __spark_entry__.queries()["json_rules"](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
