import json
import subprocess

import pytest
from pyspark.sql import functions as F

from codegrain.functions import text as fn
from codegrain.operators import chunks as ch
from codegrain.operators import rollup, scoring, validate, workflow
from codegrain.sources import git, records
from codegrain.streaming import telemetry


def test_git_tree_and_blobs(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.c").write_bytes(b"int x;\n")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "é.h").write_bytes(b"\xff\x00")
    run("add", "-A")
    run("-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "t")
    (tmp_path / "a.c").write_bytes(b"changed after the commit")
    git.register(spark)
    tree = spark.read.format("git_tree").option("repository", str(tmp_path)).load()
    got = {r.path: bytes(r.raw) for r in git.with_blobs(tree, str(tmp_path), 2).collect()}
    assert got == {"a.c": b"int x;\n", "d/é.h": b"\xff\x00"}
    oid = tree.where("path = 'a.c'").first().git_blob_oid
    assert oid == git.blob_oid(b"int x;\n") == spark.range(1).select(fn.blob_oid(F.lit("int x;\n"))).first()[0]
    with pytest.raises(ValueError):
        git.BlobReader(str(tmp_path)).read(oid, 3)


def test_strict_records(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_bytes(b'{"a":1,"b":"x"}\n{"a":2,"b":null}\n')
    bad.write_bytes(b'{"a":1,"a":2}\n\n[1]\n{"a":NaN}\n{"a": 1}\r\n{"a":1}\n')
    assert [tuple(r) for r in records.read_strict(spark, str(good), "a long, b string", True).orderBy("a").collect()] == [(1, "x"), (2, None)]
    assert records.faults(spark, str(bad)).count() == 5
    with pytest.raises(Exception, match="bad.jsonl"):
        records.read_strict(spark, str(bad), "a long").collect()
    assert fn.strict_json('{"b":1,"a":2}', True) == "not canonical" and fn.strict_json("﻿{}") == "byte order mark"


def test_publish_is_atomic_and_frozen(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(2, "b"), (1, None)], "id long, x string")
    records.write_canonical(df, out, ["id"])
    assert [r.value for r in spark.read.text(out).collect()] == ['{"id":1,"x":null}', '{"id":2,"x":"b"}']
    with pytest.raises(FileExistsError):
        records.write_canonical(df, out, ["id"])
    with pytest.raises(FileExistsError):
        records.publish(spark, str(tmp_path / "other"), lambda at: None, frozen_by=out)


def test_streaming_roll_up_resumes(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    row = {"agent": "a", "purpose": "p", "batch_id": "b", "batch_ordinal": 1, "prompt_eval_count": 5, "eval_count": 2, "evidence_utf8_bytes": 10}
    for n in (1, 2):
        (tmp_path / "in" / f"{n}.jsonl").write_text("\n".join(json.dumps(row) for _ in range(n)))
        telemetry.start(spark, src, out, mark).awaitTermination(60)
        got = telemetry.totals(spark, out).first()
        assert (got.calls, got.prompt_tokens) == ((1, 5), (3, 15))[n - 1]


def test_next_fit_equals_the_plain_walk(spark):
    import random

    rng = random.Random(7)
    for cap, block in ((100, 100), (50, 11)):
        sizes = [rng.randint(1, 50) for _ in range(700)]
        items = spark.createDataFrame(list(enumerate(sizes)), "i long, s long")
        got = {r.i: r.batch_ordinal for r in ch.next_fit(items, "i", "s", cap, block).collect()}
        batch = fill = 0
        for i, s in enumerate(sizes):
            if fill + s > cap:
                batch, fill = batch + 1, 0
            fill += s
            assert got[i] == batch
    with pytest.raises(ValueError):
        ch.next_fit(items, "i", "s", 10)


def test_next_fit_edge(spark):
    pair = spark.createDataFrame([(0, 40), (1, 60)], "i long, s long")
    assert [ch.next_fit(pair, "i", "s", cap).agg(F.max("batch_ordinal")).first()[0] for cap in (100, 99)] == [0, 1]


def test_sensitive_rules(spark):
    names = ["strcpy", "ns::memcpy", " execute_x", "execve", "strtoull", "harmless", "strtol"]
    r = scoring.rule(F.col("n"), scoring.exact_rules(), scoring.SENSITIVE_PREFIXES)
    got = {x.n: (x.r.category, x.r.weight) if x.r else None for x in spark.createDataFrame([(n,) for n in names], "n string").select("n", r.alias("r")).collect()}
    assert got == {"strcpy": ("memory_string", 12), "ns::memcpy": ("memory_copy", 7), " execute_x": ("command_exec", 13), "execve": ("command_exec", 15), "strtoull": ("numeric_parse", 4), "harmless": None, "strtol": ("numeric_parse", 4)}
    assert len(scoring.exact_rules()) == 38


def test_schema_checks():
    schema = {"type": "object", "properties": {"n": {"type": "integer", "const": 1}, "s": {"type": "array", "items": {"type": "string", "pattern": "a+"}, "uniqueItems": True, "maxItems": 2}}, "required": ["n", "s"], "additionalProperties": False}
    assert validate.schema_errors({"n": 1, "s": ["a", "aa"]}, schema) == [] and validate.contract_errors(schema) == []
    for wrong in ({"n": True, "s": []}, {"n": 1}, {"n": 1, "s": ["a", "a"]}, {"n": 1, "s": ["b"]}, {"n": 1, "s": [], "x": 0}, {"n": 1, "s": ["a", "aa", "aaa"]}):
        assert validate.schema_errors(wrong, schema), wrong
    assert validate.schema_errors(1, {"type": "integer", "oneOf": []}) and validate.contract_errors({"type": "object", "properties": {}})


class Stub:
    """Answers by request alone, so that repeated runs agree."""

    def chat(self, purpose, request):
        none = {"chunk_ids": [], "context_symbols": [], "reason": "r"}
        if purpose == "first_pass":
            b = request["batch_id"]
            found = [
                {"status": "CANDIDATE", "title": "One  Finding", **none, "chunk_ids": [f"{b}-0"]},
                {"status": "NEED_CONTEXT", "title": "Two", **none, "context_symbols": ["shared_fn"]},
                {"status": "NEED_CONTEXT", "title": "Three", **none, "context_symbols": ["unknown"]},
            ]
            result = {"findings": found if b != "b2" else [], "truncated": False, "review": ["x"] * 5}
        elif purpose == "context_selection":
            result = {"status": "SELECTED", "chunk_ids": [json.loads(request["candidates"])[0]["chunk"]], "reason": "r"}
        elif purpose == "refinement":
            result = {"status": "CLEAR" if request["finding_id"] < "8" else "CANDIDATE", "title": "Refined", **none}
        else:
            result = {"status": "VERIFIED" if "One" in request["now_title"] else "INCONCLUSIVE", "reason": "r", "chunk_ids": []}
        return {"result": result, "prompt_tokens": 10, "output_tokens": 3}


SYMBOLS = "symbol_id string, name string, qualified_name string, symbol_kind string, role string, linkage string, path string, start_byte long, chunk_id string"
CALLS = "call_id string, caller_symbol_id string, callee_name string, callee_expression string, kind string, path string, start_byte long, chunk_id string"


def small_index(spark):
    from codegrain.operators import relations as rel

    f = ("FUNCTION", "DEFINITION", "EXTERNAL")
    symbols = spark.createDataFrame(
        [("s1", "shared_fn", "lib::shared_fn", *f, "b2.c", 1, "b2-1"), ("s2", "shared_fn", "own::shared_fn", *f, "b1.c", 1, "b1-0"), ("s3", "other", "other", *f, "b3.c", 1, "b3-0"), ("s4", "in_one", "in_one", *f, "b1.c", 9, "b1-1")], SYMBOLS,
    )
    calls = spark.createDataFrame([("c1", "s4", "other", "other", "DIRECT_IDENTIFIER", "b1.c", 12, "b1-1"), ("c2", "s3", "in_one", "in_one", "DIRECT_IDENTIFIER", "b3.c", 5, "b3-0"), ("c3", "s3", "shared_fn", "shared_fn", "DIRECT_IDENTIFIER", "b3.c", 7, "b3-0")], CALLS)
    return symbols, rel.resolve_calls(calls, symbols)


def test_candidate_index_has_callees_and_callers(spark):
    symbols, calls = small_index(spark)
    batches = spark.createDataFrame([(f"b{i}", [f"b{i}-0", f"b{i}-1"]) for i in (1, 2, 3)], "batch_id string, chunk_ids array<string>")
    findings = spark.createDataFrame([("b1", "f1", ["shared_fn"]), ("b1", "f2", []), ("b2", "f3", ["unknown"]), ("b3", "f4", [" OTHER "])], "batch_id string, finding_id string, context_symbols array<string>")
    got = {r.finding_id: [(x["why"], x["name"], x["chunk"]) for x in json.loads(r.candidates)] for r in workflow.candidate_index(findings, batches, symbols, calls).collect()}
    assert got == {
        "f1": [("symbol", "lib::shared_fn", "b2-1"), ("callee", "other", "b3-0"), ("caller", "other", "b3-0")],
        "f2": [("callee", "other", "b3-0"), ("caller", "other", "b3-0")],
        "f3": [("caller", "other", "b3-0")],
        "f4": [("caller", "in_one", "b1-1"), ("callee", "in_one", "b1-1"), ("callee", "own::shared_fn", "b1-0"), ("callee", "lib::shared_fn", "b2-1")],
    }
    first = {r.finding_id: r.candidates for r in workflow.candidate_index(findings, batches, symbols, calls, cap=200).collect()}
    assert all(len(c.encode()) <= 200 for c in first.values()) and len(json.loads(first["f1"])) == 1


def small_batches(spark):
    batches = spark.createDataFrame([(f"b{i}", i, [f"b{i}-0", f"b{i}-1"], f"frame {i} 0\nframe {i} 1\n") for i in (1, 2, 3)], "batch_id string, batch_ordinal long, chunk_ids array<string>, evidence string")
    batches = batches.withColumn("payload_sha256", F.sha2("evidence", 256)).withColumn("payload_bytes", F.octet_length("evidence").cast("long"))
    chunks = spark.createDataFrame([(f"b{i}-{j}", f"frame {i} {j}\n") for i in (1, 2, 3) for j in (0, 1)], "chunk_id string, frame string")
    return batches, chunks.withColumn("frame_sha256", F.sha2("frame", 256)).withColumn("frame_bytes", F.octet_length("frame").cast("long"))


def test_workflow(spark):
    batches, chunks = small_batches(spark)
    symbols, calls = small_index(spark)
    got = workflow.run(batches, chunks, symbols, calls, Stub, lambda df, name: df.cache())
    found = got["findings"].collect()
    assert len(found) == 6 and {r.final_status for r in found if r.title == "One  Finding"} == {"VERIFIED"}
    assert {r.final_status for r in found if r.title == "Refined"} <= {"REJECTED", "INCONCLUSIVE"}
    n = {r.purpose: r["count"] for r in got["telemetry"].groupBy("purpose").count().collect()}
    cleared = sum(r.final_status == "REJECTED" for r in found)
    assert n["first_pass"] == 3 and n["context_selection"] >= 2 and n["verification"] == 6 - cleared
    assert workflow.resume(batches, batches.limit(1)).count() == 2 and workflow.dry_run(batches).count() == 3


def test_faulty_answers_are_rows(spark):
    class Bad(Stub):
        def chat(self, purpose, request):
            if request["batch_id"] == "b2":
                raise workflow.ProviderError("400", False)
            return super().chat(purpose, request) | ({"prompt_tokens": 0} if request["batch_id"] == "b3" else {})

    batches, _ = small_batches(spark)
    asked = workflow.ask(batches, "first_pass", Bad, ["batch_id", "evidence"])
    assert {r.batch_id: r.fault for r in asked.collect()} == {"b1": None, "b2": "first_pass: ProviderError: 400", "b3": "first_pass: token counts"}
    with pytest.raises(workflow.Faulty):
        workflow._taken(asked)


def test_analysis_in_waves_resumes_and_rolls_up(spark, tmp_path):
    batches, chunks = small_batches(spark)
    symbols, calls = small_index(spark)
    tables = {
        "batches": batches.withColumn("batch_ordinal", F.col("batch_ordinal") - 1), "chunks": chunks, "symbols": symbols.withColumnRenamed("chunk_id", "anchor_chunk_id"), "calls": calls.withColumnRenamed("chunk_id", "anchor_chunk_id"),
        "selection": spark.createDataFrame([(1, "b3"), (2, "b1")], "rank long, batch_id string"), "ranked": spark.createDataFrame([("b2", 1), ("b1", 2), ("b3", 3)], "batch_id string, priority_rank long"),
    }
    order = lambda mode, limit=None: [r.batch_id for r in workflow.batches_of(mode, batches.withColumn("batch_ordinal", F.col("batch_ordinal") - 1), tables["selection"], tables["ranked"], limit).orderBy("batch_ordinal").collect()]
    assert order("selected") == ["b3", "b1"] and order("all") == ["b1", "b2", "b3"] and order("priority", 2) == ["b2", "b1"]
    out = f"{tmp_path}/out"
    part = workflow.analyse(spark, tables, Stub, out, mode="all", limit=1, wave=1)
    assert part["status"] == "COMPLETE" and part["batch_count"] == 1
    with pytest.raises(FileExistsError):
        workflow.analyse(spark, tables, Stub, out, mode="all")
    whole = workflow.analyse(spark, tables, Stub, out, mode="all", resumed=True, wave=2)
    assert whole["batch_count"] == 3 and whole["recovered_batch_count"] == 1 and whole["remaining_batch_count"] == 0 and whole["finding_count"] == 6
    assert sum(whole["batch_status_counts"].values()) == 3 and whole["batch_status_counts"]["CLEAR"] == 1
    lines = open(f"{out}/findings.jsonl").read().splitlines()
    assert len(lines) == 6 and [json.loads(x)["batch_ordinal"] for x in lines] == [1, 1, 1, 3, 3, 3] and json.load(open(f"{out}/summary.json")) == whole
    assert len(open(f"{out}/telemetry.jsonl").read().splitlines()) == sum(whole["purpose_call_counts"].values())
    tampered = tables | {"chunks": chunks.withColumn("frame", F.lit("x"))}
    with pytest.raises(ValueError):
        workflow.analyse(spark, tampered, Stub, f"{tmp_path}/other", mode="all")
    with pytest.raises(ValueError):
        workflow.batches_of("some", batches, tables["selection"], tables["ranked"])


def test_retries_and_gates():
    class Failing:
        def __init__(self, *errors):
            self.errors, self.calls = list(errors), 0

        def chat(self, purpose, request):
            self.calls += 1
            if self.errors:
                raise self.errors.pop(0)
            return {}

    lost, refused = workflow.ProviderError("500", True), workflow.ProviderError("400", False)
    for errors, calls in (((lost,), 2), ((lost, lost, lost), 3), ((refused,), 1)):
        p = Failing(*errors)
        if calls == 2:
            workflow.with_retries(p, "x", {}, sleep=lambda s: None)
        else:
            with pytest.raises(workflow.ProviderError):
                workflow.with_retries(p, "x", {}, sleep=lambda s: None)
        assert p.calls == calls
    with pytest.raises(ValueError):
        workflow.HttpProvider("http://example.org:1/api", "m")


def test_finding_id_ignores_case_and_space(spark):
    df = spark.createDataFrame([("b", 1, "A  Title\u001c x"), ("b", 1, "a title x ")], "b string, o long, t string")
    assert df.select(rollup.finding_id(F.col("b"), F.col("o"), F.col("t")).alias("i")).distinct().count() == 1


def test_dates_placeholders_and_gates():
    from codegrain.functions import text as fn

    assert fn.is_iso_date("2024-02-29") and not any(map(fn.is_iso_date, ("2024-02-30", "2024-01", "24-01-01", "2024-01-01T00:00:00Z", "٢٠٢٤-01-01")))
    assert fn.is_iso_datetime("2024-01-01T10:00:00Z") and fn.is_iso_datetime("2024-01-01T10:00:00.5+02:00") and not any(map(fn.is_iso_datetime, ("2024-01-01", "2024-01-01T10:00:00", "2024-01-01T25:00:00Z")))
    assert validate.schema_errors("2024-01", {"type": "string", "format": "date"}) and not validate.schema_errors("2024-01-05", {"type": "string", "format": "date"})
    assert fn.placeholders({"a": ["x", {"b": "TODO"}], "c": "fine"}) == ["$.a[1].b"]
    caps = {"system": 10, "user": 5}
    assert validate.request_faults([("system", "abc"), ("user", "é")], caps, 15) == []
    assert validate.request_faults([("user", "abc"), ("system", "x")], caps, 15) and validate.request_faults([("user", "éééé")], caps, 15) and validate.request_faults([("system", "abc"), ("user", "a")], caps, 3) and validate.request_faults([("other", "")], caps, 3)


def test_prefix_deltas(spark):
    rows = [("a", 1, 5, 9), ("a", 2, 9, 9), ("b", 1, 5, 5), ("b", 2, 4, 5), ("c", 1, 3, 8)]
    got = rollup.prefix_faults(spark.createDataFrame(rows, "k string, o long, v long, t long"), "k", "o", "v", "t")
    assert {r.k for r in got.collect()} == {"b", "c"}


def test_packing_expressions(spark):
    df = spark.createDataFrame([([5, 9, 3, 4],), ([],), (None,), ([20],)], "s array<bigint>")
    assert [r.p for r in df.select(ch.pack_skip(10)(F.col("s")).alias("p")).collect()] == [[0, 2], [], [], []]
    with pytest.raises(ValueError):
        ch.next_fit(spark.createDataFrame([(1, None)], "i long, s long"), "i", "s", 10)
    same = spark.createDataFrame([(1, 6), (1, 5), (1, 4)], "i long, s long")
    assert {(r.s, r.batch_ordinal) for r in ch.next_fit(same, "i", "s", 10).collect()} == {(4, 0), (5, 0), (6, 1)}


def test_one_ordered_file_and_pretty_json(spark, tmp_path):
    df = spark.createDataFrame([(i, f"é{i}") for i in range(50, 0, -1)], "i long, t string").repartition(7)
    for _ in range(2):
        records.write_one(df, f"{tmp_path}/x.jsonl", ["i"])
    lines = open(f"{tmp_path}/x.jsonl", encoding="utf-8").read().splitlines()
    assert lines[0] == '{"i":1,"t":"é1"}' and [json.loads(x)["i"] for x in lines] == list(range(1, 51))
    assert records.read_strict(spark, f"{tmp_path}/x.jsonl", "i long, t string", canonical=True).count() == 50
    records.write_pretty(spark, f"{tmp_path}/y.json", {"b": 1, "a": ["é"]})
    assert open(f"{tmp_path}/y.json", encoding="utf-8").read() == '{\n  "a": [\n    "é"\n  ],\n  "b": 1\n}\n'
    assert records.read_text(spark, f"{tmp_path}/y.json").startswith("{")
    with pytest.raises(ValueError):
        records.read_text(spark, str(tmp_path / "empty.txt") if (tmp_path / "empty.txt").write_text(" \n") else "")
