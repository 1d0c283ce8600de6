"""A small repository, from files to ranked batches, and the checks of each table."""

import random
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codegrain.functions.text import blob_oid, from_cp1252
from codegrain.operators import build, verify, workflow
from codegrain.sources import committed

FILES = {
    "src/a.c": '#include "a.h"\n#include "util/b.h"\nstatic int local(int n)\n{\n    return n + 1;\n}\n\nint shared(int n) { return local(n) + twice(n) + MAX(n, 2); }\n\nstruct box { int v; };\n',
    "src/b.c": '#include "../a.h"\nint shared(int n) { return n; }\nint only_here(char *p, int (*call)(int))\n{\n    strcpy(p, "x");\n    system(p);\n    (*call)(1);\n    return box(p) + only_macro(1) + shared(2);\n}\n',
    "src/a.h": "#ifndef A_H\n#define A_H\n#define MAX(a, b) ((a) > (b) ? (a) : (b))\n#define only_macro(x) (x)\nint MAX_(int);\nint shared(int n);\n#endif\n",
    "lib/util/b.h": "namespace a { int f(int); }\nint a::f(int n) { return shared(n); }\nint g() { return a::f(1) + MAX(1, 2); }\nint MAX(int a, int b) { return a; }\n",
    "other/b.h": "// only a comment\n",
    "empty.c": "",
    "win.c": None,
}


@pytest.fixture(scope="module")
def stage(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("build")

    def write(df, name):
        path = f"{top}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write


@pytest.fixture(scope="module")
def files(spark, stage):
    rows = [(p, t.encode() if t is not None else "// caf\xe9\n".encode("cp1252")) for p, t in FILES.items()]
    return stage(spark.createDataFrame(rows, "path string, raw binary").withColumn("git_blob_oid", blob_oid(F.col("raw"))), "in")


TARGET = build.Target("c" * 40, "d" * 64)


@pytest.fixture(scope="module")
def built(files, stage):
    return {k: stage(v, k) for k, v in build.build(files, TARGET, stage, cap=120, batch_cap=700).items()}


def test_calls_are_resolved_by_kinds_and_pools(built):
    names = {r.symbol_id: (r.path, r.name) for r in built["symbols"].collect()}
    got = {(r.path, r.callee_expression): (r.resolution, r.n_candidates, r.n_declarations, [names[i] for i in r.first_candidates]) for r in built["calls"].collect()}
    shared = [("src/a.c", "shared"), ("src/b.c", "shared")]
    assert got[("src/a.c", "local")] == ("UNIQUE_FILE_LOCAL_CANDIDATE", 1, 0, [("src/a.c", "local")])
    assert got[("src/a.c", "twice")] == ("UNRESOLVED_EXTERNAL", 0, 0, [])
    assert got[("src/a.c", "MAX")][0] == "MACRO_OR_FUNCTION_AMBIGUOUS"
    assert got[("src/b.c", "strcpy")][0] == got[("src/b.c", "box")][0] == got[("src/b.c", "only_macro")][0] == "UNRESOLVED_EXTERNAL"
    assert got[("src/b.c", "shared")] == ("AMBIGUOUS", 2, 1, shared) and got[("src/b.c", "(*call)")][0] == "INDIRECT_OR_DYNAMIC"
    assert got[("lib/util/b.h", "a::f")] == ("MEMBER_OR_QUALIFIED", 1, 1, [("lib/util/b.h", "f")])


def test_names_without_a_call_keep_qualified_candidates(spark):
    from codegrain.operators import relations as rel

    symbols = spark.createDataFrame([("s1", "f", "a::f", "FUNCTION", "DEFINITION", "EXTERNAL", "x.c", 0)], "symbol_id string, name string, qualified_name string, symbol_kind string, role string, linkage string, path string, start_byte long")
    calls = spark.createDataFrame([("c1", "DIRECT_IDENTIFIER", None, "a::f", "y.c"), ("c2", "DIRECT_IDENTIFIER", None, None, "y.c")], "call_id string, kind string, callee_name string, callee_expression string, path string")
    resolved = rel.resolve_calls(calls, symbols)
    got = {r.call_id: (r.resolution, r.n_candidates, r.first_candidates) for r in resolved.collect()}
    assert got == {"c1": ("INDIRECT_OR_DYNAMIC", 1, ["s1"]), "c2": ("INDIRECT_OR_DYNAMIC", 0, [])}
    assert [(r.call_id, r.symbol_id) for r in rel.call_candidates(resolved, symbols).collect()] == [("c1", "s1")]


def test_includes(built, files):
    from codegrain.operators import relations as rel

    got = {(r.path, r.target): (r.resolution, r.first_paths) for r in built["includes"].collect()}
    assert got == {
        ("src/a.c", "a.h"): ("UNIQUE_PATH_CANDIDATE", ["src/a.h"]), ("src/a.c", "util/b.h"): ("AMBIGUOUS_PATH_CANDIDATES", ["lib/util/b.h", "other/b.h"]), ("src/b.c", "../a.h"): ("UNRESOLVED_WITHOUT_BUILD_CONFIG", []),
    }
    assert rel.link_paths(built["includes"], files).count() == 3


def test_tables_pass_their_checks_and_repeat(built, files, stage):
    checks = verify.chunk_faults(files, built["files"], built["chunks"], built["batches"], built["selection"], TARGET, "0", 120, 700)
    assert checks.collect() == []
    assert verify.index_faults(built["chunks"], built["symbols"], built["calls"], built["includes"], built["chunk_facts"]).collect() == []
    keys = {"chunks": ["chunk_id", "start_byte", "end_byte"], "batches": ["batch_id", "batch_ordinal"], "symbols": ["symbol_id"], "calls": ["call_id", "resolution"], "ranked": ["batch_id", "priority_rank"]}
    assert set(build.twice(lambda: build.build(files, TARGET, stage, cap=120, batch_cap=700), keys).values()) == {0}
    status = {r.path: (r.index_status, r.symbol_count) for r in built["file_index"].collect()}
    assert status["win.c"] == ("NO_AST_NON_UTF8", 0) and status["empty.c"][0] == "INDEXED" and status["src/b.c"][0] == "INDEXED"


@pytest.mark.parametrize(
    "table, change, rule",
    [
        ("chunks", lambda df: df.withColumn("raw_sha256", F.when(F.col("start_byte") == 0, F.lit("0" * 64)).otherwise(F.col("raw_sha256"))), "raw content hash"),
        ("chunks", lambda df: df.withColumn("kind", F.when(F.col("kind") == "DECLARATION", "FUNCTION").otherwise(F.col("kind"))), "kind and node type"),
        ("chunks", lambda df: df.where("ordinal <> 1"), "partition"),
        ("chunks", lambda df: df.withColumn("start_line", F.col("start_line") + 1), "lines"),
        ("batches", lambda df: df.withColumn("chunk_ids", F.concat("chunk_ids", F.slice("chunk_ids", 1, 1))), "chunk in batches"),
        ("batches", lambda df: df.withColumn("payload_sha256", F.lit("0" * 64)), "payload hash"),
        ("batches", lambda df: df.withColumn("batch_id", F.lit("B1-0")), "batch identity"),
        ("selection", lambda df: df.withColumn("rank", 4 - F.col("rank")), "selection"),
        ("files", lambda df: df.withColumn("covered_bytes", F.col("covered_bytes") + 1), "coverage"),
    ],
)
def test_tampering_is_found(built, files, table, change, rule):
    t = {**built, table: change(built[table])}
    found = verify.chunk_faults(files, t["files"], t["chunks"], t["batches"], t["selection"], TARGET, "0", 120, 700)
    assert rule in {r.rule for r in found.select("rule").distinct().collect()}


def test_ranking_and_maps(built):
    rows = {r.batch_id: r for r in built["ranked"].collect()}
    assert sorted(r.priority_rank for r in rows.values()) == list(range(1, len(rows) + 1)) == sorted(range(1, built["batches"].count() + 1))
    best = max(rows.values(), key=lambda r: r.priority_score)
    assert best.priority_rank == 1 and any(r.sensitive_names.get("system") == 1 and r.sensitive_categories["command_exec"] == 1 for r in rows.values())
    assert build.rank_summary(built["ranked"], 2)["top_batches"][0]["batch_id"] == best.batch_id
    assert sum(r.cross_file_target_count for r in rows.values()) > 0


def test_batch_map_and_empty_chunks(built):
    rows = built["batch_map"].orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3][: len(rows)]
    symbols = {i for r in rows for i in r.anchor_symbol_ids}
    assert symbols <= {i for r in rows for i in r.enclosing_symbol_ids}
    empty = {r.path for r in build.without_facts(built["chunk_facts"], built["includes"]).collect()}
    assert "other/b.h" in empty and "src/b.c" not in empty


def test_source_order_is_global(built, stage):
    ordered = build.source_order(built["chunks"].drop("ordinal"), "path", "start_byte", stage=stage).orderBy("ordinal").collect()
    assert [r.ordinal for r in ordered] == list(range(len(ordered)))
    keys = [(r.path.encode(), r.start_byte) for r in ordered]
    assert keys == sorted(keys)


def test_saved_tables_load_and_freeze(built, spark, tmp_path):
    some = {k: built[k] for k in build.TABLES}
    build.save(some, f"{tmp_path}/out")
    assert build.load(spark, f"{tmp_path}/out")["calls"].count() == built["calls"].count()
    with pytest.raises(FileExistsError):
        build.save(some, f"{tmp_path}/out")
    with pytest.raises(FileExistsError):
        build.save(some, f"{tmp_path}/new", frozen_by=f"{tmp_path}/out")
    less = {**some, "calls": some["calls"].limit(1)}
    assert build.save(less, f"{tmp_path}/out", refreeze=True) == 2 and build.load(spark, f"{tmp_path}/out")["calls"].count() == 1
    with pytest.raises(FileExistsError):
        build.save(some, f"{tmp_path}/out", frozen_by=f"{tmp_path}/out", refreeze=True)
    next(Path(committed.folder(spark, f"{tmp_path}/out"), "calls").glob("part-*.parquet")).unlink()
    with pytest.raises(committed.Damaged):
        build.save(some, f"{tmp_path}/out", refreeze=True)


def test_facts_are_in_the_order_of_chunks(built):
    rows = built["chunk_facts"].orderBy("chunk_ordinal").collect()
    places = {r.chunk_id: (r.path.encode(), r.start_byte) for r in built["chunks"].collect()}
    assert [r.chunk_ordinal for r in rows] == list(range(len(places))) and [places[r.chunk_id] for r in rows] == sorted(places.values())


def test_no_index_of_faulty_chunks(files, stage):
    bad = lambda f, records, chunks, batches, chosen: verify.chunk_faults(f, records, chunks.withColumn("start_line", F.col("start_line") + 1), batches, chosen, TARGET, "0", 120, 700)
    with pytest.raises(ValueError, match="lines"):
        build.build(files, TARGET, stage, cap=120, batch_cap=700, upstream=bad)


def test_evidence_is_rendered_from_the_bytes_of_files(built, files, spark):
    frames = {r.chunk_id: r.frame for r in built["chunks"].collect()}
    assert {r.chunk_id: (r.frame, r.fault) for r in verify.rendered(built["chunks"], files).collect()} == {i: (f, None) for i, f in frames.items()}
    got = workflow.rendered_batches(built["batches"], built["chunks"], files).collect()
    assert {r.batch_id: (r.evidence, r.fault) for r in got} == {r.batch_id: (r.evidence, None) for r in built["batches"].collect()}

    def faults(chunks=built["chunks"], files=files, batches=built["batches"]):
        return {r.fault for r in workflow.rendered_batches(batches, chunks, files).collect()}

    is_b = F.col("path") == "src/b.c"
    assert "raw hash" in faults(files=files.withColumn("raw", F.when(is_b, F.regexp_replace(F.col("raw").cast("string"), "system", "sYstem").cast("binary")).otherwise(F.col("raw"))))
    assert "blob" in faults(files=files.withColumn("git_blob_oid", F.when(is_b, F.lit("0")).otherwise(F.col("git_blob_oid"))))
    assert "file" in faults(files=files.where(~is_b))
    assert "frame hash" in faults(chunks=built["chunks"].withColumn("end_line", F.col("end_line") + 1))
    assert "chunk" in faults(chunks=built["chunks"].where(~is_b))
    assert faults(batches=built["batches"].withColumn("payload_sha256", F.lit("0"))) == {"payload hash"}
    assert faults(batches=built["batches"].withColumn("payload_bytes", F.col("payload_bytes") + 1)) == {"payload size"}
    assert faults(batches=built["batches"].limit(0)) == set()


def test_cp1252_in_the_jvm(spark):
    raw = bytes(b for b in range(1, 256) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
    assert spark.createDataFrame([(raw,)], "b binary").select(from_cp1252(F.col("b"))).first()[0] == raw.decode("cp1252")


def _joined(plan) -> int:
    """Rows that the joins of a plan that has run gave."""
    kind = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    return (plan.metrics().apply("numOutputRows").value() if "Join" in kind else 0) + sum(map(_joined, below))


def test_cross_targets_of_a_name_that_many_share(spark):
    """Against sets; and no batch meets the symbols of a pool, of which this has 4 million pairs."""
    rng = random.Random(3)
    names, files = [None, "", "a", "b", "f::a"], ["", "x", "y", "z"]
    symbols = [(i, rng.choice(names), rng.choice(["a", "q::a", "q::b", "f::a", None]), rng.choice(["FUNCTION", "FUNCTION", "STRUCT"]), rng.choice(["DEFINITION", "DEFINITION", "DECLARATION"]), rng.choice(files)) for i in range(60)]
    calls = [(rng.randrange(40), *rng.choice([("name", rng.choice(names)), ("qualified", rng.choice(["a", "q::a", "q::b", "f::a"])), (None, None)]), None) for _ in range(120)]
    defined = {s[0]: s for s in symbols if s[3:5] == ("FUNCTION", "DEFINITION")}
    held = lambda c: [s for s in defined.values() if c[2] is not None and c[2] == s[1 if c[1] == "name" else 2]]
    calls += [(c[0], c[1], c[2], rng.choice(held(c))[0]) for c in calls if c[1] and held(c) and rng.random() < 0.6]
    calls = [c for c in calls if c[3] is not None or rng.random() < 0.5]
    paths = [(rng.randrange(40), rng.choice([*files, None])) for _ in range(50)]
    want = {}
    for b in {c[0] for c in calls}:
        found = {s[0] for c in calls if c[0] == b for s in held(c) if c[3] in (None, s[0]) and s[5] != "" and (b, s[5]) not in paths}
        want |= {b: len(found)} if found else {}
    frames = lambda c, s, p: (spark.createDataFrame(c, "b long, via string, pool string, local_symbol_id long"), spark.createDataFrame(s, "symbol_id long, name string, qualified_name string, symbol_kind string, role string, path string").withColumns({"start_byte": F.lit(0), "linkage": F.lit("EXTERNAL")}), spark.createDataFrame(p, "b long, path string"))
    assert {r.b: r.cross_file_target_count for r in build.cross_targets(*frames(calls, symbols, paths), "b").collect()} == want and len(want) > 20

    n = 2000
    got = build.cross_targets(*frames([(b, "name", "init", None) for b in range(n)], [(i, "init", f"s{i}::init", "FUNCTION", "DEFINITION", f"f{i}") for i in range(n)], [(b, f"f{b}") for b in range(n)]), "b")
    assert {r.cross_file_target_count for r in got.collect()} == {n - 1}
    assert _joined(got._jdf.queryExecution().executedPlan()) < 20 * n
