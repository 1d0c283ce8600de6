"""Command line: build, rank, analyse and verify a repository's tables.

    python -m codegrain.cli build --repository DIR --commit SHA --out DIR [--seed N] [--check-repeats] [--frozen-by DIR] [--refreeze]
    python -m codegrain.cli rank --tables DIR [--top N]
    python -m codegrain.cli analyse --tables DIR --out DIR --mode {selected,priority,all} [--limit N] [--resume] [--dry-run] [--repository DIR --commit SHA]
    python -m codegrain.cli verify --tables DIR --repository DIR --commit SHA [--seed N] [--lock FILE]

Each prints one JSON object and ends with 0 if its status is PASS or COMPLETE.
"""

from __future__ import annotations

import argparse
import json
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.operators import build, preflight, scope, verify, workflow
from codegrain.sources import git, records

#: Columns by which two builds are compared.
KEYS = {"chunks": ["chunk_id"], "batches": ["batch_id", "batch_ordinal"], "symbols": ["symbol_id"], "calls": ["call_id", "resolution"], "includes": ["include_id", "resolution"], "ranked": ["batch_id", "priority_rank"]}


def source_files(spark: SparkSession, repository: str, commit: str) -> DataFrame:
    """path, git_blob_oid, raw of the files in scope at a commit: those of the tree, whatever lies in the work tree."""
    git.register(spark)
    tree = spark.read.format("git_tree").option("repository", repository).option("commit", commit).load()
    kept = tree.where(scope.classify(F.col("path"), F.col("mode")) == "IN_SCOPE")
    return git.with_blobs(kept, repository).select("path", "git_blob_oid", "raw")


def stage_in(spark: SparkSession, folder: str) -> Callable[[DataFrame, str], DataFrame]:
    """Writes tables to new folders below ``folder`` and reads them back."""

    def stage(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return stage


def build_tables(spark: SparkSession, repository: str, commit: str, out: str, seed: str = "0", check_repeats: bool = False, frozen_by: str | None = None, refreeze: bool = False) -> dict:
    stage, target = stage_in(spark, f"{out}.staged"), build.Target(commit)
    files = stage(source_files(spark, repository, commit), "source")
    upstream = lambda *t: verify.chunk_faults(*t, target, seed)
    make = lambda checked=None: build.build(files, target, stage, seed, upstream=checked)
    differ = build.twice(make, KEYS) if check_repeats else {}
    if any(differ.values()):
        return {"status": "FAIL", "differ": differ}
    tables = make(upstream)
    build.save(tables, out, frozen_by, refreeze)
    got = build.load(spark, out)
    return {"status": "PASS", "reproducible": bool(check_repeats), "counts": build.coverage(got["files"], got["chunks"], got["batches"]).first().asDict(True)}


def rank_tables(spark: SparkSession, tables: str, top: int = 20) -> dict:
    return build.rank_summary(build.load(spark, tables)["ranked"], top)


def analyse_tables(spark: SparkSession, tables: str, out: str, make, mode: str = "selected", limit: int | None = None, resumed: bool = False, dry_run: bool = False, files: DataFrame | None = None) -> dict:
    t = build.load(spark, tables)
    if dry_run:
        listed = workflow.batches_of(mode, t["batches"], t["selection"], t["ranked"], limit)
        faults = (workflow.render_faults(listed, t["chunks"]) if files is None else workflow.rendered_batches(listed, t["chunks"], files).where("fault is not null")).count()
        size = workflow.dry_run(listed).agg(F.count("*").alias("n"), F.coalesce(F.sum("evidence_bytes"), F.lit(0)).alias("b")).first()
        return {"status": "FAIL" if faults else "PASS", "mode": mode, "batch_count": size.n, "evidence_bytes": size.b, "faulty": faults}
    return workflow.analyse(spark, t, make, out, mode, limit, resumed, files=files)


def verify_tables(spark: SparkSession, tables: str, repository: str, commit: str, seed: str = "0", lock: dict | None = None, most: int = 20) -> dict:
    """Faults of a saved build, the first ``most`` of them listed (a report)."""
    t = build.load(spark, tables)
    files = source_files(spark, repository, commit)
    found = verify.chunk_faults(files, t["files"], t["chunks"], t["batches"], t["selection"], build.Target(commit), seed).unionByName(verify.index_faults(t["chunks"], t["symbols"], t["calls"], t["includes"], t["chunk_facts"]))
    counts = {r.rule: r["count"] for r in found.groupBy("rule").count().collect()}
    sealed = preflight.lock_faults(lock) if lock is not None else []
    return {"status": "FAIL" if counts or sealed else "PASS", "faults": counts, "first": [tuple(r) for r in found.limit(most).collect()], "lock": sealed}


def main(argv: list[str] | None = None, spark: SparkSession | None = None, make=None) -> int:
    parser = argparse.ArgumentParser(prog="codegrain", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    options = {
        "build": (("--repository", {}), ("--commit", {}), ("--out", {}), ("--seed", {"default": "0"}), ("--check-repeats", {"action": "store_true"}), ("--frozen-by", {"default": None}), ("--refreeze", {"action": "store_true"})),
        "rank": (("--tables", {}), ("--top", {"type": int, "default": 20})),
        "analyse": (("--tables", {}), ("--out", {}), ("--mode", {"choices": workflow.MODES, "default": "selected"}), ("--limit", {"type": int, "default": None}), ("--resume", {"action": "store_true"}), ("--dry-run", {"action": "store_true"}), ("--url", {"default": "http://127.0.0.1:11434"}), ("--model", {"default": ""}), ("--repository", {"default": None}), ("--commit", {"default": None})),
        "verify": (("--tables", {}), ("--repository", {}), ("--commit", {}), ("--seed", {"default": "0"}), ("--lock", {"default": None})),
    }
    for name, listed in options.items():
        p = sub.add_parser(name)
        for flag, more in listed:
            p.add_argument(flag, required=not more, **more)
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("codegrain").getOrCreate()
    if a.command == "build":
        got = build_tables(spark, a.repository, a.commit, a.out, a.seed, a.check_repeats, a.frozen_by, a.refreeze)
    elif a.command == "rank":
        got = rank_tables(spark, a.tables, a.top)
    elif a.command == "analyse":
        files = source_files(spark, a.repository, a.commit) if a.repository and a.commit else None
        got = analyse_tables(spark, a.tables, a.out, make or (lambda: workflow.HttpProvider(a.url, a.model)), a.mode, a.limit, a.resume, a.dry_run, files)
    else:
        lock = None if a.lock is None else json.loads(records.read_text(spark, a.lock))
        got = verify_tables(spark, a.tables, a.repository, a.commit, a.seed, lock)
    print(records.pretty(got), end="")
    return 0 if got["status"] in ("PASS", "COMPLETE") else 1


if __name__ == "__main__":
    sys.exit(main())
