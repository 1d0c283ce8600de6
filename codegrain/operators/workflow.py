"""The review of batches by a model: every step a DataFrame, the model behind one operator.

First pass -> context search -> context selection -> refinement -> verification.
A provider answers requests; it is given, so that tests use a stub. Its calls
run in mapInPandas, one provider for each partition. An answer that can't be
taken is a row with a fault, not an error of the task, which would ask for all
of the partition's answers again. analyse() works in waves of batches, each
written before the next, and takes up where it was stopped.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.functions.text import dump_canonical, strict_json
from codegrain.operators import chunks as ch
from codegrain.operators import relations as rel
from codegrain.operators import preflight, rollup, verify
from codegrain.operators.rollup import finding_id
from codegrain.operators.validate import schema_errors
from codegrain.sources.staging import staged


class ProviderError(Exception):
    """A failed call; ``retry`` tells whether the same request may succeed later."""

    def __init__(self, message: str, retry: bool) -> None:
        super().__init__(message)
        self.retry = retry


class Provider(Protocol):
    def chat(self, purpose: str, request: dict) -> dict:
        """The answer: ``result`` (an object), ``prompt_tokens`` and ``output_tokens``."""


_TEXT, _IDS = {"type": "string", "maxLength": 240}, {"type": "array", "items": {"type": "string", "maxLength": 80}, "maxItems": 4}


def _object(**props) -> dict:
    return {"type": "object", "properties": props, "required": list(props), "additionalProperties": False}


def _status(*names: str) -> dict:
    return {"type": "string", "enum": list(names)}


_FINDING = _object(status=_status("CANDIDATE", "NEED_CONTEXT"), title=_TEXT, reason=_TEXT, chunk_ids=_IDS, context_symbols=_IDS)
SCHEMAS = {
    "first_pass": _object(findings={"type": "array", "items": _FINDING, "maxItems": 8}, truncated={"type": "boolean"}, review={"type": "array", "items": _TEXT, "minItems": 5, "maxItems": 5}),
    "context_selection": _object(status=_status("SELECTED", "NONE"), chunk_ids={**_IDS, "maxItems": 2}, reason=_TEXT),
    "refinement": _object(status=_status("CANDIDATE", "CLEAR", "NEED_CONTEXT"), title=_TEXT, reason=_TEXT, chunk_ids=_IDS, context_symbols=_IDS),
    "verification": _object(status=_status("VERIFIED", "REJECTED", "INCONCLUSIVE"), reason=_TEXT, chunk_ids=_IDS),
}
INDEX_CAP, PACK_CAP, PER_SYMBOL = 2800, 8192, 3


def with_retries(provider: Provider, purpose: str, request: dict, waits=(0.1, 0.5), sleep=time.sleep) -> dict:
    """The answer, asked for again after each wait while the failure is one that may pass."""
    for wait in (*waits, None):
        try:
            return provider.chat(purpose, request)
        except ProviderError as e:
            if wait is None or not e.retry:
                raise
            sleep(wait)
    raise AssertionError


class Faulty(Exception):
    """Answers that can't be taken; the others are staged already."""


def ask(df: DataFrame, purpose: str, make: Callable[[], Provider], request: list[str], waits=(0.1, 0.5)) -> DataFrame:
    """``df`` with the provider's answer to each row: result (JSON), prompt_tokens, output_tokens, and fault where there is no answer to take."""
    schema = SCHEMAS[purpose]

    def one(provider: Provider, row: dict) -> tuple:
        try:
            answer = with_retries(provider, purpose, {k: list(v) if hasattr(v, "tolist") else v for k, v in row.items()}, waits)
            wrong = schema_errors(answer["result"], schema)
            if type(answer["prompt_tokens"]) is not int or type(answer["output_tokens"]) is not int or min(answer["prompt_tokens"], answer["output_tokens"]) <= 0:
                wrong = [*wrong, "token counts"]
        except (ProviderError, KeyError, TypeError, ValueError) as e:
            wrong = [f"{type(e).__name__}: {e}"]
        return (None, None, None, f"{purpose}: {'; '.join(wrong)}"[:500]) if wrong else (dump_canonical(answer["result"]), answer["prompt_tokens"], answer["output_tokens"], None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for pdf in batches:
            rows = [one(provider, row) for row in pdf[request].to_dict("records")]
            kinds = {"result": object, "prompt_tokens": "Int64", "output_tokens": "Int64", "fault": object}
            yield pdf.assign(**{c: pd.Series([r[i] for r in rows], dtype=kind, index=pdf.index) for i, (c, kind) in enumerate(kinds.items())})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, result string, prompt_tokens long, output_tokens long, fault string")


def _taken(answers: DataFrame) -> DataFrame:
    """The staged answers, if all can be taken."""
    wrong = answers.where("fault is not null").select("fault").limit(5).collect()
    if wrong:
        raise Faulty([r.fault for r in wrong])
    return answers.drop("fault")


_RESULT = "status string, title string, reason string, chunk_ids array<string>, context_symbols array<string>"


def _telemetry(df: DataFrame, agent: str, purpose: str, evidence: str, ids: str, finding: bool) -> DataFrame:
    return df.select(
        F.lit(agent).alias("agent"), F.lit(purpose).alias("purpose"), "batch_id", "batch_ordinal", (F.col("finding_id") if finding else F.lit(None).cast("string")).alias("finding_id"),
        F.col("prompt_tokens").alias("prompt_eval_count"), F.col("output_tokens").alias("eval_count"), F.octet_length(evidence).cast("long").alias("evidence_utf8_bytes"), F.col(ids).alias("evidence_chunk_ids"),
    )


def candidate_index(findings: DataFrame, batches: DataFrame, symbols: DataFrame, calls: DataFrame, cap: int = INDEX_CAP) -> DataFrame:
    """finding_id, candidates: what a finding may look at outside its batch, as a JSON array within ``cap`` bytes.

    In this order, each (why, name, chunk) once: symbols whose name is wanted, or
    whose qualified name ends in it; callees, the first PER_SYMBOL candidates of
    the calls in the batch or from a wanted symbol; callers of a wanted symbol or
    one of the batch, and those that call a wanted name.

    ``findings``: batch_id, finding_id, context_symbols; ``symbols``: symbol_id,
    name, qualified_name, symbol_kind, role, linkage, path, start_byte, chunk_id;
    ``calls``: of resolve_calls(), with call_id, caller_symbol_id, start_byte, chunk_id.
    """
    asked = findings.select("batch_id", "finding_id", "context_symbols")
    wanted = asked.select("batch_id", "finding_id", F.explode("context_symbols").alias("w")).select("batch_id", "finding_id", F.lower(F.trim("w")).alias("suffix")).where("suffix <> ''").distinct()
    inside = batches.join(asked.select("batch_id").distinct(), "batch_id").select("batch_id", F.explode("chunk_ids").alias("chunk_id")).distinct()
    home = inside.select("batch_id", F.col("chunk_id").alias("home_chunk"))

    def outside(rows: DataFrame, chunk: str) -> DataFrame:
        return rows.join(home, (rows["batch_id"] == home["batch_id"]) & (rows[chunk] == home["home_chunk"]), "left_anti")

    found = wanted.join(rel.suffixes(symbols.select("symbol_id", "name", "qualified_name")).select("symbol_id", "suffix"), "suffix").select("batch_id", "finding_id", "symbol_id").distinct()
    text = lambda why, *cols: F.to_json(F.struct(*[c.alias(k) for k, c in sorted({**dict(cols), "why": F.lit(why)}.items())]))
    at = lambda leg, *order: F.struct(F.lit(leg).alias("leg"), *[c.alias(f"o{i}") for i, c in enumerate(order)])

    s = symbols.select("symbol_id", "qualified_name", "symbol_kind", "path", F.col("start_byte").alias("s_start"), "chunk_id")
    own = outside(found.join(s, "symbol_id"), "chunk_id")
    nothing = F.lit("")
    legs = [
        own.select(
            "finding_id", at(0, F.col("path"), F.col("s_start"), F.col("symbol_id"), F.lit(0), F.lit(0)).alias("at"), F.lit("symbol").alias("why"), F.col("qualified_name").alias("name"), F.col("chunk_id").alias("chunk"),
            text("symbol", ("name", F.col("qualified_name")), ("kind", F.col("symbol_kind")), ("path", F.col("path")), ("chunk", F.col("chunk_id")), ("sid", F.col("symbol_id"))).alias("line"),
        )
    ]

    def related(rows: DataFrame, why: str, step: int) -> DataFrame:
        """Rows (batch_id, finding_id, symbol_id, the call's place and resolution, i) as candidates of a kind."""
        r = outside(rows.join(s.withColumnRenamed("path", "s_path"), "symbol_id"), "chunk_id")
        place = at(1, F.coalesce("call_path", nothing), F.col("call_start"), F.col("call_id"), F.lit(step), F.col("i"))
        line = text(why, ("name", F.col("qualified_name")), ("path", F.col("s_path")), ("chunk", F.col("chunk_id")), ("resolution", F.col("resolution")))
        return r.select("finding_id", place.alias("at"), F.lit(why).alias("why"), F.col("qualified_name").alias("name"), F.col("chunk_id").alias("chunk"), line.alias("line"))

    c = calls.select("call_id", "caller_symbol_id", F.lower("callee_name").alias("callee"), "resolution", "via", "pool", "local_symbol_id", "first_candidates", F.col("path").alias("call_path"), F.col("start_byte").alias("call_start"), F.col("chunk_id").alias("call_chunk"))
    place = ["call_id", "call_path", "call_start", "resolution"]
    ids = asked.select("batch_id", "finding_id")
    here = c.join(home, c["call_chunk"] == home["home_chunk"]).join(ids, "batch_id")
    from_wanted = c.join(found.withColumnRenamed("symbol_id", "caller_symbol_id"), "caller_symbol_id")
    seen = ["batch_id", "finding_id", *place, "first_candidates"]
    calling = here.select(seen).unionByName(from_wanted.select(seen)).dropDuplicates(["finding_id", "call_id"])
    each = calling.select("batch_id", "finding_id", *place, F.posexplode(F.slice("first_candidates", 1, PER_SYMBOL)).alias("i", "symbol_id"))
    legs.append(related(each, "callee", 0))
    in_batch = symbols.select("symbol_id", "chunk_id").join(inside, "chunk_id").select("batch_id", "symbol_id").join(ids, "batch_id").select("batch_id", "finding_id", "symbol_id")
    targets = found.unionByName(in_batch).distinct()
    by = rel.callers(targets, c, symbols).select("batch_id", "finding_id", *place, F.col("caller_symbol_id").alias("symbol_id"), F.lit(0).alias("i")).distinct()
    legs.append(related(by, "caller", 1))
    named = c.join(wanted, F.col("callee") == F.col("suffix")).select("batch_id", "finding_id", *place, F.col("caller_symbol_id").alias("symbol_id"), F.lit(0).alias("i")).distinct()
    legs.append(related(named, "caller", 2))

    kind = legs[1].schema["at"].dataType.simpleString()  # fields that may be null
    every = legs[0].withColumn("at", F.col("at").cast(kind))
    for leg in legs[1:]:
        every = every.unionByName(leg.withColumn("at", F.col("at").cast(kind)))
    first = rel.first_of(every, ["finding_id", "why", "name", "chunk"], ["at", "line"])
    taken = ch.budget_prefix(first.withColumn("size", F.octet_length("line").cast("long")), "finding_id", ["at", "line"], "size", cap)
    lines = F.array_sort(F.collect_list(F.struct("at", "line")))
    return taken.groupBy("finding_id").agg(lines.alias("c")).select("finding_id", F.concat(F.lit("["), F.array_join(F.transform("c", lambda x: x["line"]), ","), F.lit("]")).alias("candidates"))


def _packed(df: DataFrame, ids: str, chunks: DataFrame, cap: int = PACK_CAP) -> DataFrame:
    """Adds evidence and evidence_ids: the listed chunks, known ones once and in order, that fit; what doesn't fit is passed over."""
    each = df.select("finding_id", F.posexplode(F.array_distinct(ids)).alias("pos", "chunk_id")).join(chunks, "chunk_id")
    listed = each.groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "frame"))).alias("l"))
    sizes = F.expr("transform(l, x -> cast(octet_length(x.frame) as bigint))")
    kept = listed.withColumn("at", ch.pack_skip(cap)(sizes)).select("finding_id", F.expr("transform(at, i -> l[i])").alias("k"))
    packed = kept.select("finding_id", F.expr("array_join(transform(k, x -> x.frame), '')").alias("evidence"), F.expr("transform(k, x -> x.chunk_id)").alias("evidence_ids"))
    return df.join(packed, "finding_id", "left").withColumn("evidence", F.coalesce("evidence", F.lit(""))).withColumn("evidence_ids", F.coalesce("evidence_ids", F.expr("cast(array() as array<string>)")))


def run(batches: DataFrame, chunks: DataFrame, symbols: DataFrame, calls: DataFrame, make: Callable[[], Provider], stage: Callable[[DataFrame, str], DataFrame], waits=(0.1, 0.5)) -> dict[str, DataFrame]:
    """findings, telemetry and batch results of all batches.

    ``batches``: batch_id, batch_ordinal, chunk_ids, evidence; ``chunks``:
    chunk_id, frame; ``symbols`` and ``calls`` as candidate_index() takes them.
    ``stage`` writes a table and reads it back: a model is asked once for each
    request. Answers that can't be taken are raised once the others are staged.
    """
    asked = lambda df, purpose, request, name: _taken(stage(ask(df, purpose, make, request, waits), name))
    first = asked(batches, "first_pass", ["batch_id", "evidence"], "first_pass")
    answer = F.from_json("result", f"findings array<struct<{_RESULT.replace(' string', ':string').replace(' array', ':array')}>>")
    each = first.select("batch_id", "batch_ordinal", F.col("chunk_ids").alias("batch_chunks"), F.col("evidence").alias("batch_evidence"), F.posexplode(answer.getField("findings")).alias("pos", "f"))
    found = stage(each.select("batch_id", "batch_ordinal", "batch_chunks", "batch_evidence", (F.col("pos") + 1).alias("ordinal"), "f.*").withColumn("finding_id", finding_id(F.col("batch_id"), F.col("ordinal"), F.col("title"))), "findings")
    telemetry = [_telemetry(first, "analyst", "first_pass", "evidence", "chunk_ids", False)]

    # An empty index means NONE without a call.
    open_ = found.where("status = 'NEED_CONTEXT'").join(candidate_index(found.where("status = 'NEED_CONTEXT'"), batches, symbols, calls), "finding_id")
    chosen = asked(open_, "context_selection", ["finding_id", "title", "reason", "context_symbols", "candidates"], "context")
    telemetry.append(_telemetry(chosen.withColumn("none", F.expr("cast(array() as array<string>)")), "context", "context_selection", "candidates", "none", True))
    pick = F.from_json("result", "status string, chunk_ids array<string>")
    chosen = chosen.select(*found.columns, pick.getField("status").alias("picked"), pick.getField("chunk_ids").alias("picked_ids")).where("picked = 'SELECTED'")
    own = F.filter("chunk_ids", lambda c: F.array_contains("batch_chunks", c))
    ready = _packed(chosen.withColumn("listed", F.concat(own, "picked_ids")), "listed", chunks).where("evidence <> ''")
    refined = asked(ready, "refinement", ["finding_id", "title", "evidence"], "refined")
    telemetry.append(_telemetry(refined, "analyst", "refinement", "evidence", "evidence_ids", True))
    new = F.from_json("result", _RESULT)
    refined = refined.select("finding_id", F.col("evidence_ids").alias("pulled"), *[new.getField(c).alias(f"new_{c}") for c in ("status", "title", "reason", "chunk_ids")])

    now = found.join(refined, "finding_id", "left")
    # A refined answer stands as a whole in the place of the first one.
    for c in ("status", "title", "reason", "chunk_ids"):
        now = now.withColumn(f"now_{c}", F.when(F.col("new_status").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(c)))
    empty = F.expr("cast(array() as array<string>)")
    to_verify = now.where("now_status <> 'CLEAR'").withColumn("listed", F.concat("now_chunk_ids", F.coalesce("pulled", empty), "chunk_ids"))
    to_verify = _packed(to_verify, "listed", chunks)
    whole = F.col("evidence") == ""
    to_verify = to_verify.withColumn("evidence_ids", F.when(whole, F.col("batch_chunks")).otherwise(F.col("evidence_ids"))).withColumn("evidence", F.when(whole, F.col("batch_evidence")).otherwise(F.col("evidence")))
    verified = asked(to_verify, "verification", ["finding_id", "now_title", "now_reason", "evidence"], "verified")
    telemetry.append(_telemetry(verified, "verifier", "verification", "evidence", "evidence_ids", True))
    verdict = verified.select("finding_id", F.from_json("result", "status string").getField("status").alias("verdict"))
    out = now.join(verdict, "finding_id", "left").select(
        "finding_id", "batch_id", "batch_ordinal", F.col("now_title").alias("title"), F.col("now_reason").alias("reason"), F.col("now_chunk_ids").alias("evidence_chunk_ids"),
        F.when(F.col("now_status") == "CLEAR", "REJECTED").otherwise(F.coalesce("verdict", F.lit("INCONCLUSIVE"))).alias("final_status"),
    )
    made = telemetry[0]
    for more in telemetry[1:]:
        made = made.unionByName(more)
    return {"findings": out, "telemetry": made, "batches": first.select("batch_id", "batch_ordinal", F.get_json_object("result", "$.truncated").cast("boolean").alias("truncated"))}


def resume(batches: DataFrame, finished: DataFrame) -> DataFrame:
    """Batches without a finished result of the same id and ordinal."""
    return batches.join(finished.select("batch_id", "batch_ordinal"), ["batch_id", "batch_ordinal"], "left_anti")


MODES = ("selected", "all", "priority")


def batches_of(mode: str, batches: DataFrame, selection: DataFrame, ranked: DataFrame, limit: int | None = None) -> DataFrame:
    """The batches of a mode, ``batch_ordinal`` from 1 in its order: those drawn, all, or all by priority; ``limit``: so many of them."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    if mode == "selected":
        listed = batches.join(selection.select("batch_id", F.col("rank").cast("long").alias("n")), "batch_id")
    elif mode == "all":
        listed = batches.withColumn("n", F.col("batch_ordinal") + 1)
    else:
        listed = batches.join(ranked.select("batch_id", F.col("priority_rank").alias("n")), "batch_id")
    listed = listed.drop("batch_ordinal").withColumnRenamed("n", "batch_ordinal")
    return listed if limit is None else listed.where(F.col("batch_ordinal") <= limit)


def render_faults(batches: DataFrame, chunks: DataFrame) -> DataFrame:
    """Batches whose evidence isn't what was recorded: frames by hash and size, the payload by hash, size and cap."""
    frames = chunks.where((F.sha2("frame", 256) != F.col("frame_sha256")) | (F.octet_length("frame") != F.col("frame_bytes"))).select("chunk_id")
    held = batches.select("batch_id", F.explode("chunk_ids").alias("chunk_id")).join(frames, "chunk_id").select("batch_id", F.lit("frame").alias("fault"))
    wrong = (F.sha2("evidence", 256) != F.col("payload_sha256")) | (F.octet_length("evidence") != F.col("payload_bytes")) | (F.col("payload_bytes") > PACK_CAP)
    return held.unionByName(batches.where(wrong).select("batch_id", F.lit("payload").alias("fault"))).distinct()


def rendered_batches(batches: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """``batches`` with their evidence made from the files' bytes (path, git_blob_oid, raw), and ``fault``: the first of a chunk's, or of the payload's hash, size and cap.

    Only files of the batches' chunks are read through. A batch is bounded by its cap, so its frames come together.
    """
    of = batches.select("batch_id", F.posexplode("chunk_ids").alias("position", "chunk_id"))
    wanted = chunks.join(of.select("chunk_id").distinct(), "chunk_id", "left_semi")
    held = of.join(verify.rendered(wanted, files), "chunk_id", "left").withColumn("fault", F.when(F.col("frame").isNull(), F.coalesce("fault", F.lit("chunk"))))
    per = held.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("position", F.coalesce("frame", F.lit("")).alias("frame")))).alias("l"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("position"))).alias("of_chunk"))
    made = batches.drop("evidence").join(per.select("batch_id", "of_chunk", F.array_join(F.transform("l", lambda x: x["frame"]), "").alias("evidence")), "batch_id", "left").withColumn("evidence", F.coalesce("evidence", F.lit("")))
    fault = (
        F.when(F.col("of_chunk").isNotNull(), F.col("of_chunk")).when(F.octet_length("evidence") != F.col("payload_bytes"), "payload size")
        .when(F.sha2("evidence", 256) != F.col("payload_sha256"), "payload hash").when(F.col("payload_bytes") > PACK_CAP, "payload cap")
    )
    return made.select(*[c for c in batches.columns if c != "evidence"], "evidence", fault.alias("fault"))


def analyse(spark: SparkSession, tables: dict[str, DataFrame], make: Callable[[], Provider], out: str, mode: str = "selected", limit: int | None = None, resumed: bool = False, wave: int = 64, waits=(0.1, 0.5), files: DataFrame | None = None) -> dict:
    """Review the batches of a mode, wave by wave, and write findings, telemetry and a summary to ``out``; gives the summary.

    ``tables``: of build(). Each wave of ``wave`` batches is written before the
    next begins; ``resumed`` leaves out batches that have a result. What a
    stopped run has finished stays, and its summary says so. With ``files`` (path,
    git_blob_oid, raw), evidence is made from their bytes, once for all waves.
    """
    from codegrain.sources import records

    listed = batches_of(mode, tables["batches"], tables["selection"], tables["ranked"], limit)
    if files is None:
        wrong = render_faults(listed, tables["chunks"].select("chunk_id", "frame", "frame_sha256", "frame_bytes"))
    else:
        listed = staged(rendered_batches(listed, tables["chunks"], files), "rendered")
        wrong = listed.where("fault is not null").select("batch_id", "fault")
    if wrong := wrong.limit(5).collect():
        raise ValueError(f"evidence isn't as recorded: {wrong}")
    chunk = lambda df: df.withColumnRenamed("anchor_chunk_id", "chunk_id")
    total, top = listed.count(), f"{out}/waves"
    recovered = spark.read.parquet(f"{top}/*/batches").count() if resumed and records.exists(spark, top) else 0
    if not resumed and records.exists(spark, top):
        raise FileExistsError(f"{top}: resume it, or choose another folder")
    status, number = "COMPLETE", records.count_folders(spark, top)
    try:
        for first in range(1, total + 1, wave):
            todo = listed.where((F.col("batch_ordinal") >= first) & (F.col("batch_ordinal") < first + wave))
            if number:
                todo = resume(todo, spark.read.parquet(f"{top}/*/batches"))
            if todo.isEmpty():
                continue
            at = f"{top}/wave-{number:06d}"

            def stage(df: DataFrame, name: str, at: str = at) -> DataFrame:
                df.write.mode("overwrite").parquet(f"{out}/staged/{at.rsplit('/', 1)[1]}/{name}")
                return spark.read.schema(df.schema).parquet(f"{out}/staged/{at.rsplit('/', 1)[1]}/{name}")

            got = run(todo.select("batch_id", "batch_ordinal", "chunk_ids", "evidence"), tables["chunks"].select("chunk_id", "frame"), chunk(tables["symbols"]), chunk(tables["calls"]), make, stage, waits)
            records.publish(spark, at, lambda to, got=got: [df.write.parquet(f"{to}/{name}") for name, df in got.items()])
            number += 1
    except KeyboardInterrupt:
        status = "INTERRUPTED"
    finally:
        summary = {"status": status, "scan_mode": mode, "batch_target_count": total, "recovered_batch_count": recovered, **(rollup_files(spark, top, out) if number else {})}
        summary["remaining_batch_count"] = total - summary.get("batch_count", 0)
        if summary["remaining_batch_count"] and status == "COMPLETE":
            summary["status"] = "FAILED"
        records.write_pretty(spark, f"{out}/summary.json", summary)
    return summary


def rollup_files(spark: SparkSession, top: str, out: str) -> dict:
    """Write findings.jsonl and telemetry.jsonl, each one ordered file, and give what they amount to."""
    from codegrain.sources import records

    findings, calls, done = (spark.read.parquet(f"{top}/*/{name}") for name in ("findings", "telemetry", "batches"))
    records.write_one(findings, f"{out}/findings.jsonl", ["batch_ordinal", "finding_id"])
    records.write_one(calls, f"{out}/telemetry.jsonl", ["batch_ordinal", "purpose", "finding_id", "agent"])
    count = lambda df, by: {r[0]: r[1] for r in df.groupBy(by).count().orderBy(by).collect()}  # noqa: E731  a row for each name
    per = done.select("batch_id").join(findings.groupBy("batch_id").agg(F.count("*").alias("n"), *[F.max(F.col("final_status") == x).alias(x) for x in ("VERIFIED", "INCONCLUSIVE")]), "batch_id", "left")
    status = F.when(F.col("n").isNull(), "CLEAR").when(F.col("VERIFIED"), "HAS_VERIFIED_FINDING").when(F.col("INCONCLUSIVE"), "INCONCLUSIVE").otherwise("NO_VERIFIED_FINDING")
    sent = calls.withColumn("turn", F.when(F.col("purpose") == "first_pass", 0).otherwise(1))
    tokens = calls.agg(F.coalesce(F.sum("prompt_eval_count"), F.lit(0)), F.coalesce(F.sum("eval_count"), F.lit(0))).first()
    handoff = rollup.handoff(sent, "batch_id", "turn", "evidence_utf8_bytes").first()
    return {
        "batch_count": done.count(), "batch_status_counts": count(per.withColumn("s", status), "s"), "finding_count": findings.count(), "finding_status_counts": count(findings, "final_status"),
        "agent_call_counts": count(calls, "agent"), "purpose_call_counts": count(calls, "purpose"), "truncated_batch_count": done.where("truncated").count(),
        "total_prompt_eval_count": tokens[0], "total_eval_count": tokens[1], "handoff_efficiency": handoff.asDict(),
    }


def dry_run(batches: DataFrame) -> DataFrame:
    """What would be sent: sizes and hashes of the evidence."""
    return batches.select("batch_id", "batch_ordinal", F.octet_length("evidence").cast("long").alias("evidence_bytes"), F.sha2("evidence", 256).alias("evidence_sha256"))


class HttpProvider:
    """A chat endpoint on this machine: POST, no streaming; 429, 5xx and lost connections may be tried again.

    ``digest``: that of the sealed model; check() refuses another. There are as
    many waits as retries.
    """

    def __init__(self, url: str, model: str, timeout: float = 600.0, digest: str | None = None, waits: tuple[float, ...] = (0.1, 0.5), retries: int | None = None, most_bytes: int = 1 << 24) -> None:
        host = url.split("//", 1)[-1].split("/", 1)[0].rsplit(":", 1)[0]
        if host not in ("127.0.0.1", "localhost", "[::1]"):
            raise ValueError("only a loopback address is allowed")
        if retries is not None and retries != len(waits):
            raise ValueError("as many waits as retries")
        if digest is not None and not preflight.DIGEST.fullmatch(digest):
            raise ValueError("not a full digest")
        self.url, self.model, self.timeout, self.digest, self.waits, self.most_bytes = url.rstrip("/"), model, timeout, digest, waits, most_bytes

    def _call(self, path: str, body: dict | None = None) -> dict:
        import urllib.error
        import urllib.request

        data = None if body is None else dump_canonical(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url + path, data, {"Content-Type": "application/json"}), timeout=self.timeout) as r:
                raw = r.read(self.most_bytes + 1)
        except urllib.error.HTTPError as e:
            raise ProviderError(f"HTTP {e.code}", e.code == 429 or e.code >= 500) from e
        except OSError as e:
            raise ProviderError(str(e), True) from e
        text = raw.decode()
        if len(raw) > self.most_bytes or (wrong := strict_json(text)):
            raise ProviderError("too long an answer" if len(raw) > self.most_bytes else wrong, False)
        return json.loads(text)

    def metadata(self) -> dict:
        """What the server says of itself: version, tags, show and ps."""
        return {"version": self._call("/api/version"), "tags": self._call("/api/tags"), "show": self._call("/api/show", {"model": self.model, "verbose": True}), "ps": self._call("/api/ps")}

    def check(self) -> None:
        """Refuse a server without the sealed model."""
        if preflight.the_model(self._call("/api/tags"), self.model)["digest"] != (self.digest or ""):
            raise preflight.Refused("another digest than the sealed one")

    def chat(self, purpose: str, request: dict) -> dict:
        content = dump_canonical({"purpose": purpose, **request})
        got = self._call("/api/chat", {"model": self.model, "stream": False, "format": SCHEMAS[purpose], "messages": [{"role": "user", "content": content}]})
        if wrong := preflight.answer_fault(got, self.model):
            raise ProviderError(wrong, False)
        return {"result": json.loads(got["message"]["content"]), "prompt_tokens": got["prompt_eval_count"], "output_tokens": got["eval_count"]}
