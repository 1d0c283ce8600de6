"""From files to chunks, batches, an index and a ranking: each step a table, in the order that a run takes them.

    chunks -> batches -> selection -> index -> resolved calls and includes -> ranked batches

Every id is a hash of what it names, under a domain that the caller chooses.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.functions.text import byte_length, canonical_json
from codegrain.operators import chunks as ch
from codegrain.operators import relations as rel
from codegrain.operators import scoring
from codegrain.operators.ordering import source_order
from codegrain.operators.structure import CAP, FACTS, chunk_files, extract_files
from codegrain.sources import committed, records
from codegrain.sources.staging import staged

# Prefixes of ids, the most bytes of a batch, and the unit in which batches are measured.
PREFIXES = {"chunk": "C1-", "batch": "B1-", "symbol": "S1-", "call": "E1-", "include": "I1-"}
BATCH_CAP = 8192
COUNTER = "utf8_byte_upper_bound_v1"


@dataclass(frozen=True)
class Target:
    """What a build is made from, part of every id; and the domain of its hashes."""

    commit: str = ""
    scope: str = ""
    domain: str = "codegrain"


def identity(target: Target, what: str, **fields: Column) -> Column:
    """sha256 of the domain and the fields' canonical JSON, the target's included."""
    fields |= {"target_commit_sha": F.lit(target.commit), "target_scope_sha256": F.lit(target.scope)}
    return F.sha2(F.concat_ws("\0", F.lit(f"{target.domain}/{what}"), canonical_json(**fields)), 256)


def short_id(what: str, full: Column) -> Column:
    return F.concat(F.lit(PREFIXES[what]), F.substring(full, 1, 24))


def frame(content: Column) -> Column:
    """The evidence frame of a chunk: a header line, six fields as JSON, and the fenced content."""
    head = canonical_json(**{c: F.col(c) for c in ("chunk_id", "end_line", "kind", "path", "start_line")}, content_sha256=F.col("raw_sha256"))
    return F.concat(F.lit("@@CHUNK "), head, F.lit("\n<<<CODE\n"), content, F.lit("\nCODE>>>\n"))


def chunk_records(files: DataFrame, target: Target, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """(file records, chunk records) of ``files`` (path, git_blob_oid, raw); to be staged by the caller, as both read the scan."""
    spans = chunk_files(files.select("path", "raw"), cap=cap)
    oids = files.select("path", "git_blob_oid")
    chunks = spans.where("ordinal is not null").join(oids, "path")
    fields = {c: F.col(c) for c in ("path", "git_blob_oid", "kind", "start_byte")}
    full = identity(target, "chunk", **fields, end_byte_exclusive=F.col("end_byte"), raw_content_sha256=F.col("raw_sha256"))
    chunks = chunks.withColumn("chunk_identity_sha256", full).withColumn("chunk_id", short_id("chunk", F.col("chunk_identity_sha256")))
    chunks = chunks.withColumn("frame", frame(F.col("content"))).withColumn("frame_sha256", F.sha2("frame", 256)).withColumn("frame_bytes", byte_length(F.col("frame")))
    per = spans.groupBy("path").agg(
        *[F.first(c).alias(c) for c in ("outcome", "fallback_reason", "language", "encoding", "attempts", "file_bytes")],
        F.count("ordinal").alias("chunk_count"),
        F.coalesce(F.sum(F.col("end_byte") - F.col("start_byte")), F.lit(0)).alias("covered_bytes"),
    )
    return per.join(oids, "path"), chunks


def file_status(outcome: Column, encoding: Column) -> Column:
    """How a file is indexed: without a tree, with a faulty one, or fully."""
    return F.when(encoding != "utf-8", "NO_AST_NON_UTF8").when(outcome == "PARSE_SUCCESS", "INDEXED").when(F.col("fallback_reason") == "empty_blob", "INDEXED").otherwise("PARTIAL_DIAGNOSTIC")


def batch_records(ordered: DataFrame, target: Target, cap: int = BATCH_CAP, stage=staged) -> DataFrame:
    """Batches of chunk records that have ``ordinal`` (their place in source order): next-fit by frame bytes.

    batch_id, batch_ordinal, chunk_ids (in order), chunk_count, ordered and
    payload hashes, payload_bytes, evidence (the frames joined).
    """
    sized = ordered.select("ordinal", "frame_bytes", "chunk_id", "chunk_identity_sha256", "frame")
    dealt = ch.next_fit(sized, "ordinal", "frame_bytes", cap, stage=stage)
    # A batch is bounded by its cap, so its frames come together.
    one = F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id", "chunk_identity_sha256", "frame")))
    per = dealt.groupBy("batch_ordinal").agg(one.alias("l")).select(
        "batch_ordinal",
        F.transform("l", lambda x: x["chunk_id"]).alias("chunk_ids"),
        F.sha2(F.array_join(F.transform("l", lambda x: x["chunk_identity_sha256"]), "\0"), 256).alias("ordered_chunk_identity_sha256"),
        F.array_join(F.transform("l", lambda x: x["frame"]), "").alias("evidence"),
    )
    per = per.withColumn("chunk_count", F.size("chunk_ids").cast("long")).withColumn("payload_sha256", F.sha2("evidence", 256)).withColumn("payload_bytes", byte_length(F.col("evidence")))
    hashes = {c: F.col(c) for c in ("ordered_chunk_identity_sha256", "payload_sha256")}
    full = identity(target, "batch", **hashes, budget_counter=F.lit(COUNTER), max_payload_utf8_bytes=F.lit(cap), payload_utf8_bytes=F.col("payload_bytes"))
    return per.withColumn("batch_identity_sha256", full).withColumn("batch_id", short_id("batch", F.col("batch_identity_sha256")))


def membership(batches: DataFrame) -> DataFrame:
    """batch_id, position, chunk_id."""
    return batches.select("batch_id", F.posexplode("chunk_ids").alias("position", "chunk_id"))


def selection(batches: DataFrame, seed: str, n: int = 3, domain: str = "codegrain/selection") -> DataFrame:
    """rank (from 1), batch_id of the batches that are drawn."""
    drawn = scoring.hash_sample(batches.select("batch_id"), "batch_id", domain, seed, n)
    return drawn.agg(F.array_sort(F.collect_list(F.struct("rank_hash", "batch_id"))).alias("l")).select(F.posexplode("l").alias("p", "x")).select((F.col("p") + 1).cast("long").alias("rank"), F.col("x.batch_id").alias("batch_id"))


def coverage(files: DataFrame, chunks: DataFrame, batches: DataFrame) -> DataFrame:
    """One row: files by outcome, chunks, batches, bytes, and chunks by kind (a sorted map)."""
    outcome = lambda o: F.coalesce(F.sum((F.col("outcome") == o).cast("long")), F.lit(0))
    f = files.agg(
        F.count("*").alias("source_file_count"), outcome("PARSE_SUCCESS").alias("parse_success"), outcome("FALLBACK_SUCCESS").alias("fallback_success"), outcome("TERMINAL_ERROR").alias("terminal_error"),
        F.coalesce(F.sum("file_bytes"), F.lit(0)).alias("source_bytes"), F.coalesce(F.sum("covered_bytes"), F.lit(0)).alias("mapped_source_bytes"),
    )
    c = chunks.groupBy("kind").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunk_count"), sorted_counts("kind", "n").alias("chunk_kind_counts"))
    return f.crossJoin(c).crossJoin(batches.agg(F.count("*").alias("batch_count")))  # one row each


def sorted_counts(name: str, n: str) -> Column:
    """An aggregate: a map of names to counts, names in order."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name).alias("key"), F.col(n).alias("value")))))


# ---------------------------------------------------------------- index


def _anchored(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds anchor_chunk_id, and the first, the last and the number of chunks that a row's extent touches."""
    one = chunks.select("path", F.col("start_byte").alias("b_start"), F.col("end_byte").alias("b_end"), "chunk_id", "file_bytes")
    points = rows.join(chunks.select("path", "file_bytes").distinct(), "path")
    at = rel.asof(points.withColumn("_at", F.col("start_byte")).withColumnRenamed("file_bytes", "_size"), one.withColumnRenamed("chunk_id", "anchor_chunk_id").drop("file_bytes"), "path", "_at", "b_start", "b_end", "_size").drop("b_start", "b_end", "_at", "_size")
    touched = rel.overlaps(rows.select("path", F.col("start_byte").alias("a_start"), F.col("end_byte").alias("a_end")).distinct(), one, "path")
    by_place = F.struct("b_start", "chunk_id")
    touched = touched.groupBy("path", "a_start", "a_end").agg(F.min(by_place)["chunk_id"].alias("first_chunk_id"), F.max(by_place)["chunk_id"].alias("last_chunk_id"), F.count("*").alias("extent_chunk_count"))
    touched = touched.withColumnRenamed("a_start", "start_byte").withColumnRenamed("a_end", "end_byte")
    return at.join(touched, ["path", "start_byte", "end_byte"])


def in_order(rows: DataFrame, ordered: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``rows`` sorted by their chunk's place in source order, which they get as ``chunk_ordinal``."""
    return rows.join(ordered.select(key, F.col("ordinal").alias("chunk_ordinal")), key).orderBy("chunk_ordinal")


def index(files: DataFrame, file_records: DataFrame, chunks: DataFrame, ordered: DataFrame, target: Target, stage) -> dict[str, DataFrame]:
    """symbols, calls, includes, chunk_facts, file_index of ``files`` (path, git_blob_oid, raw). ``stage`` writes a table and reads it back.

    ``ordered``: chunk_id and ordinal, its place in source order; chunk_facts are written in that order.
    """
    readable = files.join(file_records.where("encoding = 'utf-8'").select("path"), "path").select("path", F.col("raw").cast("string").alias("text"))
    found = stage(extract_files(readable), "extracted")
    oids = files.select("path", "git_blob_oid")
    of = lambda tag: found.where(F.col("tag") == tag).drop("tag").join(oids, "path")
    place = {c: F.col(c) for c in ("path", "git_blob_oid", "start_byte")} | {"end_byte_exclusive": F.col("end_byte")}

    s = of("symbol").withColumnRenamed("kind", "symbol_kind").withColumnRenamed("expression", "signature")
    s = s.withColumn("symbol_identity_sha256", identity(target, "symbol", **place, **{c: F.col(c) for c in ("symbol_kind", "role", "name", "qualified_name")}))
    s = s.withColumn("symbol_id", short_id("symbol", F.col("symbol_identity_sha256"))).withColumn("parameter_count", F.size("parameters").cast("long"))
    symbols = stage(_anchored(s.drop("caller", "caller_start_byte"), chunks), "symbols")

    c = of("call").withColumnRenamed("name", "callee_name").withColumnRenamed("expression", "callee_expression")
    callers = symbols.where("symbol_kind = 'FUNCTION' and role = 'DEFINITION'").select("path", F.col("start_byte").alias("caller_start_byte"), F.col("qualified_name").alias("caller"), F.col("symbol_id").alias("caller_symbol_id"))
    c = c.join(callers, ["path", "caller_start_byte", "caller"])
    c = c.withColumn("call_identity_sha256", identity(target, "call", **place, **{x: F.col(x) for x in ("caller_symbol_id", "callee_expression")})).withColumn("call_id", short_id("call", F.col("call_identity_sha256")))
    c = c.select("call_id", "caller_symbol_id", "callee_name", "callee_expression", "kind", "path", "git_blob_oid", "conditional_depth", "start_byte", "end_byte")
    calls = stage(rel.resolve_calls(_anchored(c, chunks), symbols), "calls")

    i = of("include").withColumnRenamed("name", "target").withColumnRenamed("expression", "spelling")
    i = i.withColumn("include_identity_sha256", identity(target, "include", **place, include_spelling=F.col("spelling"))).withColumn("include_id", short_id("include", F.col("include_identity_sha256")))
    i = i.select("include_id", "spelling", "target", "path", "git_blob_oid", "conditional_depth", "start_byte", "end_byte")
    includes = stage(rel.resolve_links(_anchored(i, chunks), files.select("path")), "includes")

    points = found.where("tag = 'fact'").select("path", F.col("name").alias("fact"), "start_byte")
    facts = stage(in_order(chunk_facts(points, chunks, symbols, calls, file_records), ordered), "chunk-facts")
    count = lambda df, name: df.groupBy("path").agg(F.count("*").alias(name))
    records = file_records.select("path", "language", "encoding", "outcome", "chunk_count", file_status(F.col("outcome"), F.col("encoding")).alias("index_status"))
    for df, name in ((symbols, "symbol_count"), (calls, "call_count"), (includes, "include_count")):
        records = records.join(count(df, name), "path", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return {"symbols": symbols, "calls": calls, "includes": includes, "chunk_facts": facts, "file_index": records}


def fact_counts(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, size: str, span: str, fact: str, names=FACTS) -> DataFrame:
    """Counters by name of each span that holds a point: key, span, one column for each name, and ``total``."""
    held = rel.asof(points, spans.select(key, span, start, end), key, at, start, end, size)
    n = lambda name: F.sum((F.col(fact) == name).cast("long"))
    return held.groupBy(key, span).agg(*[n(x).alias(x) for x in names], F.count("*").alias("total"))


def attached(rows: DataFrame, key: list[str], value: str, name: str, spans: DataFrame) -> DataFrame:
    """``spans`` with the sorted ids of the rows that belong to each, an empty array where there are none."""
    listed = rows.groupBy(*key).agg(F.sort_array(F.collect_list(value)).alias(name))
    none = F.array().cast(listed.schema[name].dataType)
    return spans.join(listed, key, "left").withColumn(name, F.coalesce(name, none))


def chunk_facts(points: DataFrame, chunks: DataFrame, symbols: DataFrame, calls: DataFrame, file_records: DataFrame) -> DataFrame:
    """A row for each chunk: extraction_mode, the counters, defined_symbol_ids, outgoing_call_ids."""
    sized = points.join(chunks.select("path", "file_bytes").distinct(), "path")
    counts = fact_counts(sized.withColumnRenamed("start_byte", "at"), chunks, "path", "at", "start_byte", "end_byte", "file_bytes", "chunk_id", "fact")
    mode = F.when(F.col("encoding") != "utf-8", "NO_AST_NON_UTF8").when(F.col("outcome") == "PARSE_SUCCESS", "CLEAN_AST").otherwise("PARTIAL_DIAGNOSTIC_AST")
    out = chunks.select("chunk_id", "path", "ordinal", mode.alias("extraction_mode")).join(counts, ["path", "chunk_id"], "left")
    out = out.select("chunk_id", "path", "ordinal", "extraction_mode", *[F.coalesce(c, F.lit(0)).alias(c) for c in (*FACTS, "total")])
    out = attached(symbols.withColumnRenamed("anchor_chunk_id", "chunk_id"), ["chunk_id"], "symbol_id", "defined_symbol_ids", out)
    return attached(calls.withColumnRenamed("anchor_chunk_id", "chunk_id"), ["chunk_id"], "call_id", "outgoing_call_ids", out)


def without_facts(facts: DataFrame, includes: DataFrame) -> DataFrame:
    """Chunks that define nothing, call nothing, include nothing and have all counters at 0."""
    bare = facts.where((F.size("defined_symbol_ids") == 0) & (F.size("outgoing_call_ids") == 0) & (F.col("total") == 0))
    return bare.join(includes.select(F.col("anchor_chunk_id").alias("chunk_id")).distinct(), "chunk_id", "left_anti")


def batch_map(chosen: DataFrame, batches: DataFrame, chunks: DataFrame, idx: dict[str, DataFrame]) -> DataFrame:
    """A row for each drawn batch: rank, chunk ids in order, and the ids of what is anchored or stands in it. Drawn batches are few and bounded."""
    of = F.broadcast(membership(batches).join(chosen, "batch_id").select("rank", "batch_id", "chunk_id"))
    anchored = lambda df, i, name: df.join(of, df["anchor_chunk_id"] == of["chunk_id"]).groupBy("rank").agg(F.sort_array(F.collect_set(i)).alias(name))
    spans = chunks.join(of.drop("batch_id"), "chunk_id").select("path", "rank", F.col("start_byte").alias("b_start"), F.col("end_byte").alias("b_end"))
    extents = idx["symbols"].select("path", "symbol_id", F.col("start_byte").alias("a_start"), F.col("end_byte").alias("a_end"))
    enclosing = rel.overlaps(extents, spans, "path").groupBy("rank").agg(F.sort_array(F.collect_set("symbol_id")).alias("enclosing_symbol_ids"))
    empty = without_facts(idx["chunk_facts"], idx["includes"]).join(of, "chunk_id").groupBy("rank").agg(F.sort_array(F.collect_set("chunk_id")).alias("chunks_without_facts"))
    out = chosen.join(batches.select("batch_id", "chunk_ids", "payload_bytes"), "batch_id")
    for part in (anchored(idx["symbols"], "symbol_id", "anchor_symbol_ids"), enclosing, anchored(idx["calls"], "call_id", "call_ids"), anchored(idx["includes"], "include_id", "include_ids"), empty):
        name = part.columns[-1]
        out = out.join(part, "rank", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


# ---------------------------------------------------------------- ranking


def cross_targets(calls: DataFrame, symbols: DataFrame, paths: DataFrame, batch: str) -> DataFrame:
    """By batch, how many distinct candidates of its calls are defined in files that the batch has no part of.

    ``calls``: resolved calls with ``batch``; ``paths``: batch, path; a symbol_id
    is one symbol's. No batch meets the symbols of its pools: a batch adds up its
    pools' sizes and takes off what they have in its own files. A symbol can be
    in two pools, that of its name and that of its qualified name; what is in
    both is counted once by taking it off again. The rows are a batch's pools
    times its files, both bounded by the batch.
    """
    wanted = staged(calls.where("via is not null").select(batch, "via", "pool", "local_symbol_id").distinct(), "wanted-pools")
    whole = wanted.where("local_symbol_id is null").select(batch, "via", "pool")
    defined = symbols.where("symbol_kind = 'FUNCTION' and role = 'DEFINITION' and path <> ''").select("symbol_id", "name", "qualified_name", "path").distinct()
    # Groups of symbols: a pool, or two pools' common part; how many there are in each file, and in all, whose path is ''.
    group = lambda via, pool, name: F.struct(F.lit(via).alias("via"), pool.alias("pool"), name.alias("name"))
    none, name, qualified = F.lit(""), F.col("name"), F.col("qualified_name")
    groups = F.explode(F.array(group("name", name, none), group("qualified", qualified, none), group("both", qualified, name)))
    sizes = defined.select(groups.alias("g"), F.explode(F.array(F.col("path"), none)).alias("path")).where("g.pool is not null and g.name is not null").groupBy("g.via", "g.pool", "g.name", "path").agg(F.count("*").alias("n"))
    both = defined.where("name is not null").select(F.col("qualified_name").alias("pool"), "name").distinct()
    both = whole.where("via = 'qualified'").join(both, "pool").join(whole.where("via = 'name'").select(batch, F.col("pool").alias("name")), [batch, "name"], "left_semi")
    asked = whole.select(batch, "via", "pool", none.alias("name"), F.lit(1).alias("sign")).unionByName(both.select(batch, F.lit("both").alias("via"), "pool", "name", F.lit(-1).alias("sign")))
    own = paths.select(batch, "path")
    places = own.where("path <> ''").unionByName(whole.select(batch, none.alias("path"))).distinct()
    n = F.col("sign") * F.when(F.col("path") == "", F.col("n")).otherwise(-F.col("n"))
    pooled = asked.join(places, batch).join(sizes, ["via", "pool", "name", "path"]).select(batch, n.alias("n"))
    # Symbols that a file has for itself, where no pool of the batch has them.
    alone = wanted.where("local_symbol_id is not null").select(batch, F.col("local_symbol_id").alias("symbol_id")).distinct().join(defined, "symbol_id").join(own.distinct(), [batch, "path"], "left_anti")
    for via, c in (("name", "name"), ("qualified", "qualified_name")):
        alone = alone.join(whole.where(F.col("via") == via).select(batch, F.col("pool").alias(c)), [batch, c], "left_anti")
    alone = alone.select(batch, F.lit(1).cast("long").alias("n"))
    return pooled.unionByName(alone).groupBy(batch).agg(F.sum("n").alias("cross_file_target_count")).where("cross_file_target_count > 0")


def rank(batches: DataFrame, chunks: DataFrame, calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every batch with its score, the score's components, the sensitive names and categories of its calls (sorted maps) and its rank."""
    of = membership(batches).select("batch_id", "chunk_id")
    paths = of.join(chunks.select("chunk_id", "path"), "chunk_id").select("batch_id", "path").distinct()
    own = calls.join(of, calls["anchor_chunk_id"] == of["chunk_id"]).drop("chunk_id")
    hit = scoring.rule(F.col("callee_name"), scoring.exact_rules(), scoring.SENSITIVE_PREFIXES)
    own = own.withColumn("hit", hit)
    ambiguous = F.col("resolution").isin("AMBIGUOUS", "MACRO_OR_FUNCTION_AMBIGUOUS", "MEMBER_OR_QUALIFIED")
    counts = own.groupBy("batch_id").agg(
        F.sum(F.coalesce("hit.weight", F.lit(0))).alias("sensitive_weight"), F.sum(ambiguous.cast("long")).alias("ambiguous_resolution_count"),
        F.sum((F.col("resolution") == "INDIRECT_OR_DYNAMIC").cast("long")).alias("indirect_dynamic_call_count"), F.count("*").alias("call_count"),
    )
    maps = lambda c, name: own.where("hit is not null").groupBy("batch_id", c.alias("k")).agg(F.count("*").alias("n")).groupBy("batch_id").agg(sorted_counts("k", "n").alias(name))
    out = batches.select("batch_id", "batch_ordinal", "chunk_count")
    for part in (counts, cross_targets(own, symbols, paths, "batch_id"), maps(F.col("hit.category"), "sensitive_categories"), maps(F.col("callee_name"), "sensitive_names")):
        out = out.join(part, "batch_id", "left")
    numbers = ("sensitive_weight", "cross_file_target_count", "indirect_dynamic_call_count", "ambiguous_resolution_count", "call_count")
    out = out.select("batch_id", "batch_ordinal", "chunk_count", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], *[F.coalesce(c, F.create_map().cast("map<string,bigint>")).alias(c) for c in ("sensitive_categories", "sensitive_names")])
    cols = scoring.score(dict(zip(("sensitive", "cross_file", "indirect", "ambiguous", "calls"), map(F.col, numbers))))
    return scoring.ranked(out.select("*", *[c.alias(k if k == "priority_score" else f"score_{k}") for k, c in cols.items()]), "batch_id")


def rank_summary(ranked: DataFrame, top: int = 20) -> dict:
    """What a ranking amounts to: how many batches, and the first ``top`` (a report of bounded size)."""
    first = ranked.orderBy("priority_rank").limit(top).collect()
    return {"status": "PASS", "batch_count": ranked.count(), "top_batches": [r.asDict(True) for r in first]}


# ---------------------------------------------------------------- whole builds


def build(files: DataFrame, target: Target, stage, seed: str = "0", cap: int = CAP, batch_cap: int = BATCH_CAP, upstream=None) -> dict[str, DataFrame]:
    """All tables of ``files`` (path, git_blob_oid, raw): files, chunks, batches, selection, the index, batch_map and ranked.

    ``upstream(files, records, chunks, batches, selection)``: a table of faults;
    the index is built only where it is empty.
    """
    records, chunks = chunk_records(files, target, cap)
    records, chunks = stage(records, "files"), stage(chunks, "chunks")
    wrong = records.where("outcome = 'TERMINAL_ERROR' or covered_bytes <> file_bytes").select("path", "outcome", "fallback_reason").limit(5).collect()
    if wrong:
        raise ValueError(f"files that can't be covered: {wrong}")
    ordered = source_order(chunks.withColumnRenamed("ordinal", "file_ordinal"), "path", "start_byte", "end_byte", "chunk_id", stage=stage)
    batches = stage(batch_records(ordered, target, batch_cap, stage), "batches")
    chosen = stage(selection(batches, seed), "selection")
    if upstream and (wrong := upstream(files, records, chunks, batches, chosen).limit(5).collect()):
        raise ValueError(f"no index of faulty chunks: {[tuple(r) for r in wrong]}")
    idx = index(files, records, chunks, ordered, target, stage)
    return {"files": records, "chunks": chunks, "batches": batches, "selection": chosen, **idx, "batch_map": batch_map(chosen, batches, chunks, idx), "ranked": rank(batches, chunks, idx["calls"], idx["symbols"])}


def twice(make, keys: dict[str, list[str]]) -> dict[str, int]:
    """Rows that only one of two builds has, by table, for the tables and columns of ``keys``; all 0 if builds repeat."""
    a, b = make(), make()
    only = {name: rel.equal_tables(a[name].select(*cols), b[name].select(*cols)).first() for name, cols in keys.items()}
    return {name: r["only_first"] + r["only_second"] for name, r in only.items()}


TABLES = ("files", "chunks", "batches", "selection", "symbols", "calls", "includes", "chunk_facts", "file_index", "batch_map", "ranked")


def save(tables: dict[str, DataFrame], folder: str, frozen_by: str | None = None, refreeze: bool = False) -> int:
    """Commit the tables together; gives the version.

    Tables that are there already are replaced only with ``refreeze``, and only
    while they are as they were committed. Nothing is written once ``frozen_by``,
    the results made from them, exists.
    """
    spark = next(iter(tables.values())).sparkSession
    if frozen_by and records.exists(spark, frozen_by):
        raise FileExistsError(f"{frozen_by} exists; what it was made from is frozen")
    last = committed.latest(spark, folder)
    if last and refreeze:
        committed.folder(spark, folder)
    return committed.commit(spark, folder, lambda at: [df.write.parquet(f"{at}/{name}") for name, df in tables.items()], last["version"] if last and refreeze else 0)


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the last build that was committed."""
    at = committed.folder(spark, folder)
    return {name: spark.read.parquet(f"{at}/{name}") for name in TABLES}
