"""Checks of a build by a second way of reckoning: tables of (rule, key) that are empty when everything holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codegrain.functions.text import from_cp1252
from codegrain.operators import build, scoring, validate
from codegrain.operators.scope import PROTECTED
from codegrain.operators.structure import CAP, FACTS

# Kinds of chunks, and the node types that some of them must have.
CHUNK_KINDS = ("FUNCTION", "TYPE", "MACRO", "DECLARATION", "PREPROCESSOR", "NAMESPACE", "TEMPLATE", "LINKAGE", "AST_BLOCK", "LINE_WINDOW", "STRUCTURAL_GROUP")
NODE_TYPES = {"MACRO": ("preproc_def", "preproc_function_def"), "FUNCTION": ("function_definition",)}


def _rule(df: DataFrame, name: str, fault: Column, *key: str) -> DataFrame:
    return df.where(fault).select(F.lit(name).alias("rule"), F.concat_ws("/", *[F.col(k).cast("string") for k in key]).alias("key"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def kind_fault(kind: Column, node_type: Column, kinds: Column, outcome: Column) -> Column:
    """Whether a chunk's kind goes with its node type, its parts' kinds and how its file was read."""
    wrong = ~kind.isin(*CHUNK_KINDS)
    for k, types in NODE_TYPES.items():
        wrong |= (kind == k) & ~node_type.isin(*types)
    wrong |= (kind == "LINE_WINDOW") & (outcome != "FALLBACK_SUCCESS")
    return wrong | (kind == "STRUCTURAL_GROUP") & F.arrays_overlap(kinds, F.array(*map(F.lit, PROTECTED)))


def _places(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """By path and place where a chunk begins or ends: n_before (newlines before it) and line_start (where its line begins).

    A file is cut at these places once; a piece's newlines are counted in it, and
    a running sum over the pieces gives those before each place.
    """
    own = chunks.select("path", F.explode(F.array("start_byte", "end_byte")).alias("place")).groupBy("path").agg(F.collect_set("place").alias("places"))
    size = F.octet_length("raw").cast("long")
    cuts = F.array_sort(F.filter(F.array_union(F.array(F.lit(0).cast("long"), size), "places"), lambda p: (p >= 0) & (p <= size)))
    pieces = files.join(own, "path").withColumn("cuts", cuts).select("path", "raw", "cuts", F.posexplode("cuts").alias("i", "place"))
    piece = F.expr("decode(substring(raw, cast(place + 1 as int), cast(coalesce(get(cuts, i + 1), place) - place as int)), 'ISO-8859-1')")  # a character for each byte
    text = pieces.select("path", "place", piece.alias("text"))
    n = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    counted = text.select("path", "place", n.cast("long").alias("n"), F.when(n > 0, F.col("place") + F.length("text") - F.length(F.substring_index("text", "\n", -1))).alias("last"))
    before = Window.partitionBy("path").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("path", "place", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.max("last").over(before), F.lit(0)).alias("line_start"))


def _sliced(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id, true_oid, file_size and bytes of every chunk: a file meets the list of its chunks, and each gets its own bytes only."""
    listed = chunks.groupBy("path").agg(F.collect_list(F.struct("chunk_id", "start_byte", "end_byte")).alias("spans"))
    rows = listed.join(files.select("path", F.col("git_blob_oid").alias("true_oid"), "raw"), "path", "left").select("true_oid", "raw", F.explode("spans").alias("s"))
    part = F.expr("substring(raw, cast(s.start_byte + 1 as int), cast(s.end_byte - s.start_byte as int))")
    return rows.select("s.chunk_id", "true_oid", F.octet_length("raw").alias("file_size"), part.alias("bytes"))


def rendered(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """chunk_id, frame, fault: evidence made anew from the files' bytes, and the first thing in which it isn't what was recorded.

    A file's bytes meet the list of its wanted chunks once. A chunk whose file is
    missing or another has no frame; nor have bytes of another hash.
    """
    part = _sliced(files, chunks)
    own = chunks.select("chunk_id", "path", "start_byte", "end_byte", "kind", "start_line", "end_line", "encoding", "git_blob_oid", "raw_sha256", "frame_sha256", "frame_bytes").join(part, "chunk_id", "left")
    content = F.when(F.col("encoding") == "utf-8", F.col("bytes").cast("string")).when(F.col("encoding") == "cp1252", from_cp1252(F.col("bytes")))
    made = own.withColumn("frame", build.frame(content))
    fault = (
        F.when(F.col("file_size").isNull(), "file").when(~F.col("true_oid").eqNullSafe(F.col("git_blob_oid")), "blob")
        .when(~F.col("encoding").isin("utf-8", "cp1252"), "encoding")
        .when(~F.sha2("bytes", 256).eqNullSafe(F.col("raw_sha256")), "raw hash")
        .when(~F.sha2("frame", 256).eqNullSafe(F.col("frame_sha256")), "frame hash")
        .when(~F.octet_length("frame").eqNullSafe(F.col("frame_bytes").cast("int")), "frame size")
    )
    return made.select("chunk_id", "frame", fault.alias("fault")).withColumn("frame", F.when(F.col("fault").isNull(), F.col("frame")))


def chunk_faults(files: DataFrame, records: DataFrame, chunks: DataFrame, batches: DataFrame, selection: DataFrame, target: build.Target, seed: str, cap: int = CAP, batch_cap: int = build.BATCH_CAP) -> DataFrame:
    """What is wrong with chunks, batches and selection, reckoned anew from the files' bytes."""
    raw = files.select("path", F.col("git_blob_oid").alias("true_oid"), "raw")
    at, end = F.col("start_byte"), F.col("end_byte")
    own = chunks.join(_sliced(files, chunks), "chunk_id")
    utf8 = F.col("encoding") == "utf-8"
    rules = [
        _rule(own, "file", F.col("file_size").isNull() | (F.col("true_oid") != F.col("git_blob_oid")), "chunk_id"),
        _rule(own, "range", ~((at >= 0) & (at < end) & (end <= F.col("file_size"))), "chunk_id"),
        _rule(own, "raw content hash", F.sha2("bytes", 256) != F.col("raw_sha256"), "chunk_id"),
        _rule(own, "content", utf8 & (F.col("bytes").cast("string") != F.col("content")) | (F.octet_length("content") != F.col("content_bytes")), "chunk_id"),
        _rule(own, "unit", ~((F.col("unit_start_byte") <= at) & (end <= F.col("unit_end_byte"))), "chunk_id"),
        _rule(chunks, "kind and node type", kind_fault(F.col("kind"), F.col("node_type"), F.col("kinds"), F.col("outcome")), "chunk_id"),
        _rule(chunks, "cap", F.col("content_bytes") > cap, "chunk_id"),
    ]
    places = _places(files, chunks)
    of = lambda name: places.select("path", F.col("place").alias(name), F.col("n_before").alias(f"{name}_n"), F.col("line_start").alias(f"{name}_line"))
    placed = chunks.join(of("start_byte"), ["path", "start_byte"]).join(of("end_byte"), ["path", "end_byte"])
    # The last byte's line is that of the end, but for a newline that stands there.
    ends_line = (F.col("end_byte_line") == end).cast("long")
    rules.append(
        _rule(
            placed, "lines",
            (F.col("start_line") != F.col("start_byte_n") + 1) | (F.col("start_column") != at - F.col("start_byte_line")) | (F.col("end_line") != F.col("end_byte_n") + 1 - ends_line)
            | (F.col("end_point_line") != F.col("end_byte_n") + 1) | (F.col("end_column") != end - F.col("end_byte_line")), "chunk_id",
        )
    )
    full = build.identity(target, "chunk", path=F.col("path"), git_blob_oid=F.col("git_blob_oid"), kind=F.col("kind"), start_byte=at, end_byte_exclusive=end, raw_content_sha256=F.col("raw_sha256"))
    rules.append(_rule(chunks, "chunk identity", (full != F.col("chunk_identity_sha256")) | (F.concat(F.lit(build.PREFIXES["chunk"]), F.substring("chunk_identity_sha256", 1, 24)) != F.col("chunk_id")), "chunk_id"))
    text = build.frame(F.col("content"))
    rules.append(_rule(chunks, "frame", (F.sha2(text, 256) != F.col("frame_sha256")) | (F.octet_length(text) != F.col("frame_bytes")), "chunk_id"))
    rules.append(_rule(chunks.groupBy("chunk_id").count(), "repeated chunk", F.col("count") > 1, "chunk_id"))

    order = Window.partitionBy("path").orderBy("start_byte")
    run = chunks.select("path", "ordinal", "start_byte", "end_byte", F.coalesce(F.lag("end_byte").over(order), F.lit(0)).alias("cursor"), (F.row_number().over(order) - 1).alias("nth"))
    rules.append(_rule(run, "partition", (F.col("cursor") != F.col("start_byte")) | (F.col("nth") != F.col("ordinal")), "path", "start_byte"))
    per = chunks.groupBy("path").agg(F.count("*").alias("n"), F.sum(end - at).alias("covered"))
    kept = records.join(per, "path", "left").join(raw, "path", "full")
    same = F.coalesce((F.col("file_bytes") == F.octet_length("raw")) & (F.col("covered_bytes") == F.octet_length("raw")) & (F.coalesce("covered", F.lit(0)) == F.octet_length("raw")) & (F.col("chunk_count") == F.coalesce("n", F.lit(0))), F.lit(False))
    rules.append(_rule(kept, "coverage", ~same, "path"))
    whole = chunks.where(F.col("unit_kind").isin(*PROTECTED) & (F.col("unit_end_byte") - F.col("unit_start_byte") <= cap) & (F.col("unit_kind") != "LINE_WINDOW"))
    rules.append(_rule(whole.groupBy("path", "unit_start_byte", "unit_end_byte").count(), "protected unit", F.col("count") > 1, "path", "unit_start_byte"))

    of = build.membership(batches)
    once = of.groupBy("chunk_id").count().join(chunks.select("chunk_id", F.lit(1).alias("there")), "chunk_id", "full")
    rules.append(_rule(once, "chunk in batches", F.col("there").isNull() | F.col("count").isNull() | (F.col("count") != 1), "chunk_id"))
    held = of.join(chunks.select("chunk_id", "path", "start_byte", "frame", "frame_bytes", "chunk_identity_sha256"), "chunk_id")
    joined = held.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("position", "frame", "chunk_identity_sha256", "frame_bytes"))).alias("l"))
    joined = joined.select("batch_id", F.array_join(F.transform("l", lambda x: x["frame"]), "").alias("text"), F.sha2(F.array_join(F.transform("l", lambda x: x["chunk_identity_sha256"]), "\0"), 256).alias("ordered"), F.col("l")[0]["frame_bytes"].alias("first_bytes"))
    b = batches.join(joined, "batch_id", "left")
    rules.append(_rule(b, "payload hash", F.coalesce((F.sha2("text", 256) != F.col("payload_sha256")) | (F.octet_length("text") != F.col("payload_bytes")), F.lit(True)), "batch_id"))
    rules.append(_rule(b, "payload cap", F.col("payload_bytes") > batch_cap, "batch_id"))
    full = build.identity(
        target, "batch", ordered_chunk_identity_sha256=F.col("ordered"), payload_sha256=F.col("payload_sha256"), budget_counter=F.lit(build.COUNTER), max_payload_utf8_bytes=F.lit(batch_cap), payload_utf8_bytes=F.col("payload_bytes")
    )
    rules.append(_rule(b, "batch identity", F.coalesce(build.short_id("batch", full) != F.col("batch_id"), F.lit(True)), "batch_id"))
    # Next-fit: what opens a batch didn't fit in the one before it.
    following = b.select((F.col("batch_ordinal") - 1).alias("batch_ordinal"), F.col("first_bytes").alias("next_bytes"))
    rules.append(_rule(b.join(following, "batch_ordinal"), "next fit", F.col("payload_bytes") + F.col("next_bytes") <= batch_cap, "batch_id"))
    true = build.selection(batches, seed).select(F.col("rank").alias("true_rank"), F.col("batch_id"))
    rules.append(_rule(selection.join(true, "batch_id", "full"), "selection", ~F.col("rank").eqNullSafe(F.col("true_rank")), "batch_id"))
    return _all(rules)


def index_faults(chunks: DataFrame, symbols: DataFrame, calls: DataFrame, includes: DataFrame, facts: DataFrame) -> DataFrame:
    """What is wrong with an index: ids, callers, anchors, facts."""
    rules = []
    for df, key in ((symbols, "symbol_id"), (calls, "call_id"), (includes, "include_id"), (facts, "chunk_id")):
        rules.append(_rule(validate.repeated_ids(df, key), f"repeated {key}", F.lit(True), key))
    rules.append(_rule(validate.dangling(calls, "caller_symbol_id", symbols, "symbol_id"), "caller", F.lit(True), "call_id"))
    spans = chunks.select(F.col("chunk_id").alias("anchor_chunk_id"), F.col("path").alias("c_path"), F.col("start_byte").alias("c_start"), F.col("end_byte").alias("c_end"))
    for df, key in ((symbols, "symbol_id"), (calls, "call_id"), (includes, "include_id")):
        held = df.select(key, "path", "start_byte", "anchor_chunk_id").join(spans, "anchor_chunk_id", "left")
        inside = (F.col("path") == F.col("c_path")) & (F.col("start_byte") >= F.col("c_start")) & (F.col("start_byte") < F.col("c_end"))
        rules.append(_rule(held, f"anchor of {key}", ~F.coalesce(inside, F.lit(False)), key))
    per = chunks.select("chunk_id").join(facts.select("chunk_id", "extraction_mode", "total", sum((F.col(f) for f in FACTS), F.lit(0)).alias("n")), "chunk_id", "full")
    rules.append(_rule(per, "facts", F.coalesce(F.col("total") != F.col("n"), F.lit(True)), "chunk_id"))
    for df, key, name in ((symbols, "symbol_id", "defined_symbol_ids"), (calls, "call_id", "outgoing_call_ids")):
        listed = facts.select(F.col("chunk_id").alias("listed_in"), F.explode(name).alias(key))
        both = df.select(key, "anchor_chunk_id").join(listed, key, "full")
        rules.append(_rule(both, name, ~F.col("anchor_chunk_id").eqNullSafe(F.col("listed_in")), key))
    return _all(rules)


def selection_faults(batches: DataFrame, chosen: list[str], seed: str, n: int, domain: str = "codegrain/selection") -> list[str]:
    """What is wrong with a frozen list of drawn batches, which is as short as ``n``."""
    drawn = [r.batch_id for r in scoring.hash_sample(batches.select("batch_id").distinct(), "batch_id", domain, seed, n).orderBy("rank_hash", "batch_id").collect()]
    out = [] if len(chosen) == n else [f"{len(chosen)} batches instead of {n}"]
    out += [] if len(set(chosen)) == len(chosen) else ["a batch twice"]
    return out + ([] if chosen == drawn else ["not the batches that the seed draws, or not in order"])


def artifact_faults(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Files (path, content) that differ from what was recorded of them: entries (name, path, size_bytes, sha256), names and paths once each, no path that leaves the folder."""
    e = entries.withColumn("escapes", F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), ".."))
    both = e.join(files.select("path", F.octet_length("content").alias("size"), F.sha2("content", 256).alias("sha")), "path", "left")
    rules = [
        _rule(e, "path leaves the folder", F.col("escapes"), "path"),
        _rule(both, "missing", F.col("sha").isNull(), "path"),
        _rule(both, "size", F.col("size") != F.col("size_bytes"), "path"),
        _rule(both, "hash", F.col("sha") != F.col("sha256"), "path"),
    ]
    rules += [_rule(entries.groupBy(c).count(), f"repeated {c}", F.col("count") > 1, c) for c in ("name", "path")]
    return _all(rules)
