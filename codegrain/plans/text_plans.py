"""Queries on texts, chunks and batches, each with SQL for the same rows."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from codegrain.functions import json_rules as jr
from codegrain.functions import text as fn
from codegrain.operators import chunks as ch
from codegrain.operators import ordering, rollup, scope, scoring, validate, verify
from codegrain.plans import tables as t
from codegrain.sources import records
from codegrain.sources.staging import shared_dir, staged

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@query("blob_oid", "SELECT doc_id, sha1('blob ' || strlen(text) || chr(0) || text) AS oid FROM documents")
def _(spark, d):
    return t.table(spark, d, "documents").select("doc_id", fn.blob_oid(F.col("text")).alias("oid"))


@query("events_props_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, NULL::VARCHAR AS fault FROM events")
def _(spark, d):
    e = t.table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k long").getField("k").alias("k"), jr.object_fault(F.col("props")).alias("fault"))


#: Ways to spoil a line of JSON, by event_id % 11; those beyond are left whole.
_SPOILT = {0: "{l}{l}", 1: "[{l}]", 2: '{{"event_id": {id}, "event_id": 0}}', 3: "{l}\r", 4: "\ufeff{l}", 5: '{{"event_id": {id}, "v": NaN}}', 6: "{l}]"}
_SPOILT_FAULTS = {0: "invalid, or a key twice", 1: "not an object", 2: "invalid, or a key twice", 3: "carriage return", 4: "byte order mark", 5: "invalid, or a key twice", 6: "invalid, or a key twice"}


@query("jsonl_faults", f"SELECT event_id, CASE event_id % 11 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in _SPOILT_FAULTS.items())} END AS fault FROM events WHERE event_id % 11 < 7")
def _(spark, d):
    line, i = F.to_json(F.struct("event_id", "props")), F.col("event_id")
    text = line
    for k, form in _SPOILT.items():
        parts = re.split(r"(\{l\}|\{id\})", form)
        spoilt = F.concat(*[line if p == "{l}" else i.cast("string") if p == "{id}" else F.lit(p.replace("{{", "{").replace("}}", "}")) for p in parts])
        text = F.when(i % 11 == k, spoilt).otherwise(text)
    at = f"{shared_dir(spark)}/codegrain/lines-{uuid.uuid4().hex}"
    t.table(spark, d, "events").select(text.alias("value")).write.text(at, lineSep="\n")
    found = records.faults(spark, at)
    return found.select(F.regexp_extract("value", r'"event_id":\s*(\d+)', 1).cast("long").alias("event_id"), "fault")


_EVENT_RULES = {
    "type": "object",
    "properties": {
        "id": {"type": "integer", "minimum": 100},
        "type": {"enum": ["click", "view", "error"]},
        "value": {"type": "number", "maximum": 50},
        "props": {"type": "object", "properties": {"k": {"type": "integer", "maximum": 89}}, "required": ["k"], "additionalProperties": False},
        "tags": {"type": "array", "items": {"type": "string", "pattern": "[a-m].*", "maxLength": 6}, "uniqueItems": True, "minItems": 1},
    },
    "required": ["id", "tags"],
    "additionalProperties": False,
}


@query(
    "json_rules",
    """WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), f AS (
  SELECT event_id, '$.id: range' AS fault FROM e WHERE event_id < 100
  UNION ALL SELECT event_id, '$.type: not one of the values' FROM e WHERE event_type NOT IN ('click', 'view', 'error')
  UNION ALL SELECT event_id, '$.value: range' FROM e WHERE value > 50
  UNION ALL SELECT event_id, '$.props.k: range' FROM e WHERE k > 89 AND event_id % 5 <> 0
  UNION ALL SELECT event_id, '$.props: missing k' FROM e WHERE event_id % 5 = 0
  UNION ALL SELECT event_id, '$.props: extra kk' FROM e WHERE event_id % 5 = 0
  UNION ALL SELECT event_id, '$.tags: repeated item' FROM e WHERE user_id % 3 = 0
  UNION ALL SELECT event_id, '$.tags[' || i || ']: pattern' FROM e, (VALUES (0), (1)) t(i) WHERE NOT regexp_full_match(event_type, '[a-m].*') AND (i = 0 OR user_id % 3 = 0)
  UNION ALL SELECT event_id, '$.tags[' || i || ']: length ' || length(event_type) FROM e, (VALUES (0), (1)) t(i) WHERE length(event_type) > 6 AND (i = 0 OR user_id % 3 = 0))
SELECT event_id, fault FROM f""",
)
def _(spark, d):
    # Rules take a core 0.1 ms a row and more, so that a file's few row groups aren't left to as few tasks.
    e, kind = ordering.dealt_by(t.table(spark, d, "events"), "event_id", rows=50_000), F.col("event_type")
    props = F.when(F.col("event_id") % 5 == 0, F.regexp_replace("props", '"k"', '"kk"')).otherwise(F.col("props"))
    tags = F.when(F.col("user_id") % 3 == 0, F.array(kind, kind)).otherwise(F.array(kind, F.lit("last")))
    head = F.to_json(F.struct(F.col("event_id").alias("id"), kind.alias("type"), "value", tags.alias("tags")))
    text = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(', "props": '), props, F.lit("}"))
    # Not explode(), for which Spark adds a filter that reckons the rules twice more.
    return e.select("event_id", F.explode_outer(jr.text_faults(text, _EVENT_RULES)).alias("fault")).where("fault is not null")


@query(
    "stand_in_places",
    r"""SELECT doc_id, '$.' || CASE WHEN doc_id % 2 = 0 THEN 'lines' ELSE 'text.lines' END || '[' || (i - 1) || ']' AS place FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(line, '(?i)\b(worthless|idiot)\b')""",
)
def _(spark, d):
    lines = F.struct(F.split("text", "\n").alias("lines"))
    text = F.when(F.col("doc_id") % 2 == 0, F.to_json(lines)).otherwise(F.to_json(F.struct(lines.alias("text"))))
    docs = t.table(spark, d, "documents").where("text is not null").select("doc_id", jr.value_of(text).alias("v"))
    return jr.places_of(docs, "doc_id", "v", staged, r"(?i)\b(worthless|idiot)\b")


#: Texts of Latin letters with accents, which are written in one byte each.
_LATIN = r"regexp_matches(text, '[\x{A0}-\x{FF}]') AND NOT regexp_matches(text, '[^\x00-\x7F\x{A0}-\x{FF}]')"


@query("decode_stats", f"SELECT CASE WHEN {_LATIN} THEN 'cp1252' ELSE 'utf-8' END AS encoding, count(*) AS n, sum(length(text))::BIGINT AS n_chars, sum(CASE WHEN {_LATIN} THEN length(text) ELSE strlen(text) END)::BIGINT AS n_bytes FROM documents WHERE text IS NOT NULL GROUP BY 1")
def _(spark, d):
    text = F.col("text")
    latin = text.rlike(r"[\x{A0}-\x{FF}]") & ~text.rlike(r"[^\x00-\x7F\x{A0}-\x{FF}]")
    raw = t.table(spark, d, "documents").where("text is not null").select(F.when(latin, F.encode(text, "ISO-8859-1")).otherwise(text.cast("binary")).alias("raw"))
    got = raw.select(F.octet_length("raw").alias("b"), fn.decode_bytes()(F.col("raw")).alias("x"))
    return got.groupBy(F.col("x.encoding").alias("encoding")).agg(F.count("*").alias("n"), F.sum(F.length("x.text")).alias("n_chars"), F.sum("b").alias("n_bytes"))


@query("byte_budget", "SELECT source, count(*) AS n, sum(strlen(text))::BIGINT AS n_bytes, max(strlen(text))::BIGINT AS largest, sum((strlen(text) > 8192)::INT)::BIGINT AS n_over FROM documents GROUP BY source")
def _(spark, d):
    b = fn.byte_length(F.col("text"))
    return t.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(b).alias("n_bytes"), F.max(b).alias("largest"), F.sum((b > 8192).cast("long")).alias("n_over"))


@query("line_windows", f"WITH RECURSIVE {t.CHUNKS_SQL} SELECT doc_id, ordinal, start_char, end_char, n_bytes, sha FROM chunks")
def _(spark, d):
    return t.chunks(spark, d).select("doc_id", "ordinal", "start_char", "end_char", "n_bytes", "sha")


@query(
    "partition_check",
    f"""WITH RECURSIVE {t.CHUNKS_SQL}, f AS (SELECT doc_id, end_byte, start_byte <> coalesce(lag(end_byte) OVER (PARTITION BY doc_id ORDER BY start_byte), 0) AS bad FROM chunks),
g AS (SELECT doc_id, count(*) AS n, sum(bad::INT) AS b, max(end_byte) AS e FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_spans, coalesce(b, 0)::BIGINT AS n_faults, coalesce(e, 0) = coalesce(strlen(text), 0) AS covers FROM documents LEFT JOIN g USING (doc_id)""",
)
def _(spark, d):
    sizes = t.table(spark, d, "documents").select("doc_id", F.coalesce(fn.byte_length(F.col("text")), F.lit(0)).alias("size"))
    return ch.partition_faults(t.chunks(spark, d), sizes, "doc_id", "start_byte", "end_byte", "size")


@query(
    "line_col",
    """SELECT doc_id, q::BIGINT AS "at", (1 + length(p) - length(replace(p, chr(10), '')))::BIGINT AS line, strlen(list_extract(string_split(p, chr(10)), -1))::BIGINT AS col
FROM (SELECT doc_id, q, left(text, q::INT) AS p FROM (SELECT doc_id, text, unnest([0, length(text) // 3, length(text)]) AS q FROM documents))""",
)
def _(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", "text", F.explode(F.array(F.lit(0), F.expr("cast(length(text) div 3 as int)"), F.length("text"))).alias("at"))
    before = F.expr("left(text, at)")
    return docs.select("doc_id", F.col("at").cast("long").alias("at"), (1 + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))).cast("long").alias("line"), fn.byte_length(F.substring_index(before, "\n", -1)).alias("col"))


@query(
    "normalized_text",
    r"""SELECT doc_id, sha256(n) AS full_sha, strlen(n) > 96 AS truncated, left(n, list_max(list_transform(range(0, least(length(n), 96)::BIGINT + 1), lambda i: CASE WHEN strlen(left(n, i::INT)) <= 96 THEN i ELSE 0 END))::INT) AS prefix
FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS n FROM documents)""",
)
def _(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", fn.collapse_space(F.col("text")).alias("n"))
    prefix = fn.prefix_within(F.col("n"), 96)
    return docs.select("doc_id", F.sha2("n", 256).alias("full_sha"), (F.octet_length("n") > 96).alias("truncated"), prefix.alias("prefix"))


@query("evidence_frame", f"WITH {t.FRAMES_SQL} SELECT * FROM frames")
def _(spark, d):
    return t.frames(spark, d)


@query(
    "chunk_identity",
    f"""WITH RECURSIVE {t.CHUNKS_SQL} SELECT doc_id, ordinal, 'C-' || left(sha256('codegrain/chunk' || chr(0) || json_object('doc_id', doc_id, 'end_byte', end_byte, 'ordinal', ordinal, 'sha', sha, 'start_byte', start_byte)::VARCHAR), 24) AS chunk_id FROM chunks""",
)
def _(spark, d):
    return ch.identities(t.chunks(spark, d), "codegrain/chunk", "C-", "doc_id", "ordinal", "start_byte", "end_byte", "sha").select("doc_id", "ordinal", "chunk_id")


@query(
    "line_points",
    f"""WITH RECURSIVE {t.CHUNKS_SQL}, p AS (SELECT c.doc_id, ordinal, left(text, start_char::INT) AS a, left(text, end_char::INT - 1) AS b, left(text, end_char::INT) AS z FROM chunks c JOIN documents d ON d.doc_id = c.doc_id)
SELECT doc_id, ordinal, (1 + length(a) - length(replace(a, chr(10), '')))::BIGINT AS start_line, (1 + length(b) - length(replace(b, chr(10), '')))::BIGINT AS end_line, (1 + length(z) - length(replace(z, chr(10), '')))::BIGINT AS end_point_line FROM p""",
)
def _(spark, d):
    return ch.line_points(t.chunks(spark, d), "doc_id").select("doc_id", "ordinal", "start_line", "end_line", "end_point_line")


@query("iso_dates", "SELECT x, x IS NOT NULL AND regexp_matches(x, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND try_cast(x AS DATE) IS NOT NULL AS valid, count(*) AS n FROM (SELECT year(l_shipdate) || '-' || lpad((l_linenumber * 3)::VARCHAR, 2, '0') || '-' || lpad((day(l_shipdate) + l_linenumber)::VARCHAR, CASE WHEN l_returnflag = 'A' THEN 3 ELSE 2 END, '0') AS x FROM lineitem) GROUP BY ALL")
def _(spark, d):
    width = F.when(F.col("l_returnflag") == "A", 3).otherwise(2)
    day = (F.dayofmonth("l_shipdate") + F.col("l_linenumber")).cast("string")
    x = F.concat_ws("-", F.year("l_shipdate").cast("string"), F.lpad((F.col("l_linenumber") * 3).cast("string"), 2, "0"), F.when(width == 3, F.lpad(day, 3, "0")).otherwise(F.lpad(day, 2, "0")))
    return t.table(spark, d, "lineitem").select(x.alias("x")).groupBy("x").agg(F.count("*").alias("n")).select("x", fn.iso_date(F.col("x")).alias("valid"), "n")


@query("canonical_lines", "SELECT json_object('c_acctbal_cents', round(c_acctbal * 100)::BIGINT, 'c_custkey', c_custkey, 'c_mktsegment', c_mktsegment, 'c_name', c_name)::VARCHAR AS value FROM customer")
def _(spark, d):
    c = t.table(spark, d, "customer").select("c_name", "c_mktsegment", "c_custkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("c_acctbal_cents"))
    return records.canonical_lines(c)


@query("chunks_per_file", f"WITH RECURSIVE {t.CHUNKS_SQL} SELECT doc_id, count(*) AS n_chunks, max(n_bytes)::BIGINT AS largest FROM chunks GROUP BY doc_id")
def _(spark, d):
    return t.chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max("n_bytes").alias("largest"))


_NODES = ("function_definition", "struct_specifier", "preproc_def", "preproc_if", "declaration", "line_window")
_KIND_OF = "CASE {} WHEN 'function_definition' THEN 'FUNCTION' WHEN 'struct_specifier' THEN 'TYPE' WHEN 'preproc_def' THEN 'MACRO' WHEN 'preproc_if' THEN 'PREPROCESSOR' WHEN 'declaration' THEN 'DECLARATION' ELSE 'AST_BLOCK' END"


@query(
    "chunk_semantics",
    f"""WITH e AS (SELECT CASE WHEN value > 190 THEN 'ODD' WHEN value > 150 THEN 'STRUCTURAL_GROUP' WHEN value > 120 THEN 'LINE_WINDOW' ELSE {_KIND_OF.format('m')} END AS kind, node_type, {_KIND_OF.format('node_type')} AS part, CASE WHEN user_id % 2 = 0 THEN 'PARSE_SUCCESS' ELSE 'FALLBACK_SUCCESS' END AS outcome
  FROM (SELECT *, (['{"', '".join(_NODES)}'])[event_id % 6 + 1] AS node_type, (['{"', '".join(_NODES)}'])[user_id % 6 + 1] AS m FROM events))
SELECT kind, node_type, outcome, count(*) AS n, sum((kind = 'ODD' OR kind = 'MACRO' AND node_type NOT IN ('preproc_def', 'preproc_function_def') OR kind = 'FUNCTION' AND node_type <> 'function_definition' OR kind = 'LINE_WINDOW' AND outcome <> 'FALLBACK_SUCCESS'
  OR kind = 'STRUCTURAL_GROUP' AND part IN ('FUNCTION', 'TYPE', 'MACRO', 'DECLARATION', 'TEMPLATE', 'LINE_WINDOW'))::INT)::BIGINT AS n_faults FROM e GROUP BY ALL""",
)
def _(spark, d):
    node = lambda by: F.element_at(F.array(*map(F.lit, _NODES)), (F.col(by) % 6 + 1).cast("int"))
    e = t.table(spark, d, "events").select("value", node("event_id").alias("node_type"), node("user_id").alias("m"), F.when(F.col("user_id") % 2 == 0, "PARSE_SUCCESS").otherwise("FALLBACK_SUCCESS").alias("outcome"))
    kind = F.when(F.col("value") > 190, "ODD").when(F.col("value") > 150, "STRUCTURAL_GROUP").when(F.col("value") > 120, "LINE_WINDOW").otherwise(scope.kind(F.col("m")))
    e = e.select(kind.alias("kind"), "node_type", F.array(scope.kind(F.col("node_type"))).alias("kinds"), "outcome")
    fault = verify.kind_fault(F.col("kind"), F.col("node_type"), F.col("kinds"), F.col("outcome"))
    return e.groupBy("kind", "node_type", "outcome").agg(F.count("*").alias("n"), F.sum(fault.cast("long")).alias("n_faults"))


_FIT_SQL = f"""{t.FRAMES_SQL}, f AS (SELECT doc_id, n_bytes, sha, row_number() OVER (ORDER BY doc_id) AS i FROM frames WHERE n_bytes <= {t.FRAME_CAP}),
fit(i, doc_id, n_bytes, sha, batch_ordinal, used) AS (SELECT i, doc_id, n_bytes, sha, 0::BIGINT, n_bytes FROM f WHERE i = 1
  UNION ALL SELECT f.i, f.doc_id, f.n_bytes, f.sha, CASE WHEN used + f.n_bytes > {t.FRAME_CAP} THEN batch_ordinal + 1 ELSE batch_ordinal END, CASE WHEN used + f.n_bytes > {t.FRAME_CAP} THEN f.n_bytes ELSE used + f.n_bytes END FROM fit JOIN f ON f.i = fit.i + 1)"""


def _fitted(spark, d):
    return ch.next_fit(t.frames(spark, d).where(F.col("n_bytes") <= t.FRAME_CAP), "doc_id", "n_bytes", t.FRAME_CAP)


@query("next_fit", f"WITH RECURSIVE {_FIT_SQL} SELECT batch_ordinal, count(*) AS n_items, sum(n_bytes)::BIGINT AS total_bytes FROM fit GROUP BY batch_ordinal")
def _(spark, d):
    return _fitted(spark, d).groupBy("batch_ordinal").agg(F.count("*").alias("n_items"), F.sum("n_bytes").alias("total_bytes"))


@query("batch_identity", f"WITH RECURSIVE {_FIT_SQL} SELECT batch_ordinal, sha256(string_agg(sha, chr(0) ORDER BY doc_id)) AS ordered_hash, count(*) AS n FROM fit GROUP BY batch_ordinal")
def _(spark, d):
    return rollup.ordered_hash(_fitted(spark, d), ["batch_ordinal"], ["doc_id"], "sha")


@query("oversize_items", f"WITH {t.FRAMES_SQL} SELECT doc_id, n_bytes FROM frames WHERE n_bytes > {t.FRAME_CAP}")
def _(spark, d):
    return t.frames(spark, d).where(F.col("n_bytes") > t.FRAME_CAP).select("doc_id", "n_bytes")


_LINES_SQL = """lines AS (SELECT doc_id, i, strlen(l) + (i < n)::INT AS b, strpos(l, '|') > 0 AS p, CASE WHEN strpos(l, '|') > 0 THEN 'TABLE' WHEN length(l) < 60 THEN 'SHORT' ELSE 'PROSE' END AS kind
  FROM (SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i, len(ls) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE strlen(l) + (i < n)::INT > 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM lines)"""


@query(
    "coalesce_spans",
    f"""WITH RECURSIVE {_LINES_SQL}, fold(doc_id, r, g, s, e, p, parts, kinds) AS (
  SELECT doc_id, r, 1::BIGINT, (e - b)::BIGINT, e::BIGINT, p, 1::BIGINT, kind FROM numbered WHERE r = 1
  UNION ALL SELECT n.doc_id, n.r, CASE WHEN j THEN g ELSE g + 1 END, CASE WHEN j THEN s ELSE n.e - n.b END::BIGINT, n.e::BIGINT, n.p, CASE WHEN j THEN parts + 1 ELSE 1 END,
    CASE WHEN NOT j THEN n.kind WHEN list_contains(string_split(kinds, '+'), n.kind) THEN kinds ELSE kinds || '+' || n.kind END
  FROM (SELECT f.g, f.s, f.parts, f.kinds, n.*, NOT f.p AND NOT n.p AND n.e - f.s <= {t.CAP} AS j FROM fold f JOIN numbered n ON n.doc_id = f.doc_id AND n.r = f.r + 1) n)
SELECT doc_id, s AS start_byte, max(e)::BIGINT AS end_byte, max(parts)::BIGINT AS parts, arg_max(kinds, r) AS kinds FROM fold GROUP BY doc_id, g, s""",
)
def _(spark, d):
    # A document's spans are made and folded within its row.
    lines = "split(text, '\\n')"
    sized = f"""filter(transform({lines}, (l, i) -> named_struct('b', cast(octet_length(l) + if(i < size({lines}) - 1, 1, 0) as bigint),
        'kind', if(instr(l, '|') > 0, 'TABLE', if(length(l) < 60, 'SHORT', 'PROSE')), 'protected', instr(l, '|') > 0)), x -> x.b > 0)"""
    docs = t.table(spark, d, "documents").where("text is not null").select("doc_id", F.expr(sized).alias("spans"))  # a null text has no spans
    out = docs.select("doc_id", F.explode(ch.coalesce_sizes(t.CAP)(F.col("spans"))).alias("o"))
    return out.select("doc_id", F.col("o.start").alias("start_byte"), F.col("o.end").alias("end_byte"), F.col("o.parts").alias("parts"), F.col("o.kinds").alias("kinds"))


@query(
    "interval_union",
    """WITH s AS (SELECT user_id, event_id AS a, event_id + round(value)::BIGINT AS b FROM events),
f AS (SELECT user_id, greatest(0, b - greatest(a, coalesce(max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a))) AS x FROM s)
SELECT user_id, count(*) AS n_spans, sum(x)::BIGINT AS covered FROM f GROUP BY user_id""",
)
def _(spark, d):
    e = t.table(spark, d, "events").select("user_id", F.col("event_id").alias("a"), (F.col("event_id") + F.round("value").cast("long")).alias("b"))
    return ch.interval_union(e, "user_id", "a", "b")


@query(
    "min_by_score",
    """SELECT source, arg_min(lang, s) AS lang FROM (SELECT source, lang, (sum(strlen(text) - length(text)), count(*), max(n_chars), lang) AS s FROM documents WHERE lang IS NOT NULL GROUP BY source, lang) GROUP BY source""",
)
def _(spark, d):
    per = t.table(spark, d, "documents").where("lang is not null").groupBy("source", "lang").agg(F.sum(F.octet_length("text") - F.length("text")).alias("a"), F.count("*").alias("b"), F.max("n_chars").alias("c"))
    return per.groupBy("source").agg(F.min_by("lang", F.struct("a", "b", "c", "lang")).alias("lang"))


_OUTCOME = """CASE WHEN length(text) = 0 THEN 'EMPTY_SUCCESS' WHEN doc_id % 17 = 0 THEN 'FALLBACK_NON_UTF8' WHEN doc_id % 13 = 0 THEN 'FALLBACK_ALL_FAILED'
  WHEN length(text) - length(replace(text, '|', '')) > 0 THEN 'FALLBACK_DIAGNOSTICS' WHEN length(text) - length(replace(text, '.', '')) = 0 THEN 'FALLBACK_NO_NODES' ELSE 'PARSE_SUCCESS' END"""


@query("parse_outcome", f"SELECT doc_id, {_OUTCOME} AS outcome FROM documents")
def _(spark, d):
    count = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    got = scope.outcome(F.length("text"), F.col("doc_id") % 17 != 0, F.lit(1), F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0), count("|"), count("."))
    return t.table(spark, d, "documents").select("doc_id", got.alias("outcome"))


_NODE = "(['function_definition', 'struct_specifier', 'preproc_def', 'preproc_if', 'declaration', 'expression_statement'])[CAST(event_id % 6 AS INT) + 1]"


@query(
    "kind_map",
    f"""SELECT kind, count(*) AS n FROM (SELECT CASE n WHEN 'function_definition' THEN 'FUNCTION' WHEN 'struct_specifier' THEN 'TYPE' WHEN 'preproc_def' THEN 'MACRO' WHEN 'preproc_if' THEN 'PREPROCESSOR' WHEN 'declaration' THEN 'DECLARATION' ELSE 'AST_BLOCK' END AS kind
FROM (SELECT {_NODE} AS n FROM events)) GROUP BY kind""",
)
def _(spark, d):
    names = ("function_definition", "struct_specifier", "preproc_def", "preproc_if", "declaration", "expression_statement")
    node = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 6 + 1).cast("int"))
    return t.table(spark, d, "events").groupBy(scope.kind(node).alias("kind")).agg(F.count("*").alias("n"))


@query(
    "scope_classify",
    f"""WITH {t.FILES_SQL} SELECT classification, reason, count(*) AS n FROM (SELECT CASE WHEN mode IN ('100644', '100755') AND regexp_extract(path, '(\\.[^./]*)$', 1) IN ('.c', '.cpp', '.h') THEN 'IN_SCOPE' ELSE 'OUT_OF_SCOPE' END AS classification,
CASE WHEN mode = '120000' THEN 'link' WHEN regexp_extract(path, '(\\.[^./]*)$', 1) = '.s' THEN 'assembly' ELSE 'other' END AS reason FROM files) GROUP BY ALL""",
)
def _(spark, d):
    f = t.files(spark, d)
    return f.groupBy(scope.classify(F.col("path"), F.col("mode")).alias("classification"), scope.reason(F.col("path"), F.col("mode"), {".s": "assembly"}, "other", "link").alias("reason")).agg(F.count("*").alias("n"))


@query("path_parts", f"WITH {t.FILES_SQL} SELECT doc_id, regexp_extract(path, '(\\.[^./]*)$', 1) AS extension, regexp_extract(path, '([^/]*)$', 1) AS name, string_split(path, '/')[1] AS top FROM files")
def _(spark, d):
    p = F.col("path")
    return t.files(spark, d).select("doc_id", fn.extension(p).alias("extension"), F.regexp_extract(p, r"([^/]*)$", 1).alias("name"), F.split(p, "/")[0].alias("top"))


_ODD = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '/' || url WHEN 2 THEN replace(url, '/en/', '/../') ELSE replace(url, ':', chr(92)) END"


@query(
    "path_valid",
    f"SELECT page_id, length(p) > 0 AND NOT regexp_matches(p, '^[/\\\\]|\\\\') AND NOT list_contains(string_split(p, '/'), '..') AS valid FROM (SELECT page_id, {_ODD} AS p FROM pages)",
)
def _(spark, d):
    p = F.expr("CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '/' || url WHEN 2 THEN replace(url, '/en/', '/../') ELSE replace(url, ':', chr(92)) END")
    return t.table(spark, d, "pages").select("page_id", fn.path_valid(p).alias("valid"))


@query("placeholder_scan", r"SELECT doc_id, regexp_matches(text, '(?i)\b(worthless|idiot)\b') AS hit FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return t.table(spark, d, "documents").where("text is not null").select("doc_id", fn.placeholder(F.col("text"), r"(?i)\b(worthless|idiot)\b").alias("hit"))


@query(
    "cap_gate",
    f"""WITH {t.TURNS_SQL}, s AS (SELECT conv_id, coalesce(sum(n_bytes) FILTER (role = 'user'), 0)::BIGINT AS u, coalesce(sum(n_bytes) FILTER (role = 'assistant'), 0)::BIGINT AS a FROM turns GROUP BY conv_id)
SELECT conv_id, u + a AS total_bytes, CASE WHEN u > 768 THEN 'user' WHEN a > 900 THEN 'assistant' WHEN u + a > 1500 THEN 'total' END AS fault FROM s""",
)
def _(spark, d):
    part = lambda r: F.coalesce(F.sum(F.when(F.col("role") == r, F.col("n_bytes"))), F.lit(0)).cast("long")
    s = t.turns(spark, d).groupBy("conv_id").agg(part("user").alias("u"), part("assistant").alias("a"))
    total, fault = validate.cap_gate({"user": (F.col("u"), 768), "assistant": (F.col("a"), 900)}, 1500)
    return s.select("conv_id", total.alias("total_bytes"), fault.alias("fault"))


@query(
    "hash_rank_sample",
    f"SELECT doc_id, h AS rank_hash FROM (SELECT doc_id, sha256('{t.DOMAIN}' || chr(0) || '{t.SEED}' || chr(0) || doc_id) AS h FROM documents) ORDER BY h, doc_id LIMIT 100",
)
def _(spark, d):
    return scoring.hash_sample(t.table(spark, d, "documents").select("doc_id"), "doc_id", t.DOMAIN, t.SEED, 100)


@query("page_links", r"""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY ALL""")
def _(spark, d):
    hrefs = t.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    return hrefs.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(
    "mention_calls",
    r"""SELECT page_id, name, kind, count(*) AS n FROM (SELECT page_id, m AS name, CASE WHEN strpos(m, '.') > 0 THEN 'MEMBER' ELSE 'DIRECT_IDENTIFIER' END AS kind
FROM (SELECT page_id, unnest(regexp_extract_all(html, '([A-Za-z_][A-Za-z_0-9.]*)\(', 1)) AS m FROM pages)) GROUP BY ALL""",
)
def _(spark, d):
    m = t.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"([A-Za-z_][A-Za-z_0-9.]*)\("), 1)).alias("name"))
    return m.groupBy("page_id", "name", F.when(F.instr("name", ".") > 0, "MEMBER").otherwise("DIRECT_IDENTIFIER").alias("kind")).agg(F.count("*").alias("n"))
