"""Queries on symbols, calls, batches and runs, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codegrain.functions import text as fn
from codegrain.operators import chunks as ch
from codegrain.operators import relations as rel
from codegrain.operators import build, ordering, rollup, scoring, validate, workflow
from codegrain.plans import tables as t
from codegrain.plans.text_plans import query

_WEIGHT = "CASE p_type WHEN 'PROMO' THEN 9 WHEN 'STANDARD' THEN 3 WHEN 'LARGE' THEN 6 ELSE CASE WHEN starts_with(p_type, 'ECON') THEN 4 WHEN starts_with(p_type, 'SM') THEN 2 ELSE 0 END END"


def _scored_calls(spark, d):
    li, o, c, p, s = (t.table(spark, d, n) for n in ("lineitem", "orders", "customer", "part", "supplier"))
    rows = li.join(p, li["l_partkey"] == p["p_partkey"]).join(s, li["l_suppkey"] == s["s_suppkey"]).select(
        "l_orderkey", F.coalesce(scoring.rule(F.col("p_type"), t.TYPE_RULES, t.TYPE_PREFIXES).getField("weight"), F.lit(0)).alias("weight"), F.col("l_partkey").alias("target"), "s_nationkey",
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("is_indirect"), (F.col("l_returnflag") == "A").alias("is_ambiguous"),
    )
    homes = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_nationkey")
    # The join by order is the last one, so that the scores' grouping needs no other deal.
    rows = ordering.dealt_by(rows, "l_orderkey", n=li.count()).join(homes.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "weight", "target", (F.col("s_nationkey") != F.col("c_nationkey")).alias("is_cross"), "is_indirect", "is_ambiguous")


def _scores(spark, d):
    cols = ["l_orderkey", "score_sensitive", "score_cross_file", "score_indirect", "score_ambiguous", "score_calls", "priority_score", "call_count", "cross_file_target_count"]
    return scoring.priority(_scored_calls(spark, d), "l_orderkey").select(cols)


_SCORED_SQL = f"""sc AS (SELECT l_orderkey, sum({_WEIGHT}) AS w, count(DISTINCT CASE WHEN s_nationkey <> c_nationkey THEN l_partkey END) AS xf,
  sum((l_returnflag = 'R' AND l_linestatus = 'F')::INT) AS ind, sum((l_returnflag = 'A')::INT) AS amb, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey),
scores AS (SELECT l_orderkey, least(45, w)::BIGINT AS score_sensitive, least(20, 4 * xf)::BIGINT AS score_cross_file, least(15, 5 * ind)::BIGINT AS score_indirect, least(10, 2 * amb)::BIGINT AS score_ambiguous, least(10, n)::BIGINT AS score_calls,
  (least(45, w) + least(20, 4 * xf) + least(15, 5 * ind) + least(10, 2 * amb) + least(10, n))::BIGINT AS priority_score, n AS call_count, xf AS cross_file_target_count FROM sc)"""


@query("priority_score", f"WITH {_SCORED_SQL} SELECT * FROM scores")
def _(spark, d):
    return _scores(spark, d)


@query("priority_rank", f"WITH {_SCORED_SQL} SELECT l_orderkey, priority_score, row_number() OVER (ORDER BY priority_score DESC, l_orderkey) AS priority_rank FROM scores")
def _(spark, d):
    return scoring.ranked(_scores(spark, d), "l_orderkey").select("l_orderkey", "priority_score", "priority_rank")


@query("priority_top", f"WITH {_SCORED_SQL} SELECT l_orderkey, priority_score FROM scores ORDER BY priority_score DESC, l_orderkey LIMIT 20")
def _(spark, d):
    return _scores(spark, d).select("l_orderkey", "priority_score").orderBy(F.desc("priority_score"), "l_orderkey").limit(20)


@query(
    "batch_mode",
    f"""WITH {_SCORED_SQL} SELECT 'priority' AS mode, l_orderkey AS batch_id, row_number() OVER (ORDER BY priority_score DESC, l_orderkey) AS n FROM scores QUALIFY n <= 50
UNION ALL SELECT 'all', o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders QUALIFY n <= 50
UNION ALL SELECT 'selected', o_orderkey, row_number() OVER (ORDER BY sha256('codegrain/selection' || chr(0) || '{t.SEED}' || chr(0) || o_orderkey), o_orderkey) AS n FROM orders QUALIFY n <= 3""",
)
def _(spark, d):
    batches = ordering.source_order(t.table(spark, d, "orders").select(F.col("o_orderkey").alias("batch_id")), "batch_id", name="batch_ordinal")
    drawn = build.selection(batches, t.SEED)
    ranked = scoring.ranked(_scores(spark, d), "l_orderkey").withColumnRenamed("l_orderkey", "batch_id")
    of = lambda mode: workflow.batches_of(mode, batches, drawn, ranked, 50).select(F.lit(mode).alias("mode"), "batch_id", F.col("batch_ordinal").alias("n"))
    return of("priority").unionByName(of("all")).unionByName(of("selected"))


@query(
    "sensitive_rules",
    f"SELECT category, count(*) AS n, sum(w)::BIGINT AS weight FROM (SELECT {_WEIGHT} AS w, CASE p_type WHEN 'PROMO' THEN 'offer' WHEN 'STANDARD' THEN 'base' WHEN 'LARGE' THEN 'size' ELSE CASE WHEN starts_with(p_type, 'ECON') THEN 'price' WHEN starts_with(p_type, 'SM') THEN 'size' END END AS category FROM part) GROUP BY category",
)
def _(spark, d):
    r = scoring.rule(F.col("p_type"), t.TYPE_RULES, t.TYPE_PREFIXES)
    return t.table(spark, d, "part").select(r.alias("r")).groupBy(F.col("r.category").alias("category")).agg(F.count("*").alias("n"), F.coalesce(F.sum("r.weight"), F.lit(0)).alias("weight"))


@query(
    "priority_maps",
    """WITH h AS (SELECT l_orderkey, CASE p_type WHEN 'PROMO' THEN 'offer' WHEN 'STANDARD' THEN 'base' WHEN 'LARGE' THEN 'size' ELSE CASE WHEN starts_with(p_type, 'ECON') THEN 'price' WHEN starts_with(p_type, 'SM') THEN 'size' END END AS c FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, '{' || string_agg('"' || c || '":' || n, ',' ORDER BY c) || '}' AS categories FROM (SELECT l_orderkey, c, count(*) AS n FROM h WHERE c IS NOT NULL GROUP BY ALL) GROUP BY l_orderkey""",
)
def _(spark, d):
    li, p = t.table(spark, d, "lineitem"), t.table(spark, d, "part")
    hit = scoring.rule(F.col("p_type"), t.TYPE_RULES, t.TYPE_PREFIXES).getField("category")
    per = li.join(p, li["l_partkey"] == p["p_partkey"]).select("l_orderkey", hit.alias("c")).where("c is not null").groupBy("l_orderkey", "c").agg(F.count("*").alias("n"))
    return per.groupBy("l_orderkey").agg(F.to_json(build.sorted_counts("c", "n")).alias("categories"))


_RULES_SQL = ", ".join(f"('{n}', '{c}', {w})" for n, (c, w) in scoring.exact_rules().items())


@query(
    "sensitive_names",
    f"""WITH r AS (SELECT * FROM (VALUES {_RULES_SQL}) v(name, category, weight)), w AS (SELECT m AS name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z_]+')) AS m FROM documents) GROUP BY m)
SELECT coalesce(category, CASE WHEN starts_with(w.name, 'exec') THEN 'command_exec' WHEN starts_with(w.name, 'strto') THEN 'numeric_parse' END) AS category, sum(n)::BIGINT AS n, sum(n * coalesce(weight, CASE WHEN starts_with(w.name, 'exec') THEN 13 WHEN starts_with(w.name, 'strto') THEN 4 ELSE 0 END))::BIGINT AS weight FROM w LEFT JOIN r USING (name) GROUP BY 1""",
)
def _(spark, d):
    names = t.table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_]+"), 0)).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    r = scoring.rule(F.col("name"), scoring.exact_rules(), scoring.SENSITIVE_PREFIXES)
    return names.select("n", r.alias("r")).groupBy(F.col("r.category").alias("category")).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.col("n") * F.coalesce("r.weight", F.lit(0))), F.lit(0)).alias("weight"))


#: Calls with their candidates, straight from the rules: one pool of the callee's name, one of its expression.
_RESOLVE_SQL = f"""{t.SYMBOLS_SQL}, {t.CALLS_SQL},
u AS (SELECT * FROM (SELECT s.*, via, CASE via WHEN 'name' THEN name ELSE qualified_name END AS pool,
  CASE WHEN symbol_kind = 'FUNCTION' AND role IN ('DEFINITION', 'DECLARATION') THEN role WHEN symbol_kind = 'MACRO' AND role = 'DEFINITION' THEN 'MACRO' END AS use FROM symbols s, (VALUES ('name'), ('qualified')) v(via)) WHERE use IS NOT NULL),
pool AS (SELECT via, pool, count(*) FILTER (use = 'DEFINITION') AS d, count(*) FILTER (use = 'DECLARATION') AS e, count(*) FILTER (use = 'MACRO') AS m, (list(symbol_id ORDER BY path, start_byte, symbol_id) FILTER (use = 'DEFINITION'))[1:3] AS firsts FROM u GROUP BY ALL),
loc AS (SELECT via, pool, path, count(*) AS l, min(symbol_id) AS id FROM u WHERE use = 'DEFINITION' AND linkage = 'INTERNAL' GROUP BY ALL),
c AS (SELECT *, CASE WHEN callee_expression IN (SELECT qualified_name FROM symbols) THEN 'qualified' WHEN callee_name IS NOT NULL THEN 'name' END AS v FROM calls),
j AS (SELECT c.caller, c.target, c.line, c.kind, c.path, c.callee_name, v, CASE v WHEN 'qualified' THEN callee_expression ELSE callee_name END AS q FROM c),
k AS (SELECT j.*, coalesce(p.d, 0) AS d, coalesce(p.e, 0) AS e, coalesce(n.m, 0) AS m, coalesce(l, 0) AS l, id, p.firsts FROM j LEFT JOIN pool p ON p.via = v AND p.pool = q LEFT JOIN pool n ON n.via = 'name' AND n.pool = callee_name
  LEFT JOIN loc ON loc.via = v AND loc.pool = q AND loc.path = j.path),
r AS (SELECT *, CASE WHEN kind = 'INDIRECT' OR callee_name IS NULL THEN 'INDIRECT_OR_DYNAMIC' WHEN m > 0 AND d + e > 0 THEN 'MACRO_OR_FUNCTION_AMBIGUOUS' WHEN kind IN ('MEMBER', 'QUALIFIED') THEN 'MEMBER_OR_QUALIFIED'
  WHEN l = 1 THEN 'UNIQUE_FILE_LOCAL_CANDIDATE' WHEN l > 1 THEN 'AMBIGUOUS' WHEN d = 1 THEN 'UNIQUE_REPOSITORY_CANDIDATE' WHEN d > 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED_EXTERNAL' END AS resolution FROM k),
resolved AS (SELECT caller, target, line, path, kind, resolution, CASE WHEN d + e > 0 THEN v END AS via, CASE WHEN d + e > 0 THEN q END AS pool, CASE WHEN resolution = 'UNIQUE_FILE_LOCAL_CANDIDATE' THEN id END AS local_symbol_id,
  (CASE WHEN resolution = 'UNIQUE_FILE_LOCAL_CANDIDATE' THEN 1 ELSE d END)::BIGINT AS n_candidates, e::BIGINT AS n_declarations, CASE WHEN resolution = 'UNIQUE_FILE_LOCAL_CANDIDATE' THEN [id] ELSE coalesce(firsts, []) END AS firsts FROM r),
edges AS (SELECT DISTINCT caller, r.via, r.pool, r.resolution, r.path, symbol_id FROM resolved r JOIN u ON u.via = r.via AND u.pool = r.pool AND use = 'DEFINITION' AND (local_symbol_id IS NULL OR local_symbol_id = symbol_id))"""


def _resolved(spark, d):
    return rel.resolve_calls(t.calls(spark, d), t.symbols(spark, d))


@query("resolve_calls", f"WITH {_RESOLVE_SQL} SELECT caller, target, line, kind, resolution, via, pool, local_symbol_id, n_candidates, n_declarations, array_to_string(firsts, ',') AS first_ids FROM resolved")
def _(spark, d):
    ids = F.array_join(F.col("first_candidates").cast("array<string>"), ",").alias("first_ids")
    return _resolved(spark, d).select("caller", "target", "line", "kind", "resolution", "via", "pool", "local_symbol_id", "n_candidates", "n_declarations", ids)


@query("call_candidates", f"WITH {_RESOLVE_SQL} SELECT via, pool, use, count(*) AS n, string_agg(symbol_id::VARCHAR, ',' ORDER BY path, start_byte, symbol_id) AS ids FROM u GROUP BY ALL")
def _(spark, d):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("path", "start_byte", "symbol_id"))), lambda x: x["symbol_id"].cast("string"))
    return rel.pools(t.symbols(spark, d)).groupBy("via", "pool", "use").agg(F.count("*").alias("n"), F.array_join(listed, ",").alias("ids"))


@query("resolution_counts", f"WITH {_RESOLVE_SQL} SELECT resolution, count(*) AS n, sum(n_candidates)::BIGINT AS candidates FROM resolved GROUP BY resolution")
def _(spark, d):
    return _resolved(spark, d).groupBy("resolution").agg(F.count("*").alias("n"), F.sum("n_candidates").alias("candidates"))


@query("resolution_rollup", f"WITH {_RESOLVE_SQL} SELECT kind, resolution, count(*) AS n FROM resolved GROUP BY ROLLUP (kind, resolution)")
def _(spark, d):
    return _resolved(spark, d).rollup("kind", "resolution").agg(F.count("*").alias("n"))


@query("dangling_callers", "SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels) GROUP BY user_id")
def _(spark, d):
    return validate.dangling(t.table(spark, d, "events"), "user_id", t.table(spark, d, "labels"), "doc_id").groupBy("user_id").agg(F.count("*").alias("n"))


_PATHS_SQL = """paths AS (SELECT DISTINCT unnest([p_brand || '/' || p_type || '/' || p_name || '_' || p_partkey || '.h', p_brand || '/' || p_type || '/' || p_name || '.h']) AS file FROM part),
links AS (SELECT p_brand || '/' || p_type || '/x.c' AS path, CASE l_linenumber % 4 WHEN 0 THEN p_name || '_' || p_partkey || '.h' WHEN 1 THEN p_name || '.h' WHEN 2 THEN p_brand || '/' || p_type || '/' || p_name || '_' || p_partkey || '.h' ELSE '../' || p_name || '.h' END AS target
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(
    "resolve_links",
    f"""WITH {_PATHS_SQL}, l AS (SELECT path, target, count(*) AS n FROM links GROUP BY ALL), x AS (SELECT *, NOT starts_with(target, '/') AND NOT list_contains(string_split(target, '/'), '..') AS safe, regexp_extract(path, '^(.*/)', 1) || target AS loc FROM l),
h AS (SELECT DISTINCT x.path, x.target, file FROM x JOIN paths ON safe AND (file = loc OR file = target OR regexp_extract(file, '([^/]*)$', 1) = regexp_extract(target, '([^/]*)$', 1))),
g AS (SELECT path, target, count(*) AS c, array_to_string((list(file ORDER BY file))[1:3], ',') AS firsts FROM h GROUP BY ALL)
SELECT l.path, l.target, n, coalesce(c, 0) AS n_candidates, coalesce(firsts, '') AS first_paths, CASE WHEN c IS NULL THEN 'UNRESOLVED_WITHOUT_BUILD_CONFIG' WHEN c = 1 THEN 'UNIQUE_PATH_CANDIDATE' ELSE 'AMBIGUOUS_PATH_CANDIDATES' END AS resolution
FROM l LEFT JOIN g ON l.path = g.path AND l.target = g.target""",
)
def _(spark, d):
    return rel.resolve_links(*_links(spark, d)).select("path", "target", "n", "n_candidates", F.array_join("first_paths", ",").alias("first_paths"), "resolution")


@query(
    "link_paths",
    f"""WITH {_PATHS_SQL}, l AS (SELECT DISTINCT path, target FROM links WHERE NOT list_contains(string_split(target, '/'), '..')) SELECT path, target, file FROM l JOIN paths ON regexp_extract(file, '([^/]*)$', 1) = regexp_extract(target, '([^/]*)$', 1)
UNION SELECT path, target, file FROM l JOIN paths ON file = regexp_extract(path, '^(.*/)', 1) || target UNION SELECT path, target, file FROM l JOIN paths ON file = target""",
)
def _(spark, d):
    links, paths = _links(spark, d)
    return rel.link_paths(rel.resolve_links(links, paths), paths).select("path", "target", "file")


def _links(spark, d):
    p, li = t.table(spark, d, "part"), t.table(spark, d, "lineitem")
    folder, one = F.concat_ws("/", "p_brand", "p_type"), F.concat_ws("_", "p_name", "p_partkey")
    paths = p.select(F.explode(F.array(F.concat(folder, F.lit("/"), one, F.lit(".h")), F.concat(folder, F.lit("/"), F.col("p_name"), F.lit(".h")))).alias("path")).distinct()
    form = F.col("l_linenumber") % 4
    target = F.when(form == 0, F.concat(one, F.lit(".h"))).when(form == 1, F.concat("p_name", F.lit(".h"))).when(form == 2, F.concat(folder, F.lit("/"), one, F.lit(".h"))).otherwise(F.concat(F.lit("../"), F.col("p_name"), F.lit(".h")))
    links = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.concat(folder, F.lit("/x.c")).alias("path"), target.alias("target")).agg(F.count("*").alias("n"))
    return links, paths


#: Where every line of every text begins, the place behind the last newline included.
_POINTS_SQL = """pts AS (SELECT doc_id, k, coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos, size, l
  FROM (SELECT doc_id, length(text) AS size, unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM documents WHERE length(text) > 0))"""


def _points(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("size"), F.split("text", "\n").alias("ls")).where("size > 0")
    rows = docs.select("doc_id", "size", F.posexplode("ls").alias("k", "l"))
    before = F.sum(F.length("l") + 1).over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("doc_id", F.col("k").cast("long").alias("k"), F.coalesce(before, F.lit(0)).cast("long").alias("pos"), "size", "l")


@query("asof_chunk", f"WITH RECURSIVE {t.CHUNKS_SQL}, {_POINTS_SQL} SELECT p.doc_id, k, pos, ordinal FROM pts p JOIN chunks c ON p.doc_id = c.doc_id AND CASE WHEN pos = size THEN pos - 1 ELSE pos END >= start_char AND CASE WHEN pos = size THEN pos - 1 ELSE pos END < end_char")
def _(spark, d):
    return rel.asof(_points(spark, d).drop("l"), t.chunks(spark, d).select("doc_id", "ordinal", "start_char", "end_char"), "doc_id", "pos", "start_char", "end_char", "size").select("doc_id", "k", "pos", "ordinal")


def _spans(spark, d):
    return _points(spark, d).select("doc_id", "k", F.col("pos").alias("a_start"), (F.col("pos") + 300).alias("a_end"))


def _as_b(spark, d):
    return t.chunks(spark, d).select("doc_id", "ordinal", F.col("start_char").alias("b_start"), F.col("end_char").alias("b_end"))


@query("span_overlap", f"WITH RECURSIVE {t.CHUNKS_SQL}, {_POINTS_SQL} SELECT p.doc_id, k, count(*) AS n, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal FROM pts p JOIN chunks c ON p.doc_id = c.doc_id AND pos < end_char AND pos + 300 > start_char GROUP BY ALL")
def _(spark, d):
    return rel.overlaps(_spans(spark, d), _as_b(spark, d), "doc_id").groupBy("doc_id", "k").agg(F.count("*").alias("n"), F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"))


@query("enclosing_semi", f"WITH RECURSIVE {t.CHUNKS_SQL}, {_POINTS_SQL} SELECT doc_id, k FROM pts p WHERE EXISTS (SELECT 1 FROM chunks c WHERE p.doc_id = c.doc_id AND pos < end_char AND pos + 300 > start_char AND n_bytes > end_char - start_char)")
def _(spark, d):
    wide = t.chunks(spark, d).where("n_bytes > end_char - start_char").select("doc_id", F.col("start_char").alias("b_start"), F.col("end_char").alias("b_end"))
    return rel.overlaps(_spans(spark, d), wide, "doc_id", "left_semi").select("doc_id", "k")


@query(
    "cross_file",
    f"""WITH {_RESOLVE_SQL}, own AS (SELECT DISTINCT caller, path FROM calls), x AS (SELECT DISTINCT e.caller, e.symbol_id, s.path FROM edges e JOIN symbols s USING (symbol_id))
SELECT caller, count(*) AS cross_file_target_count FROM x WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.caller = x.caller AND own.path = x.path) GROUP BY caller""",
)
def _(spark, d):
    resolved = _resolved(spark, d)
    return build.cross_targets(resolved, t.symbols(spark, d), t.calls(spark, d).select("caller", "path"), "caller")


@query(
    "anchor_semi",
    f"WITH s AS (SELECT o_orderkey, row_number() OVER (ORDER BY h, o_orderkey) AS batch_rank FROM (SELECT o_orderkey, sha256('codegrain/selection' || chr(0) || '{t.SEED}' || chr(0) || o_orderkey) AS h FROM orders) ORDER BY h, o_orderkey LIMIT 3) SELECT batch_rank, l_partkey, count(*) AS n FROM lineitem JOIN s ON l_orderkey = o_orderkey GROUP BY ALL",
)
def _(spark, d):
    chosen = build.selection(t.table(spark, d, "orders").select(F.col("o_orderkey").alias("batch_id")), t.SEED)
    return t.table(spark, d, "lineitem").join(F.broadcast(chosen), F.col("l_orderkey") == F.col("batch_id")).groupBy(F.col("rank").alias("batch_rank"), "l_partkey").agg(F.count("*").alias("n"))


@query(
    "no_fact_anti",
    "SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality + toxic > 0) AND doc_id NOT IN (SELECT conv_id FROM conversations) AND coalesce(length(text) - length(replace(text, '|', '')), 0) = 0 AND doc_id NOT IN (SELECT page_id FROM pages)",
)
def _(spark, d):
    text = F.col("text")
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))), F.lit(0)).alias("total"))
    marked = t.table(spark, d, "labels").where("quality + toxic > 0").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("id"))
    said = t.table(spark, d, "conversations").select(F.col("conv_id").alias("chunk_id"), F.col("turn").alias("id"))
    facts = build.attached(said, ["chunk_id"], "id", "outgoing_call_ids", build.attached(marked, ["chunk_id"], "id", "defined_symbol_ids", docs))
    return build.without_facts(facts, t.table(spark, d, "pages").select(F.col("page_id").alias("anchor_chunk_id"))).select("chunk_id")


@query("incoming_edges", f"WITH {_RESOLVE_SQL}, n AS (SELECT via, pool, local_symbol_id, count(*) AS c FROM resolved WHERE via IS NOT NULL GROUP BY ALL) SELECT symbol_id, sum(c)::BIGINT AS n_calls FROM n JOIN u USING (via, pool) WHERE use = 'DEFINITION' AND (local_symbol_id IS NULL OR local_symbol_id = symbol_id) GROUP BY symbol_id")
def _(spark, d):
    return rel.incoming(_resolved(spark, d), t.symbols(spark, d))


@query("outgoing_edges", f"WITH {_RESOLVE_SQL} SELECT caller AS symbol_id, count(*) AS n_calls, count(DISTINCT via || ':' || pool) AS n_pools FROM resolved GROUP BY caller")
def _(spark, d):
    return rel.outgoing(_resolved(spark, d), "caller")


_DRAWN_SQL = f"drawn AS (SELECT symbol_id FROM symbols ORDER BY sha256('{t.DOMAIN}' || chr(0) || '{t.SEED}' || chr(0) || symbol_id), symbol_id LIMIT 20)"


@query("called_by", f"WITH {_RESOLVE_SQL}, {_DRAWN_SQL} SELECT symbol_id, caller, resolution FROM edges JOIN drawn USING (symbol_id) GROUP BY ALL")
def _(spark, d):
    symbols = t.symbols(spark, d)
    drawn = scoring.hash_sample(symbols.select("symbol_id"), "symbol_id", t.DOMAIN, t.SEED, 20).select("symbol_id")
    return rel.callers(drawn, _resolved(spark, d), symbols).select("symbol_id", "caller", "resolution").distinct()


@query("search_exact", f"WITH {t.SYMBOLS_SQL} SELECT DISTINCT w AS wanted, symbol_id FROM symbols, (VALUES ('cold widget'), ('Brand#5::small widget'), ('none')) v(w) WHERE name = w OR qualified_name = w")
def _(spark, d):
    return rel.search_exact(t.symbols(spark, d), spark.createDataFrame([("cold widget",), ("Brand#5::small widget",), ("none",)], "wanted string"))


@query("suffix_lookup", f"WITH {t.SYMBOLS_SQL} SELECT w AS suffix, symbol_id FROM symbols, (VALUES ('cold widget'), ('brand#5::small widget'), ('widget')) v(w) WHERE lower(name) = w OR lower(qualified_name) = w OR ends_with(lower(qualified_name), '::' || w)")
def _(spark, d):
    wanted = F.broadcast(spark.createDataFrame([("cold widget",), ("brand#5::small widget",), ("widget",)], "suffix string"))
    return rel.suffixes(t.symbols(spark, d).select("symbol_id", "name", "qualified_name")).join(wanted, "suffix").select("suffix", "symbol_id").distinct()


@query("one_hop", f"WITH {_RESOLVE_SQL} SELECT DISTINCT r.path, x.symbol_id, r.resolution FROM (SELECT DISTINCT path, resolution, unnest(firsts) AS symbol_id FROM resolved) r JOIN symbols x USING (symbol_id) WHERE x.path IS DISTINCT FROM r.path")
def _(spark, d):
    homes = t.symbols(spark, d).select("symbol_id", F.col("path").alias("home"))
    return rel.callees(_resolved(spark, d), "path", homes)


@query("reconcile", "SELECT CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'equal' ELSE 'different' END AS state, count(*) AS n FROM (SELECT doc_id AS k, n_chars % 2 AS v FROM documents) a FULL JOIN (SELECT doc_id AS k, quality AS v FROM labels) b ON a.k = b.k GROUP BY 1")
def _(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).alias("v"))
    return rel.reconcile(docs, t.table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("v")), "doc_id", "v")


@query("exactly_once", "WITH n AS (SELECT conv_id AS i, count(*) AS c FROM conversations GROUP BY 1) SELECT coalesce(sum((c > 1)::INT), 0)::BIGINT AS n_repeated, coalesce(sum((doc_id IS NULL)::INT), 0)::BIGINT AS n_unknown, coalesce(sum((i IS NULL)::INT), 0)::BIGINT AS n_missing FROM n FULL JOIN documents ON i = doc_id")
def _(spark, d):
    return validate.exactly_once(t.table(spark, d, "conversations"), "conv_id", t.table(spark, d, "documents"), "doc_id")


@query("dup_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return validate.repeated_ids(t.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("rebuild_equal", "WITH a AS (SELECT lang, source FROM documents), b AS (SELECT lang, source FROM documents JOIN labels USING (doc_id)) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_first, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_second")
def _(spark, d):
    docs = t.table(spark, d, "documents")
    return rel.equal_tables(docs.select("lang", "source"), docs.join(t.table(spark, d, "labels"), "doc_id").select("lang", "source"))


@query("coverage_report", "SELECT lang, count(*) AS n_files, sum(strlen(text))::BIGINT AS n_bytes, sum((strlen(text) = length(text))::INT)::BIGINT AS n_ascii FROM documents GROUP BY lang")
def _(spark, d):
    return t.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n_files"), F.sum(fn.byte_length(F.col("text"))).alias("n_bytes"), F.sum((F.octet_length("text") == F.length("text")).cast("long")).alias("n_ascii"))


@query("dir_counts", f"WITH {t.FILES_SQL} SELECT string_split(path, '/')[1] AS top, regexp_extract(path, '(\\.[^./]*)$', 1) AS extension, count(*) AS n FROM files GROUP BY ALL")
def _(spark, d):
    return t.files(spark, d).groupBy(F.split("path", "/")[0].alias("top"), fn.extension(F.col("path")).alias("extension")).agg(F.count("*").alias("n"))


@query("telemetry_rollup", f"WITH {t.TURNS_SQL} SELECT role, count(*) AS calls, sum(n_bytes)::BIGINT AS bytes, max(turn) AS max_turn FROM turns GROUP BY role")
def _(spark, d):
    return rollup.telemetry(t.turns(spark, d), "role", "n_bytes", "turn")


@query(
    "handoff_reduction",
    f"""WITH {t.TURNS_SQL}, b AS (SELECT conv_id, sum(CASE WHEN turn = 0 THEN n_bytes END) AS f, count(*) FILTER (turn > 0) AS l, sum(CASE WHEN turn > 0 THEN n_bytes END) AS s FROM turns GROUP BY conv_id),
x AS (SELECT coalesce(sum(f * l), 0)::BIGINT AS b, coalesce(sum(s), 0)::BIGINT AS p FROM b) SELECT b AS baseline_bytes, p AS proposed_bytes, b - p AS avoided_bytes, CASE WHEN b = 0 THEN 0.0 ELSE round(100 * (b - p) / b::DOUBLE, 2) END AS reduction_percent FROM x""",
)
def _(spark, d):
    return rollup.handoff(t.turns(spark, d), "conv_id", "turn", "n_bytes")


@query(
    "batch_status",
    """WITH x AS (SELECT source, count(quality) AS n, bool_or(coalesce(toxic = 1, false)) AS v, bool_or(coalesce(quality = 0, false)) AS i FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
SELECT source, n AS n_findings, CASE WHEN n = 0 THEN 'CLEAR' WHEN v THEN 'HAS_VERIFIED' WHEN i THEN 'INCONCLUSIVE' ELSE 'NO_VERIFIED' END AS status FROM x""",
)
def _(spark, d):
    found = t.table(spark, d, "documents").select("doc_id", "source").join(t.table(spark, d, "labels"), "doc_id", "left")
    return rollup.batch_status(found, "source", F.col("toxic") == 1, F.col("quality") == 0)


@query(
    "finding_id",
    r"SELECT conv_id, turn, left(sha256(conv_id || chr(0) || turn || chr(0) || lower(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')))), 20) AS finding_id FROM conversations",
)
def _(spark, d):
    return t.table(spark, d, "conversations").select("conv_id", "turn", rollup.finding_id(F.col("conv_id"), F.col("turn"), F.col("text")).alias("finding_id"))


@query("bundle_hash", "SELECT sha256('codegrain/bundle' || chr(0) || '{' || string_agg('\"' || r_name || '\":\"' || sha256(r_regionkey::VARCHAR) || '\"', ',' ORDER BY r_name) || '}') AS bundle_sha256, count(*) AS n FROM region")
def _(spark, d):
    return rollup.bundle_hash(t.table(spark, d, "region").select("r_name", F.sha2(F.col("r_regionkey").cast("string"), 256).alias("h")), "r_name", "h", "codegrain/bundle")


@query("file_list_hash", f"WITH {t.FILES_SQL} SELECT source, sha256(string_agg(path, chr(0) ORDER BY path)) AS ordered_hash, count(*) AS n FROM files GROUP BY source")
def _(spark, d):
    return rollup.ordered_hash(t.files(spark, d), ["source"], ["path"], "path")


@query("tree_hash", f"WITH {t.FILES_SQL}, l AS (SELECT source, b, sha256(string_agg(path, chr(0) ORDER BY path)) AS h, count(*) AS n FROM (SELECT source, path, (row_number() OVER (PARTITION BY source ORDER BY path) - 1) // 16 AS b FROM files) GROUP BY ALL) SELECT source, sha256(string_agg(h, chr(0) ORDER BY b)) AS tree_hash, sum(n)::BIGINT AS n FROM l GROUP BY source")
def _(spark, d):
    return rollup.tree_hash(t.files(spark, d), "source", ["path"], "path", leaf=16)


@query("prefix_delta", f"WITH {t.TURNS_SQL}, c AS (SELECT conv_id, turn, sum(n_bytes) OVER (PARTITION BY conv_id ORDER BY turn) AS x FROM turns) SELECT conv_id, turn, x::BIGINT AS x, (x - coalesce(lag(x) OVER (PARTITION BY conv_id ORDER BY turn), 0))::BIGINT AS delta FROM c")
def _(spark, d):
    running = F.sum("n_bytes").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return rollup.prefix_delta(t.turns(spark, d).select("conv_id", "turn", running.alias("x")), "conv_id", "turn", "x")


@query("dedupe_first", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1")
def _(spark, d):
    return rel.first_of(t.table(spark, d, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("resume_anti", "SELECT conv_id AS batch_id, turn AS batch_ordinal FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = conv_id AND quality = turn)")
def _(spark, d):
    asked = t.table(spark, d, "conversations").select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("batch_ordinal"))
    done = t.table(spark, d, "labels").select(F.col("doc_id").alias("batch_id"), F.col("quality").alias("batch_ordinal"))
    return workflow.resume(asked, done)


@query("dry_run", f"WITH {t.FRAMES_SQL} SELECT doc_id AS batch_id, doc_id AS batch_ordinal, n_bytes AS evidence_bytes, sha AS evidence_sha256 FROM frames")
def _(spark, d):
    return workflow.dry_run(t.frame_texts(spark, d).select(F.col("doc_id").alias("batch_id"), F.col("doc_id").alias("batch_ordinal"), F.col("frame").alias("evidence")))


@query("budget_prefix", f"WITH {t.TURNS_SQL} SELECT conv_id, turn FROM (SELECT conv_id, turn, 1 + sum(n_bytes + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS u FROM turns) WHERE u <= 900")
def _(spark, d):
    return ch.budget_prefix(t.turns(spark, d), "conv_id", ["turn"], "n_bytes", 900).select("conv_id", "turn")


@query(
    "pack_skip",
    f"""WITH RECURSIVE {t.TURNS_SQL}, o AS (SELECT conv_id, turn, n_bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM turns),
p(conv_id, r, turn, used, took) AS (SELECT conv_id, 0::BIGINT, -1::BIGINT, 0::BIGINT, false FROM (SELECT DISTINCT conv_id FROM o) UNION ALL
  SELECT o.conv_id, o.r, o.turn, CASE WHEN used + n_bytes <= 600 THEN used + n_bytes ELSE used END, used + n_bytes <= 600 FROM p JOIN o ON o.conv_id = p.conv_id AND o.r = p.r + 1)
SELECT conv_id, turn FROM p WHERE took""",
)
def _(spark, d):
    listed = t.turns(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "n_bytes"))).alias("s"))
    taken = listed.withColumn("pos", ch.pack_skip(600)(F.col("s.n_bytes")))
    return taken.select("conv_id", F.explode(F.transform("pos", lambda i: F.get(F.col("s"), i)["turn"])).alias("turn"))


@query("pop_tail", f"WITH {t.TURNS_SQL} SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(n_bytes) OVER (PARTITION BY conv_id ORDER BY turn) AS u FROM turns) WHERE u <= 1200")
def _(spark, d):
    return ch.pop_tail(t.turns(spark, d), "conv_id", ["turn"], "n_bytes", 1200).select("conv_id", "turn")


@query("source_order", f"WITH {t.FILES_SQL} SELECT path, doc_id, row_number() OVER (ORDER BY path, doc_id) - 1 AS ordinal FROM files")
def _(spark, d):
    return ordering.source_order(t.files(spark, d).select("path", "doc_id"), "path", "doc_id")


@query("symbol_identity", f"WITH {t.SYMBOLS_SQL} SELECT symbol_id, 'S-' || left(sha256('codegrain/symbol' || chr(0) || json_object('linkage', linkage, 'name', name, 'path', path, 'qualified_name', qualified_name, 'role', role, 'start_byte', start_byte, 'symbol_id', symbol_id, 'symbol_kind', symbol_kind)::VARCHAR), 24) AS id FROM symbols")
def _(spark, d):
    s = t.symbols(spark, d)
    return s.select("symbol_id", fn.hex_id("S-", F.lit("codegrain/symbol"), fn.canonical_json(**{c: F.col(c) for c in s.columns})).alias("id"))


_AT = "CASE WHEN pos = size THEN pos - 1 ELSE pos END"
_LINE_KINDS = ("TABLE", "SHORT", "PROSE")
_LINE_KIND = "CASE WHEN strpos(l, '|') > 0 THEN 'TABLE' WHEN length(l) < 60 THEN 'SHORT' ELSE 'PROSE' END"


def _lines(spark, d):
    kind = F.when(F.instr("l", "|") > 0, "TABLE").when(F.length("l") < 60, "SHORT").otherwise("PROSE")
    return _points(spark, d).withColumn("fact", kind).drop("l")


@query(
    "fact_histogram",
    f"WITH RECURSIVE {t.CHUNKS_SQL}, {_POINTS_SQL}, a AS (SELECT c.doc_id, ordinal, {_LINE_KIND} AS f FROM pts p JOIN chunks c ON p.doc_id = c.doc_id AND {_AT} >= start_char AND {_AT} < end_char) SELECT doc_id, ordinal, sum((f = 'TABLE')::INT)::BIGINT AS n_table, sum((f = 'SHORT')::INT)::BIGINT AS n_short, sum((f = 'PROSE')::INT)::BIGINT AS n_prose, count(*) AS total FROM a GROUP BY ALL",
)
def _(spark, d):
    got = build.fact_counts(_lines(spark, d), t.chunks(spark, d), "doc_id", "pos", "start_char", "end_char", "size", "ordinal", "fact", _LINE_KINDS)
    return got.select("doc_id", "ordinal", *[F.col(k).alias(f"n_{k.lower()}") for k in _LINE_KINDS], "total")


@query(
    "chunk_facts",
    f"WITH RECURSIVE {t.CHUNKS_SQL}, {_POINTS_SQL}, a AS (SELECT c.doc_id, ordinal, string_agg(k::VARCHAR, ',' ORDER BY k) AS ks FROM pts p JOIN chunks c ON p.doc_id = c.doc_id AND {_AT} >= start_char AND {_AT} < end_char GROUP BY ALL) SELECT c.doc_id, c.ordinal, coalesce(ks, '') AS ids FROM chunks c LEFT JOIN a ON a.doc_id = c.doc_id AND a.ordinal = c.ordinal",
)
def _(spark, d):
    c = t.chunks(spark, d).select("doc_id", "ordinal", "start_char", "end_char")
    held = rel.asof(_points(spark, d).drop("l"), c, "doc_id", "pos", "start_char", "end_char", "size")
    listed = build.attached(held, ["doc_id", "ordinal"], "k", "ids", c.select("doc_id", "ordinal"))
    return listed.select("doc_id", "ordinal", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
