"""How the operators are bound to the tables at hand.

The tables hold no source code, so each concept has a stand-in: documents are
files, parts are symbols, line items are calls, orders are batches, conversations
are runs of an analyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.functions.text import byte_length
from codegrain.operators.chunks import windows

CAP = 512
FRAME_CAP = 8192
DOMAIN, SEED = "codegrain/sample", "2024"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    """documents with a path, an extension by id and a mode by id."""
    docs = table(spark, d, "documents")
    ext = F.element_at(F.array(*map(F.lit, (".c", ".h", ".cpp", ".s", ".txt", ""))), (F.col("doc_id") % 6 + 1).cast("int"))
    mode = F.when(F.col("doc_id") % 11 == 0, "120000").when(F.col("doc_id") % 7 == 0, "100755").otherwise("100644")
    return docs.withColumn("path", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), ext))).withColumn("mode", mode)


FILES_SQL = """files AS (SELECT *, source || '/' || lang || '/' || doc_id || (['.c', '.h', '.cpp', '.s', '.txt', ''])[doc_id % 6 + 1] AS path,
  CASE WHEN doc_id % 11 = 0 THEN '120000' WHEN doc_id % 7 = 0 THEN '100755' ELSE '100644' END AS mode FROM documents)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return windows(table(spark, d, "documents"), CAP)


#: Windows of CAP bytes: the longest prefix that fits, cut after its last newline unless it is the rest.
CHUNKS_SQL = f"""win(doc_id, ordinal, s, e) AS (
  SELECT doc_id, -1::BIGINT, 0::BIGINT, 0::BIGINT FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, ordinal + 1, e, CASE WHEN e + k >= n OR strpos(x, chr(10)) = 0 THEN e + k ELSE e + k - length(list_extract(string_split(x, chr(10)), -1)) END FROM (
    SELECT doc_id, ordinal, e, n, k, left(c, k::INT) AS x FROM (
      SELECT w.doc_id, ordinal, e, length(text) AS n, substring(text, e::INT + 1, {CAP}) AS c,
        CASE WHEN strlen(c) <= {CAP} THEN length(c) ELSE list_max(list_filter(range({CAP} // 4, length(c)), lambda i: strlen(left(c, i::INT)) <= {CAP})) END AS k
      FROM win w JOIN documents d ON d.doc_id = w.doc_id WHERE e < length(text)))),
chunks AS (SELECT w.doc_id, ordinal, s AS start_char, e AS end_char, strlen(substring(text, s::INT + 1, (e - s)::INT)) AS n_bytes,
  strlen(left(text, s::INT)) AS start_byte, strlen(left(text, e::INT)) AS end_byte, sha256(substring(text, s::INT + 1, (e - s)::INT)) AS sha
  FROM win w JOIN documents d ON d.doc_id = w.doc_id WHERE ordinal >= 0)"""


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """parts as symbols: name, qualified name, kind and role by size, linkage by size, path by brand."""
    p = table(spark, d, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.concat_ws("::", "p_brand", "p_name").alias("qualified_name"),
        F.when(size % 4 == 2, "MACRO").when(size % 4 == 3, "STRUCT").otherwise("FUNCTION").alias("symbol_kind"), F.when(size % 4 == 1, "DECLARATION").otherwise("DEFINITION").alias("role"),
        F.when(size % 8 == 0, "INTERNAL").otherwise("EXTERNAL").alias("linkage"), F.col("p_brand").alias("path"), size.cast("long").alias("start_byte"),
    )


SYMBOLS_SQL = """symbols AS (SELECT p_partkey AS symbol_id, p_name AS name, p_brand || '::' || p_name AS qualified_name, CASE p_size % 4 WHEN 2 THEN 'MACRO' WHEN 3 THEN 'STRUCT' ELSE 'FUNCTION' END AS symbol_kind,
  CASE WHEN p_size % 4 = 1 THEN 'DECLARATION' ELSE 'DEFINITION' END AS role, CASE WHEN p_size % 8 = 0 THEN 'INTERNAL' ELSE 'EXTERNAL' END AS linkage, p_brand AS path, p_size::BIGINT AS start_byte FROM part)"""


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Line items as calls; the callee's expression is qualified for every third part, the caller's path is a brand by supplier."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    kind = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "INDIRECT").when(F.col("l_returnflag") == "A", "MEMBER").otherwise("DIRECT")
    name = F.when(F.col("l_quantity") == 50, F.lit(None)).otherwise(F.col("p_name"))
    expression = F.when(F.col("l_partkey") % 3 == 0, F.concat_ws("::", "p_brand", "p_name")).otherwise(F.col("p_name"))
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("caller"), F.col("l_partkey").alias("target"), F.col("l_linenumber").alias("line"), kind.alias("kind"), name.alias("callee_name"), expression.alias("callee_expression"),
        F.when(F.col("l_suppkey") % 2 == 0, F.col("p_brand")).otherwise(F.lit("none")).alias("path"),
    )


CALLS_SQL = """calls AS (SELECT l_orderkey AS caller, l_partkey AS target, l_linenumber AS line, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'INDIRECT' WHEN l_returnflag = 'A' THEN 'MEMBER' ELSE 'DIRECT' END AS kind,
  CASE WHEN l_quantity = 50 THEN NULL ELSE p_name END AS callee_name, CASE WHEN l_partkey % 3 = 0 THEN p_brand || '::' || p_name ELSE p_name END AS callee_expression,
  CASE WHEN l_suppkey % 2 = 0 THEN p_brand ELSE 'none' END AS path FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.withColumn("n_bytes", F.coalesce(byte_length(F.col("text")), F.lit(0).cast("long")))


TURNS_SQL = "turns AS (SELECT *, coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM conversations)"


def frame_texts(spark: SparkSession, d: str) -> DataFrame:
    """Evidence frames of documents: header, canonical JSON, fenced content."""
    from codegrain.functions.text import canonical_json

    docs = table(spark, d, "documents")
    body = F.concat(F.lit("@@CHUNK "), canonical_json(doc_id=F.col("doc_id"), kind=F.lit("DOCUMENT"), source=F.col("source"), sha256=F.sha2("text", 256)), F.lit("\n<<<TEXT\n"), F.col("text"), F.lit("\nTEXT>>>\n"))
    return docs.select("doc_id", body.alias("frame"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    return frame_texts(spark, d).select("doc_id", byte_length(F.col("frame")).alias("n_bytes"), F.sha2("frame", 256).alias("sha"))


FRAMES_SQL = """frames AS (SELECT doc_id, strlen(frame)::BIGINT AS n_bytes, sha256(frame) AS sha FROM (SELECT doc_id,
  '@@CHUNK ' || json_object('doc_id', doc_id, 'kind', 'DOCUMENT', 'sha256', sha256(text), 'source', source)::VARCHAR || chr(10) || '<<<TEXT' || chr(10) || text || chr(10) || 'TEXT>>>' || chr(10) AS frame FROM documents))"""

# Stand-ins for the rule table: part types, exact and by prefix.
TYPE_RULES = {"PROMO": ("offer", 9), "STANDARD": ("base", 3), "LARGE": ("size", 6)}
TYPE_PREFIXES = (("ECON", "price", 4), ("SM", "size", 2))
