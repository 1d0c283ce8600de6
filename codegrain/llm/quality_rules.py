"""Operator 2, quality rules: how many documents of a host hold a line.

Every line is normalised (trimmed, white space collapsed, lower case) and hashed.
Per host, the distinct documents that hold a line are counted; lines above the
host's limit are boilerplate and are removed; a document of which too little is
left is depleted and rejected. Besides, a few base counts of the text reject
documents that are too short or repeat themselves.

Copies must not condemn each other, so documents are told apart by the whole set
of their lines: copies of one text count once for a line, documents that share
any number of lines and differ in one count severally.

DataFrame functions only. Lines are hashed once, into a staged table of a row per
line (host, row key, place, hash, length, document hash); it is pre-aggregated by
host and hash before it moves. Texts don't move while the tables that meet them,
of frequent lines and of what each document loses, have MOST_BROADCAST rows at
most; beyond, both are joined by a shuffle, where Spark splits a line that a third
of all documents hold.

Defined results: null text has no words and fails the base rule; null hosts are
one host; null ids and repeated ids are judged by row, and rows that repeat each
other get the same verdict; a text of any length is one row, and equal hashes of
its words are compared by word; an empty table gives an empty result; other
columns of the input are never looked at, and keep() hands them on whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.llm.common import WS_CHARS, WS_REGEX, documents, limited, row_key, staged

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is boilerplate when more documents of its host hold it than this many and than this share of the host's.
LINE_DOCS, LINE_SHARE_PERMILLE = 20, 10
#: A document is depleted when fewer characters are left than this many or than this share.
LEFT_CHARS, LEFT_PERCENT = 150, 50
#: Rows of a table that is broadcast at most; of lines, which are shorter, five times as many.
MOST_BROADCAST = 200_000

_RX = WS_REGEX.replace("\\", "\\\\")
_TRIM = WS_CHARS.replace("\t", "\\t").replace("\n", "\\n").replace("\x0b", "\\u000b").replace("\f", "\\u000c").replace("\r", "\\r")


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is then evaluated once a row."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: From the words w and the bits b of a position: hash and position of every 3-word window in one long, sorted.
_BITS = "cast(ceil(log2(size(w) + 1)) as int)"
_CODES = "sort_array(transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> coalesce(shiftleft(xxhash64(x, get(w, i + 1), get(w, i + 2)), b) | cast(i as bigint), 0L)))"
#: Positions, in order, of the windows that are equal to a neighbour in that list.
_AT = "cast({} & (shiftleft(1L, b) - 1) as int)"
_SAME = " and ".join(f"get(w, {_AT.format('x')} + {i}) = get(w, {_AT.format('y')} + {i})" for i in range(3))
_PAIRS = f"array_compact(zip_with(s, slice(s, 2, size(s)), (x, y) -> if(shiftright(x ^ y, b) = 0 and {_SAME}, array(x, y), null)))"
_TWICE = f"sort_array(transform(array_distinct(flatten({_PAIRS})), x -> x & (shiftleft(1L, b) - 1)))"
_COVER = "aggregate(p, named_struct('n', 0L, 'q', -3L), (a, x) -> named_struct('n', a.n + least(3L, x - a.q), 'q', x), a -> a.n)"
_REPEATS = _let("b", _BITS, _let("s", _CODES, _let("p", _TWICE, _COVER)))
_LINES = f"filter(split(text, '\\n'), l -> btrim(l, '{_TRIM}') <> '')"


def base_counts() -> dict[str, str]:
    """SQL of the base counts of the non-null column text."""
    words = f"if(btrim(text, '{_TRIM}') = '', cast(array() as array<string>), split(btrim(text, '{_TRIM}'), '{_RX}'))"
    return {
        "of_words": _let("w", words, f"named_struct('n', cast(size(w) as bigint), 'c', cast(length(array_join(w, '')) as bigint), 'r', {_REPEATS})"),
        "n_symbols": "cast(regexp_count(text, '[#*$%&|<>]') as bigint)",
        "n_dup_lines": _let("ls", _LINES, "cast(size(ls) - size(array_distinct(ls)) as bigint)"),
    }


def _hash(line: str) -> str:
    """SQL of a line's hash, once it is normalised."""
    return f"unhex(md5(lower(regexp_replace(btrim({line}, '{_TRIM}'), '{_RX}', ' '))))"


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line of a document: host, k, place, line, chars, doc (how the document is told from others)."""
    hashed = f"transform({_LINES}, l -> named_struct('h', {_hash('l')}, 'n', cast(length(l) as bigint)))"
    one = "named_struct('place', i, 'line', l.h, 'chars', l.n, 'doc', d)"
    each = _let("ls", hashed, _let("d", "unhex(md5(array_join(transform(array_sort(array_distinct(transform(ls, l -> l.h))), h -> hex(h)), '')))", f"transform(ls, (l, i) -> {one})"))
    return docs.select("host", "k", F.explode(F.expr(each)).alias("l")).select("host", "k", "l.*")


def _limited(df: DataFrame) -> DataFrame:
    return limited(df, MOST_BROADCAST)


def _losses(rows: DataFrame, line_docs: int, line_share_permille: int) -> DataFrame:
    """g_host, g_k, n_lines, n_gone (characters), lines (their hashes) of documents (host, k, text) that hold lines above the limits."""
    lines = staged(_lines(rows), "lines")
    per_host = rows.groupBy("host").agg(F.count("*").alias("host_docs"))
    often = lines.select("host", "line", "doc").distinct().groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > line_docs)
    often = often.join(_limited(staged(per_host, "hosts")), "host").where(F.col("docs") * 1000 > F.col("host_docs") * line_share_permille)
    often = staged(often.select("host", "line"), "frequent-lines")
    held = lines.select("host", "k", "place", "line", "chars").join(_limited(often), ["host", "line"])
    # A set, so that rows which repeat each other count a line once.
    held = held.groupBy(F.col("host").alias("g_host"), F.col("k").alias("g_k")).agg(F.collect_set(F.struct("place", "line", "chars")).alias("l"))
    held = held.select("g_host", "g_k", F.size("l").cast("long").alias("n_lines"), F.expr("aggregate(l, 0L, (a, x) -> a + x.chars)").alias("n_gone"), F.expr("array_distinct(transform(l, x -> x.line))").alias("lines"))
    return staged(held, "losses")


def _base_failed(of_words: Column) -> Column:
    n = of_words["n"]
    return (n < MIN_WORDS) | (100 * of_words["r"] > MAX_REPEAT_PERCENT * n)


def _depleted(n_chars: Column, n_gone: Column) -> Column:
    left = n_chars - n_gone
    return n_gone.isNotNull() & ((left < LEFT_CHARS) | (100 * left < LEFT_PERCENT * n_chars))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    line_docs: int = LINE_DOCS,
    line_share_permille: int = LINE_SHARE_PERMILLE,
) -> DataFrame:
    """One row for each row of ``docs``: id, base counts, removed lines and characters, verdict.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_removed_lines, n_removed_chars (long), base_failed,
    depleted, kept (boolean).
    """
    rows = _rows(docs, id_col, text_col, host_col)
    lost = _losses(rows, line_docs, line_share_permille).drop("lines")
    counted = rows.select("doc_id", "host", "k", F.length("text").alias("n_chars"), *[F.expr(v).alias(c) for c, v in base_counts().items()])
    out = counted.join(_limited(lost), (F.col("host") == F.col("g_host")) & (F.col("k") == F.col("g_k")), "left")
    failed, depleted = _base_failed(F.col("of_words")), _depleted(F.col("n_chars"), F.col("n_gone"))
    return out.select(
        "doc_id",
        F.col("of_words.n").alias("n_words"),
        F.col("of_words.c").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        F.col("of_words.r").alias("n_repeat_words"),
        F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_removed_lines"),
        F.coalesce("n_gone", F.lit(0).cast("long")).alias("n_removed_chars"),
        failed.alias("base_failed"),
        depleted.alias("depleted"),
        (~failed & ~depleted).alias("kept"),
    )


def _rows(docs: DataFrame, id_col: str, text_col: str, host_col: str, *more: Column) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        row_key(id_col, text_col).alias("k"),
        *more,
    )


def keep(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; the text without the lines above the limits."""
    rows = _rows(docs, id_col, text_col, host_col, F.struct("*").alias("row"))
    lost = _losses(rows.select("host", "k", "text"), LINE_DOCS, LINE_SHARE_PERMILLE)
    good = rows.where(~_base_failed(F.expr(base_counts()["of_words"])))
    out = good.join(limited(lost, 5 * MOST_BROADCAST, "n_lines"), (F.col("host") == F.col("g_host")) & (F.col("k") == F.col("g_k")), "left")
    out = out.where(~_depleted(F.length("text"), F.col("n_gone")))
    # A blank line is hashed like any other but is in no list.
    left = f"array_join(filter(split(text, '\\n'), l -> not array_contains(lines, {_hash('l')})), '\\n')"
    text = F.when(F.col("lines").isNotNull(), F.expr(left)).otherwise(F.col(f"row.`{text_col}`"))
    return out.select(*[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


ORACLE_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT doc_id, text, host, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM docs),
tri AS (SELECT doc_id, p, g, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
  SELECT doc_id, p, [ws[p], ws[p + 1], ws[p + 2]] AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS p FROM w WHERE len(ws) >= 3))),
rep AS (SELECT doc_id, count(DISTINCT q) AS r FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM tri WHERE c >= 2) GROUP BY doc_id),
raw AS (SELECT doc_id, host, l FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS d FROM raw GROUP BY doc_id),
ln AS (SELECT doc_id, host, lower(regexp_replace(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS h, length(l) AS chars FROM raw),
-- Documents with the same set of lines count once.
own AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT h)), chr(10)) AS d FROM ln GROUP BY doc_id),
seen AS (SELECT DISTINCT host, h, d FROM ln JOIN own USING (doc_id)),
hosts AS (SELECT host, count(*) AS host_docs FROM docs GROUP BY host),
freq AS (SELECT host, h FROM (SELECT host, h, count(*) AS c FROM seen GROUP BY host, h) JOIN hosts USING (host) WHERE c > {LINE_DOCS} AND c * 1000 > host_docs * {LINE_SHARE_PERMILLE}),
gone AS (SELECT doc_id, count(*) AS gl, sum(chars) AS gw FROM ln JOIN freq USING (host, h) GROUP BY doc_id),
f AS (SELECT w.doc_id, length(text) AS nc, CAST(len(ws) AS BIGINT) AS n, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(d, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r, 0) AS BIGINT) AS r, CAST(coalesce(gl, 0) AS BIGINT) AS gl, CAST(coalesce(gw, 0) AS BIGINT) AS gw
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)),
v AS (SELECT *, n < {MIN_WORDS} OR 100 * r > {MAX_REPEAT_PERCENT} * n AS bad, gl > 0 AND (nc - gw < {LEFT_CHARS} OR 100 * (nc - gw) < {LEFT_PERCENT} * nc) AS dep FROM f)
SELECT doc_id, n AS n_words, word_chars, n_symbols, n_dup_lines, r AS n_repeat_words, gl AS n_removed_lines, gw AS n_removed_chars,
  bad AS base_failed, dep AS depleted, NOT bad AND NOT dep AS kept FROM v
"""
