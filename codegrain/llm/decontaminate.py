"""Operator 4, benchmark decontamination with a positional inverted index.

The corpus is turned into postings (term, document, position) for the terms of
the benchmark, which are stored once and then only looked up. Terms are runs of
TERM neighbouring words, as in a next-word index: what the lists of TERM single
words have in common after their offsets are adjusted. A window of an item (13
consecutive words, or a shorter item as a whole) is looked up by its rarest
terms, one more than words may differ, that have no word in common; a posting's
position less the term's offset in the item is the place where the item would
begin, a candidate. It is compared with the item word by word; a run of equal
words as long as a window is an exact phrase, a stretch as long with at most two
differing words, and two equal ones, a proximity match. Two words can't take
three terms away that share no word, so no match is lost. A window too short for
three terms is cut into as many stretches as it needs, and their first words are
the terms. Words are compared place by place: a word put in or left out splits
an item.

DataFrame functions only. Texts are split where they lie; what moves is a row
for each posting of a benchmark term, of which there are few that are not part
of a match. Tables are broadcast while they have MOST_BROADCAST rows, or words,
at most, and joined by a shuffle beyond, where a term of very many postings is
split among tasks like any other skewed join.

The index folds case in all alphabets, which can only add candidates; the
comparison lower-cases A-Z alone.

Defined results: null or blank text has no words and no hits; items without an
id or words are left out; items of one id count once; repeated rows of documents
get the same result each; an empty benchmark hits nothing; an empty table of
documents gives an empty result; a text of any length is one row throughout;
other columns are never looked at, and keep() hands them on whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.llm.common import documents, limited, row_key, staged

WINDOW = 13
NEAR_MISSES = 2
#: A document is contaminated when at least one word in so many is hit.
SHARE = 20
#: Words of a term; three of them that share no word fit in every window of WINDOW.
TERM = 3
MOST_BROADCAST = 500_000

_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word while A-Z are not yet lower-cased.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _exact(text):
    """Words with A-Z lower-cased; an empty first word means that the text began with a separator."""
    return F.split(F.translate(text, _UPPER, _LOWER), _SEPARATOR)


def _folded(text):
    """As many words, at the same places, with all case folded."""
    return F.split(F.lower(text), _SEPARATOR)


def _limited(df: DataFrame, size: str = "1") -> DataFrame:
    return limited(df, MOST_BROADCAST, size)


def _items(benchmark: DataFrame, item_col: str, text_col: str, window_misses: int) -> DataFrame:
    """item (a row key), item_id, words, n, len (words of a window), misses (words of a window that may differ)."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("item_id is not null").distinct()
    items = items.select(row_key("item_id", "text").alias("item"), "item_id", F.filter(_exact(F.col("text")), lambda w: w != "").alias("words")).where("size(words) > 0")
    length = F.least(F.size("words"), F.lit(WINDOW))
    return items.select("item", "item_id", "words", F.size("words").alias("n"), length.alias("len"), F.greatest(F.lit(0), F.least(F.lit(window_misses), length - 2)).alias("misses"))


def _term(words: str, at: str, size: int) -> str:
    """SQL of the code of ``size`` words from ``at`` on; past the end there are fewer."""
    return f"xxhash64({', '.join(f'get({words}, {at} + {i})' for i in range(size))})"


def _terms(items: DataFrame) -> DataFrame:
    """item, size (words), at, term: all that a window may be looked up by."""
    w = "transform(words, x -> lower(x))"
    long = f"transform(sequence(0, n - {TERM}), at -> named_struct('size', {TERM}, 'at', at, 'term', {_term('w', 'at', TERM)}))"
    # A short window: misses + 1 stretches, each begins with a term of TERM words or as many as it has.
    begin, end = "cast((i * n) div (misses + 1) as int)", "cast(((i + 1) * n) div (misses + 1) as int)"
    sizes = " ".join(f"when {end} - {begin} = {s} then {_term('w', begin, s)}" for s in range(1, TERM))
    short = f"""transform(sequence(0, misses), i -> named_struct('size', least({TERM}, {end} - {begin}), 'at', {begin},
        'term', case {sizes} else {_term('w', begin, TERM)} end))"""
    return items.select("item", F.explode(F.expr(f"transform(array({w}), w -> if(len < {WINDOW}, {short}, {long}))[0]")).alias("t")).select("item", "t.*")


def _lookups(items: DataFrame, terms: DataFrame, frequency: DataFrame) -> DataFrame:
    """term, item, at: of every window the rarest terms, misses + 1 without a common word; all terms of a short one."""
    counted = terms.join(frequency, "term", "left").select("item", F.struct(F.coalesce("f", F.lit(0).cast("long")).alias("f"), "at", "term").alias("t"))
    listed = counted.groupBy("item").agg(F.sort_array(F.collect_list(F.struct(F.col("t.at").alias("o"), "t"))).alias("l")).join(items.select("item", "n", "len", "misses"), "item")
    none = "cast(array() as array<struct<f: bigint, at: int, term: bigint>>)"
    apart = f"if(size(a) <= misses and forall(a, y -> abs(y.at - x.at) >= {TERM}), concat(a, array(x)), a)"
    rarest = f"transform(sequence(0, n - len), s -> aggregate(sort_array(slice(ts, s + 1, len - {TERM - 1})), {none}, (a, x) -> {apart}))"
    of_item = f"transform(array(transform(l, x -> x.t)), ts -> if(len < {WINDOW}, ts, flatten({rarest})))[0]"
    return listed.select("item", F.explode(F.expr(f"array_distinct({of_item})")).alias("t")).select("t.term", "item", F.col("t.at").alias("at"))


def postings(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """term, k, place of the wanted terms (term, size) in ``texts`` (k, text)."""
    wanted = terms.select("term", "size").distinct()
    sizes = sorted(r[0] for r in wanted.select("size").distinct().collect())  # TERM of them at most
    words = texts.select("k", _folded(F.col("text")).alias("w"))
    found = None
    for size in sizes:
        own = words.select("k", F.posexplode(F.expr(f"transform(w, (x, i) -> {_term('w', 'i', size)})")).alias("place", "term"))
        own = own.join(_limited(wanted.where(F.col("size") == size).select("term")), "term").select("term", "k", "place")
        found = own if found is None else found.union(own)
    return texts.sparkSession.createDataFrame([], "term long, k binary, place int") if found is None else found


def matches(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", window_misses: int = NEAR_MISSES) -> DataFrame:
    """Phrase and proximity matches: k (row key of the document), item_id, first, last (word places, inclusive), exact."""
    if window_misses * (2 * TERM - 1) > WINDOW - TERM:  # so many starts does a chosen term take from the next
        raise ValueError(f"a window of {WINDOW} words has too few terms of {TERM} for {window_misses} differing words")
    texts = docs.select(row_key(id_col, text_col).alias("k"), F.col(text_col).alias("text")).where("text is not null")
    items = staged(_items(benchmark, item_col, item_text, window_misses), "items")
    terms = staged(_terms(items), "terms")
    index = staged(postings(texts, terms).distinct(), "postings")  # rows repeated in the corpus have the same ones
    frequency = index.groupBy("term").agg(F.count("*").alias("f"))
    lookups = staged(_lookups(items, terms, frequency), "lookups")

    found = index.join(_limited(lookups), "term").select("k", "item", (F.col("place") - F.col("at")).alias("begin")).join(_limited(items.select("item", "n")), "item")
    per_doc = staged(found.groupBy("k").agg(F.collect_set(F.struct("item", "begin", "n")).alias("places")), "places")

    rows = texts.join(_limited(per_doc, "size(places)"), "k").dropDuplicates(["k"]).select("k", _exact(F.col("text")).alias("w"), "places")
    # Of each place the words that stand there; an item that begins before the text has its first words cut.
    there = "transform(places, p -> named_struct('item', p.item, 'begin', p.begin, 's', slice(w, greatest(p.begin, 0) + 1, p.n + least(p.begin, 0))))"
    rows = rows.select("k", F.explode(F.expr(f"transform(array(w), w -> {there})[0]")).alias("r")).select("k", "r.*").join(_limited(items, "n"), "item")
    # Places at which the item and the text differ, with the item's ends; between two of them words are equal.
    differ = "filter(sequence(-1, n), j -> j < 0 or j = n or not (get(s, j + least(begin, 0)) <=> words[j]))"
    rows = rows.select("k", "item_id", "begin", "len", F.expr(differ).alias("d"), "misses")
    spans = """concat(
        transform(filter(sequence(0, size(d) - 2), i -> d[i + 1] - d[i] > len), i -> named_struct('first', begin + d[i] + 1, 'last', begin + d[i + 1] - 1, 'exact', true)),
        transform(filter(sequence(0, size(d) - 2), i -> d[least(i + misses + 1, size(d) - 1)] - d[i] > len and d[i + 1] - d[i] <= len), i ->
            named_struct('first', begin + d[i] + 1, 'last', begin + d[least(i + misses + 1, size(d) - 1)] - 1, 'exact', false)))"""
    return rows.select("k", "item_id", F.explode(F.expr(spans)).alias("s")).select("k", "item_id", "s.*").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", share: int = SHARE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items with proximity matches only)."""
    found = staged(matches(docs, benchmark, id_col, text_col, item_col, item_text), "matches")
    hits = found.where("exact").select("k", F.explode(F.sequence("first", "last")).alias("place")).distinct().groupBy("k").agg(F.count("*").alias("n_hit"))
    per_item = found.groupBy("k", "item_id").agg(F.max("exact").alias("exact"))
    listed = per_item.groupBy("k").agg(F.collect_set(F.when(F.col("exact"), F.col("item_id"))).alias("ids"), F.count(F.when(~F.col("exact"), 1)).alias("n_near"))
    result = hits.join(listed, "k", "full").select(F.col("k").alias("hit_k"), "n_hit", "ids", "n_near")
    base = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("k"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(_WORD)).cast("long").alias("n_words"))
    n_hit, ids = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("ids", F.array().cast("array<string>"))
    return base.join(result, base["k"] == result["hit_k"], "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(ids), ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )


def keep(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    verdicts = decontaminate(docs.select(F.struct("doc_id", row_key("doc_id", "text").alias("k")).alias("doc_id"), "text"), benchmark)
    bad = staged(verdicts.where("contaminated").select(F.col("doc_id.doc_id").alias("bad_id"), F.col("doc_id.k").alias("bad_k")).distinct(), "contaminated")
    gone = _limited(bad)
    same = docs["doc_id"].eqNullSafe(gone["bad_id"]) & (row_key(docs["doc_id"], docs["text"]) == gone["bad_k"])
    return docs.join(gone, same, "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS_SQL = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE_SQL = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS_SQL} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, l, array_to_string(ws[p:p + l - 1], ' ') AS g FROM (
  SELECT item_id, ws, least(len(ws), {WINDOW}) AS l, unnest(range(1, len(ws) - least(len(ws), {WINDOW}) + 2)) AS p FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, {_WORDS_SQL} AS ws FROM documents),
lens AS (SELECT DISTINCT l FROM win),
dw AS (SELECT doc_id, l, p, array_to_string(ws[p:p + l - 1], ' ') AS g FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS p FROM d, lens WHERE len(ws) >= l)),
m AS (SELECT doc_id, item_id, p, dw.l FROM dw JOIN win ON dw.l = win.l AND dw.g = win.g),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS ids FROM m GROUP BY doc_id),
-- Proximity: {NEAR_MISSES} differing words of a window leave a run of l // (misses + 1) equal ones; where item and text share such a run, all windows are counted.
s AS (SELECT item_id, ws, len(ws) AS n, least(len(ws), {WINDOW}) AS l, greatest(0, least({NEAR_MISSES}, least(len(ws), {WINDOW}) - 2)) AS miss FROM b WHERE len(ws) > 0),
sr AS (SELECT *, l // (miss + 1) AS r FROM s),
ig AS (SELECT item_id, r, p, array_to_string(ws[p:p + r - 1], ' ') AS g FROM (SELECT item_id, ws, r, unnest(range(1, n - r + 2)) AS p FROM sr)),
dg AS (SELECT doc_id, r, p, array_to_string(ws[p:p + r - 1], ' ') AS g FROM (SELECT doc_id, ws, r, unnest(range(1, len(ws) - r + 2)) AS p FROM d, (SELECT DISTINCT r FROM sr) WHERE len(ws) >= r)),
al AS (SELECT DISTINCT doc_id, item_id, dg.p - ig.p AS o FROM dg JOIN ig ON dg.r = ig.r AND dg.g = ig.g),
ne AS (SELECT doc_id, item_id, o, l, miss, j, CASE WHEN o + j BETWEEN 1 AND len(dws) AND dws[o + j] = iws[j] THEN 0 ELSE 1 END AS off FROM (
  SELECT al.doc_id, al.item_id, o, l, miss, d.ws AS dws, sr.ws AS iws, unnest(range(1, n + 1)) AS j FROM al JOIN d USING (doc_id) JOIN sr USING (item_id))),
cu AS (SELECT doc_id, item_id, o, l, miss, j, sum(off) OVER (PARTITION BY doc_id, item_id, o ORDER BY j) AS c FROM ne),
wn AS (SELECT doc_id, item_id, miss, c - coalesce(lag(c, l) OVER (PARTITION BY doc_id, item_id, o, l ORDER BY j), 0) AS off, j, l FROM cu),
nr AS (SELECT doc_id, count(*) AS n_near FROM (SELECT doc_id, item_id, miss, min(off) AS best FROM wn WHERE j >= l GROUP BY ALL) WHERE best BETWEEN 1 AND miss GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(ws) AS contaminated,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN nr USING (doc_id)
"""
