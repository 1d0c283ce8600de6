"""Joins of the index: name candidates, resolution, intervals, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codegrain.operators.ordering import last_before
from codegrain.sources.staging import staged

# What a call's and an include's candidates amount to.
CALL_RESOLUTIONS = (
    "INDIRECT_OR_DYNAMIC",
    "MACRO_OR_FUNCTION_AMBIGUOUS",
    "MEMBER_OR_QUALIFIED",
    "UNIQUE_FILE_LOCAL_CANDIDATE",
    "AMBIGUOUS",
    "UNIQUE_REPOSITORY_CANDIDATE",
    "UNRESOLVED_EXTERNAL",
)
INCLUDE_RESOLUTIONS = ("UNRESOLVED_WITHOUT_BUILD_CONFIG", "UNIQUE_PATH_CANDIDATE", "AMBIGUOUS_PATH_CANDIDATES")
#: Candidates that a call or include carries itself; all of them are in the pools' tables.
FIRST = 3


def pools(symbols: DataFrame) -> DataFrame:
    """The candidates of every name: via ('name' or 'qualified'), pool, use, symbol_id, path, start_byte, linkage.

    ``symbols``: symbol_id, name, qualified_name, symbol_kind, role, linkage, path,
    start_byte. A use is DEFINITION or DECLARATION of a function, or MACRO; other
    symbols are no candidates. One row for each symbol and name: calls refer to
    their pool, so that a name that many symbols and many calls share never
    becomes their product.
    """
    use = F.when((F.col("symbol_kind") == "FUNCTION") & F.col("role").isin("DEFINITION", "DECLARATION"), F.col("role")).when((F.col("symbol_kind") == "MACRO") & (F.col("role") == "DEFINITION"), "MACRO")
    named = F.array(*[F.struct(F.lit(via).alias("via"), F.col(c).alias("pool")) for via, c in (("name", "name"), ("qualified", "qualified_name"))])
    return symbols.select(F.explode(named).alias("n"), use.alias("use"), "symbol_id", "path", "start_byte", "linkage").where("use is not null").select("n.*", "use", "symbol_id", "path", "start_byte", "linkage")


def _firsts(rows: DataFrame, key: list[str], order: list[str], value: str, n: int = FIRST) -> DataFrame:
    """The first ``n`` values of each key as an array; a key's other rows are dropped before they move."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    listed = F.array_sort(F.collect_list(F.struct("_n", value)))
    return rows.withColumn("_n", rank).where(F.col("_n") <= n).groupBy(*key).agg(F.transform(listed, lambda x: x[value]).alias("first"))


def _pool_counts(rows: DataFrame) -> DataFrame:
    """By via and pool: how many symbols of each use, and the first definitions by place."""
    count = lambda use: F.sum((F.col("use") == use).cast("long"))
    n = rows.groupBy("via", "pool").agg(F.count("*").alias("n_all"), count("DEFINITION").alias("n_def"), count("DECLARATION").alias("n_decl"), count("MACRO").alias("n_macro"))
    firsts = _firsts(rows.where("use = 'DEFINITION'"), ["via", "pool"], ["path", "start_byte", "symbol_id"], "symbol_id")
    return n.join(firsts, ["via", "pool"], "left")


def ladder(kind: Column, name: Column, n_def: Column, n_decl: Column, n_macro: Column, n_local: Column) -> Column:
    """The resolution of a call; the first rule that holds decides."""
    return (
        F.when((kind == "INDIRECT") | name.isNull(), "INDIRECT_OR_DYNAMIC")
        .when((n_macro > 0) & (n_def + n_decl > 0), "MACRO_OR_FUNCTION_AMBIGUOUS")
        .when(kind.isin("MEMBER", "QUALIFIED"), "MEMBER_OR_QUALIFIED")
        .when(n_local == 1, "UNIQUE_FILE_LOCAL_CANDIDATE")
        .when(n_local > 1, "AMBIGUOUS")
        .when(n_def == 1, "UNIQUE_REPOSITORY_CANDIDATE")
        .when(n_def > 1, "AMBIGUOUS")
        .otherwise("UNRESOLVED_EXTERNAL")
    )


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """``calls`` (kind, callee_name, callee_expression, path) with their candidates and resolution.

    Candidates are the functions whose qualified name is the callee's expression,
    or, when no symbol has it, those of the callee's name; macros always by name.
    Adds resolution, via and pool (where pools() lists the candidates; null for
    none), local_symbol_id (the only candidate, where the file's own one decides),
    n_candidates, n_declarations, and first_candidates, by place.
    """
    rows = pools(symbols)
    counts = _pool_counts(rows)
    # Whether any symbol at all has a qualified name decides between the pools.
    known = symbols.select(F.col("qualified_name").alias("known")).distinct()
    own = rows.where("use = 'DEFINITION' and linkage = 'INTERNAL'").groupBy("via", "pool", "path").agg(F.count("*").alias("n_local"), F.min("symbol_id").alias("local_id"))
    # Calls without a name match nothing; they are dealt out instead of meeting in one task.
    nothing = lambda c: F.coalesce(c, F.concat(F.lit("\0"), F.pmod(F.xxhash64(*calls.columns), F.lit(4096)).cast("string")))
    out = calls.join(known, nothing(F.col("callee_expression")) == F.col("known"), "left")
    via = F.when(F.col("known").isNotNull(), "qualified").when(F.col("callee_name").isNotNull(), "name")
    out = out.withColumn("_via", via).withColumn("_pool", F.when(F.col("_via") == "qualified", F.col("callee_expression")).otherwise(F.col("callee_name")))
    c = counts.select(F.col("via").alias("c_via"), F.col("pool").alias("c_pool"), "n_def", "n_decl", "first")
    out = out.join(c, (F.coalesce("_via", F.lit("")) == F.col("c_via")) & (nothing(F.col("_pool")) == F.col("c_pool")), "left")
    m = counts.where("via = 'name' and n_macro > 0").select(F.col("pool").alias("m_pool"), "n_macro")
    out = out.join(m, nothing(F.col("callee_name")) == F.col("m_pool"), "left")
    o = own.select(F.col("via").alias("o_via"), F.col("pool").alias("o_pool"), F.col("path").alias("o_path"), "n_local", "local_id")
    out = out.join(o, (F.coalesce("_via", F.lit("")) == F.col("o_via")) & (nothing(F.col("_pool")) == F.col("o_pool")) & (F.col("path") == F.col("o_path")), "left")
    n = lambda col: F.coalesce(col, F.lit(0).cast("long"))
    resolution = ladder(F.col("kind"), F.col("callee_name"), n("n_def"), n("n_decl"), n("n_macro"), n("n_local"))
    local = F.when(resolution == "UNIQUE_FILE_LOCAL_CANDIDATE", F.col("local_id"))
    found = n("n_def") + n("n_decl") > 0
    none = F.array().cast(f"array<{symbols.schema['symbol_id'].dataType.simpleString()}>")
    return out.select(
        *[F.col(c) for c in calls.columns],
        resolution.alias("resolution"),
        F.when(found, F.col("_via")).alias("via"),
        F.when(found, F.col("_pool")).alias("pool"),
        local.alias("local_symbol_id"),
        F.when(local.isNotNull(), F.lit(1).cast("long")).otherwise(n("n_def")).alias("n_candidates"),
        n("n_decl").alias("n_declarations"),
        F.when(local.isNotNull(), F.array(local)).otherwise(F.coalesce("first", none)).alias("first_candidates"),
    )


def call_candidates(resolved: DataFrame, symbols: DataFrame, use: str = "DEFINITION") -> DataFrame:
    """A row for each call of resolve_calls() and candidate: the calls' columns and symbol_id. As large as the product of calls and candidates."""
    pool = pools(symbols).where(F.col("use") == use).select(F.col("via").alias("p_via"), F.col("pool").alias("p_pool"), "symbol_id")
    same = (F.col("via") == F.col("p_via")) & (F.col("pool") == F.col("p_pool"))
    if use == "DEFINITION":
        same &= F.col("local_symbol_id").isNull() | (F.col("local_symbol_id") == F.col("symbol_id"))
    return resolved.join(pool, same).drop("p_via", "p_pool")


def resolve_links(links: DataFrame, paths: DataFrame) -> DataFrame:
    """``links`` (path, target) with n_candidates, first_paths (the first in order), base (where link_paths() looks) and resolution.

    Candidates: the target beside the including file, the target from the root,
    and every path of the same base name; none for absolute targets or ``..``.
    The first two have that base name themselves. A base name that many paths
    share is joined as its count and first paths.
    """
    files = paths.select(F.col("path").alias("file")).distinct().withColumn("b_name", F.regexp_extract("file", r"([^/]*)$", 1))
    by_base = files.groupBy("b_name").agg(F.count("*").alias("b_n")).join(_firsts(files, ["b_name"], ["file"], "file"), "b_name")
    parts = F.filter(F.split("target", "/"), lambda x: ~x.isin("", "."))
    safe = ~F.col("target").startswith("/") & ~F.array_contains(parts, "..") & (F.size(parts) > 0)
    out = links.withColumn("base", F.when(safe, F.element_at(parts, -1)))
    nothing = F.coalesce("base", F.concat(F.lit("\0"), F.pmod(F.xxhash64(*links.columns), F.lit(4096)).cast("string")))
    out = out.join(by_base, nothing == F.col("b_name"), "left")
    n = F.coalesce("b_n", F.lit(0).cast("long"))
    resolution = F.when(n == 0, INCLUDE_RESOLUTIONS[0]).when(n == 1, INCLUDE_RESOLUTIONS[1]).otherwise(INCLUDE_RESOLUTIONS[2])
    none = F.array().cast("array<string>")
    return out.select(*[F.col(c) for c in links.columns], n.alias("n_candidates"), F.coalesce("first", none).alias("first_paths"), F.when(n > 0, F.col("base")).alias("base"), resolution.alias("resolution"))


def link_paths(resolved: DataFrame, paths: DataFrame) -> DataFrame:
    """A row for each link of resolve_links() and candidate: the links' columns and file. As large as the product of links and paths of one base name."""
    files = paths.select(F.col("path").alias("file")).distinct().withColumn("b_name", F.regexp_extract("file", r"([^/]*)$", 1))
    return resolved.join(files, F.col("base") == F.col("b_name")).drop("b_name")


def outgoing(resolved: DataFrame, caller: str = "caller_symbol_id") -> DataFrame:
    """The calls of each caller, counted, with the distinct pools that they go to."""
    return resolved.groupBy(F.col(caller).alias("symbol_id")).agg(F.count("*").alias("n_calls"), F.countDistinct("via", "pool").alias("n_pools"))


def symbol(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """The symbols of the wanted ids."""
    return symbols.join(wanted.select("symbol_id").distinct(), "symbol_id")


def callees(resolved: DataFrame, batch: str, of_symbol: DataFrame) -> DataFrame:
    """The first candidates of a batch's calls that are outside it: ``batch``, symbol_id, resolution, each once.

    ``of_symbol``: symbol_id, home (the batch that a symbol is in).
    """
    each = resolved.select(batch, "resolution", F.explode("first_candidates").alias("symbol_id")).distinct()
    return each.join(of_symbol, "symbol_id").where(~F.col("home").eqNullSafe(F.col(batch))).select(batch, "symbol_id", "resolution")


def callers(wanted: DataFrame, resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """The calls that have a wanted symbol among their candidates: the wanted rows' columns and the calls'.

    Goes by the names of the wanted symbols: a call without a candidate of its
    own file has all of its pool.
    """
    pool = pools(symbols).where("use = 'DEFINITION'").select("via", "pool", "symbol_id")
    found = wanted.join(pool, "symbol_id")
    joined = found.join(resolved, ["via", "pool"])
    return joined.where(F.col("local_symbol_id").isNull() | (F.col("local_symbol_id") == F.col("symbol_id")))


def asof(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, size: str, stage=staged) -> DataFrame:
    """Each point with the span of its key that holds it; a point at the very end belongs to the last byte's span.

    For spans that don't overlap, as those of a partition: the last one that
    begins at or before the point, from one sorted pass over both. Spans are
    neither copied nor brought together, however many a key has.
    """
    p = points.withColumn("_held", F.when(F.col(at) == F.col(size), F.col(at) - 1).otherwise(F.col(at)))
    return last_before(p, spans, key, "_held", start, stage).where(F.col("_held") < F.col(end)).drop("_held")


#: Places of a smallest cell.
CELL = 4096


def _cover(start: Column, end: Column) -> Column:
    """The fewest dyadic cells, (level, cell) with cells of CELL * 2**level places, that a span lies in: two a level at most, none for null ends."""
    shift = lambda x, n: F.call_function("shiftright", x, n)
    a, b = F.floor(start / CELL), F.floor(F.greatest(start, end - 1) / CELL) + 1

    def cells(level):
        low, high = shift(a + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level), shift(b, level)
        some = low < high
        one = lambda when, cell: F.when(some & when, F.struct(level.alias("level"), cell.alias("cell")))
        return F.array(one(low.bitwiseAND(F.lit(1)) == 1, low), one(high.bitwiseAND(F.lit(1)) == 1, high - 1))

    # A cell of a level has to fit, so the span's length bounds the levels.
    levels = F.sequence(F.lit(0), F.ceil(F.log2((b - a).cast("double"))).cast("int"))
    return F.filter(F.flatten(F.transform(levels, cells)), lambda x: x.isNotNull())


def held(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Pairs of points and the spans of their key that hold them; spans may overlap.

    A span is put into the few dyadic cells that cover it, a point asks for the
    cells above it on the levels that have any (some 50 at most). The cells of a
    span don't overlap, so no pair is found twice.
    """
    s = spans.withColumnRenamed(key, "_key").withColumn("_cell", F.explode(_cover(F.col(start), F.col(end)))).withColumns({"_level": F.col("_cell.level"), "_cell": F.col("_cell.cell")})
    levels = sorted(r[0] for r in s.select("_level").distinct().collect())
    up = lambda n: F.struct(F.lit(n).alias("n"), F.call_function("shiftright", F.floor(F.col(at) / CELL), F.lit(n)).alias("c"))
    asked = F.explode(F.array(*map(up, levels))) if levels else F.lit(None).cast("struct<n:int,c:bigint>")
    p = points.withColumn("_up", asked)
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    return p.join(s, (p[key] == s["_key"]) & (F.col("_up.n") == F.col("_level")) & (F.col("_up.c") == F.col("_cell")) & inside).drop("_key", "_up", "_level", "_cell")


def overlaps(a: DataFrame, b: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Pairs of spans (a_start, a_end) and (b_start, b_end) of one key that share something; for how='left_semi' the rows of ``a`` that share something with any.

    Of two such spans one begins in the other, so the pairs are those of each
    one's starts and the other's spans.
    """
    touch = (F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start"))
    if how == "left_semi":
        spans = [key, "a_start", "a_end"]
        found = overlaps(a.select(*spans).distinct(), b.select(key, "b_start", "b_end").distinct(), key).select(*spans).distinct()
        return a.join(found, spans, "left_semi")
    columns = [F.col(c) for c in (*a.columns, *[c for c in b.columns if c != key])]
    later = held(a, b, key, "a_start", "b_start", "b_end").where(touch).select(columns)
    earlier = held(b, a, key, "b_start", "a_start", "a_end").where(touch & (F.col("a_start") < F.col("b_start"))).select(columns)
    return later.unionByName(earlier)


def suffixes(names: DataFrame, qualified: str = "qualified_name", name: str = "name") -> DataFrame:
    """A row for each ``::`` suffix of a qualified name and for the name itself, lower case: turns the search for endings into an equality."""
    parts = F.split(F.lower(qualified), "::")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))
    return names.withColumn("suffix", F.explode(F.array_distinct(F.concat(each, F.array(F.lower(name))))))


def search_exact(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """Symbols whose name or qualified name is wanted, each once for each wanted name."""
    both = symbols.select("symbol_id", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("wanted"))
    return both.join(wanted, "wanted").distinct()


def incoming(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """The reverse of calls: symbol_id, n_calls of each symbol that is a candidate of some call.

    Calls are counted by pool before they meet its symbols; callers() gives the
    calls themselves for symbols that are wanted.
    """
    per = resolved.where("via is not null").groupBy("via", "pool", "local_symbol_id").agg(F.count("*").alias("n"))
    own = per.where("local_symbol_id is not null").select(F.col("local_symbol_id").alias("symbol_id"), "n")
    pool = pools(symbols).where("use = 'DEFINITION'").select("via", "pool", "symbol_id")
    all_ = per.where("local_symbol_id is null").groupBy("via", "pool").agg(F.sum("n").alias("n")).join(pool, ["via", "pool"]).select("symbol_id", "n")
    return own.unionByName(all_).groupBy("symbol_id").agg(F.sum("n").alias("n_calls"))


def first_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def reconcile(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison: how many keys are missing, extra, different, equal."""
    x, y = a.select(F.col(key).alias("k"), F.col(value).alias("va"), F.lit(1).alias("ia")), b.select(F.col(key).alias("k"), F.col(value).alias("vb"), F.lit(1).alias("ib"))
    state = F.when(F.col("ib").isNull(), "missing").when(F.col("ia").isNull(), "extra").when(F.col("va").eqNullSafe(F.col("vb")), "equal").otherwise("different")
    return x.join(y, "k", "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


#: Buckets that rows are dealt to before tables are compared.
BUCKETS = 1 << 16


def bucket_digests(df: DataFrame, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """bucket, n, and two sums of 64-bit hashes of its rows, which don't depend on their order and count repeated rows as often as they stand."""
    one, two = F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)
    rows = df.select(F.pmod(one, F.lit(buckets)).alias("bucket"), one.cast("decimal(20,0)").alias("h"), two.cast("decimal(20,0)").alias("g"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("h").alias("h"), F.sum("g").alias("g"))


def equal_tables(a: DataFrame, b: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: how many rows only one of two builds has, repeated rows counted severally.

    Both are read to digests of their buckets, a small row for each; only rows
    of buckets that differ are compared as rows. Equal tables, of any size, move
    nothing but the digests.
    """
    columns = a.columns
    mine = bucket_digests(a, columns, buckets)
    other = bucket_digests(b.select(*columns), columns, buckets).toDF("b_bucket", "b_n", "b_h", "b_g")
    same = F.col("n").eqNullSafe(F.col("b_n")) & F.col("h").eqNullSafe(F.col("b_h")) & F.col("g").eqNullSafe(F.col("b_g"))
    unlike = mine.join(other, F.col("bucket") == F.col("b_bucket"), "full").where(~same).select(F.coalesce("bucket", "b_bucket").alias("_bucket"))
    unlike = F.broadcast(unlike)  # one number for each bucket at most
    rows = lambda df: df.withColumn("_b", F.pmod(F.xxhash64(*columns), F.lit(buckets))).join(unlike, F.col("_b") == F.col("_bucket"), "left_semi").drop("_b")
    # Rows are counted by side under one grouping, in place of two differences.
    both = rows(a).withColumn("_side", F.lit(1)).unionByName(rows(b.select(*columns)).withColumn("_side", F.lit(-1)))
    more = both.groupBy(*columns).agg(F.sum("_side").alias("_more"))
    return more.agg(F.coalesce(F.sum(F.greatest("_more", F.lit(0))), F.lit(0)).alias("only_first"), F.coalesce(F.sum(F.greatest(-F.col("_more"), F.lit(0))), F.lit(0)).alias("only_second"))
