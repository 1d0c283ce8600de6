"""Operator 9, near duplicates by HyperMinHash.

A document's set of 5-word shingles is hashed once. The hash's top bits choose
one of 128 buckets; a bucket keeps the leading-zero count and ten mantissa bits
of the smallest remainder seen, 16 bits in all. Empty buckets borrow from others
in an order fixed for each bucket, which keeps the chance that two documents
agree in a bucket at their Jaccard similarity. Registers make bands, which find
candidates: as wide ones as miss a pair at the threshold with a chance of 1e-6 at
most (at 0.85 five registers in 25 bands and 4e-7, at 0.8 four in 32 and 5e-8). For candidates the share of equal registers, corrected for registers that
agree by chance, estimates the similarity; what could still be a link is
verified on the full shingle sets.

Documents with the same set are one node, told from others by 128 bits of digest;
nodes of rows that share an id are linked. In a bucket of a band every member is
compared with the bucket's smallest and its most central node instead of with
everyone; after these links are joined to components, members outside the
component of their bucket's central node are compared with those members of other
components that an exact bound leaves, so no link is lost and a group of copies
never becomes all of its pairs.

Defined results: null or blank text has an empty set and is linked with nothing;
rows of one id are one document, whatever their texts: what one of them is linked
with, all are; keep() leaves one of equal rows of an id, and those with other
texts; rows without an id stay alone, with a null component, and are kept; a text
of any length is one set; an empty table gives an empty result; other columns of
the input are never looked at, and keep() hands them on whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.llm.common import SMALL_BATCH, documents, dropped, mapped, mix, pieces, row_key, staged, utf8, word_hashes
from codegrain.llm.components import components

WORDS = 5
PERCENT = 85
BUCKET_BITS, MANTISSA_BITS = 7, 10
BUCKETS = 1 << BUCKET_BITS
#: The chance that bands may miss a pair at the threshold.
MISSED = 1e-6
#: A candidate whose estimate is this far under the threshold is dropped: over five standard deviations for sets of SMALL and more.
MARGIN, SMALL = 0.25, 64
#: So many ids of candidates are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_ORDER = np.array([np.random.Generator(np.random.PCG64(b)).permutation(BUCKETS) for b in range(BUCKETS)]).T


def band_rows(percent: int) -> int:
    """Registers of a band for a threshold, 1 at least."""
    return max((r for r in range(1, BUCKETS + 1) if (1 - (percent / 100) ** r) ** (BUCKETS // r) <= MISSED), default=1)


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, one text after the other; and their bounds."""
    h, bounds = word_hashes(*utf8(column))
    rows = len(bounds) - 1
    length = np.diff(bounds)
    mult = np.resize(_MULT, words) ^ (np.arange(words, dtype=np.uint64) // np.uint64(5) << np.uint64(8))
    total = np.zeros(len(h), np.uint64)
    for j in range(words):
        total[: len(h) - j if j else None] += h[j:] * mult[j]
    row = np.repeat(np.arange(rows), length)
    whole = np.arange(len(h)) + words <= bounds[row + 1]
    few = np.flatnonzero((length > 0) & (length < words))
    for i in few:
        whole[bounds[i]] = True
        total[bounds[i]] = (h[bounds[i] : bounds[i + 1]] * mult[: length[i]]).sum(dtype=np.uint64) + np.uint64(length[i])
    hashes, row = mix(total[whole]), row[whole]
    at = np.searchsorted(row, np.arange(rows + 1))
    for i in np.flatnonzero(np.diff(at) > 1):
        hashes[at[i] : at[i + 1]].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.searchsorted(row[new], np.arange(rows + 1))


def registers(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of sorted sets, a row of 16-bit values each; sets must not be empty."""
    rows = len(bounds) - 1
    rest = np.uint64(64 - BUCKET_BITS)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    cell = row * BUCKETS + (hashes >> rest).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    value = hashes[first] & ((np.uint64(1) << rest) - np.uint64(1))
    zeros = (int(rest) - np.frexp(value.astype(np.float64))[1]).clip(0, int(rest)).astype(np.uint64)
    mantissa = ((value << zeros) >> (rest - np.uint64(1 + MANTISSA_BITS))) & np.uint64((1 << MANTISSA_BITS) - 1)
    out = np.full(rows * BUCKETS, -1, np.int32)
    out[cell[first]] = (zeros << np.uint64(MANTISSA_BITS) | mantissa).astype(np.int32)
    filled = out.reshape(rows, BUCKETS).copy()
    gaps = np.flatnonzero(out < 0)
    for order in _ORDER:
        if not len(gaps):
            break
        got = out[gaps // BUCKETS * BUCKETS + order[gaps % BUCKETS]]
        filled.reshape(-1)[gaps] = got
        gaps = gaps[got < 0]
    return filled.astype(np.uint16)


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    bands = BUCKETS // rows
    mult = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    used = regs[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64) + np.uint64(1)
    total = (used * mult).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(total).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers: the share that agrees, less what agrees by chance.

    Two different remainders get one register with a chance of a third (equal
    zero counts, as each is half as likely as the one before) times 2**-mantissa.
    """
    chance = 2.0**-MANTISSA_BITS / 3
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


_SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, regs binary"


def _digests(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two sums over each set of its mixed hashes; 0 for an empty one."""
    full = np.flatnonzero(np.diff(bounds))
    sums = [np.zeros(len(bounds) - 1, np.uint64), np.zeros(len(bounds) - 1, np.uint64)]
    if len(full):
        sums[0][full] = np.add.reduceat(mix(hashes), bounds[:-1][full])
        sums[1][full] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), bounds[:-1][full])
    return [x.view(np.int64) for x in sums]


def _sign(batches, rows: int):
    bands_of = BUCKETS // rows
    for batch in pieces(batches, "text"):
        hashes, bounds = shingle_sets(batch.column("text"))
        n = np.diff(bounds)
        full = np.flatnonzero(n)
        sums = _digests(hashes, bounds)
        keys, regs = np.zeros((len(n), bands_of), np.int64), [b""] * len(n)
        if len(full):
            starts = bounds[:-1][full]
            r = registers(hashes, np.append(starts, bounds[-1]))
            keys[full] = band_keys(r, rows)
            for i, one in zip(full, r):
                regs[i] = one.tobytes()
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands_of), pa.array(keys.reshape(-1)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), bands, pa.array(regs, pa.binary())],
            ["doc_id", "n_shingles", "d1", "d2", "bands", "regs"],
        )


def _sets(batches):
    """node, shingles of the rows (node, d1, d2, text) whose set has the digests."""
    for batch in pieces(batches, "text"):
        hashes, bounds = shingle_sets(batch.column("text"))
        own = np.logical_and(*(d == batch.column(c).to_numpy() for d, c in zip(_digests(hashes, bounds), ("d1", "d2"))))
        sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("node"), sets], ["node", "shingles"]).filter(pa.array(own))


def _likely(batches, percent: int):
    """Pairs that the registers don't rule out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
        least = np.minimum(batch.column("na").to_numpy(), batch.column("nb").to_numpy())
        keep = (estimate(a, b) >= percent / 100 - MARGIN) | (least < SMALL)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _sets_of(ids: DataFrame, nodes: DataFrame, texts: DataFrame, repeated: bool) -> DataFrame:
    """node, shingles of a staged table of nodes; ``repeated``: whether ids occur more than once in ``texts``."""
    ids = ids.join(nodes.select("node", "doc", "d1", "d2"), "node")
    found = texts.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, texts["doc_id"] == ids["doc"])
    sets = mapped(found.select("node", "d1", "d2", "text"), _sets, "node long, shingles array<long>", SMALL_BATCH)
    return sets.dropDuplicates(["node"]) if repeated else sets


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int, repeated: bool) -> DataFrame:
    """The links among ``pairs`` (a, b): by size and registers first, then by the full sets."""
    a = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("regs").alias("ra"))
    b = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("regs").alias("rb"))
    sized = pairs.join(a, "a").join(b, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    likely = staged(mapped(sized.select("a", "b", "na", "nb", "ra", "rb"), lambda x: _likely(x, percent), "a long, b long", SMALL_BATCH), "likely")
    ids = staged(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct(), "ids")
    sets = staged(_sets_of(ids, nodes, texts, repeated), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = likely.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("s"))
    return both.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b")


def _beyond_hubs(near: DataFrame, found: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int, repeated: bool) -> DataFrame:
    """Pairs (a, b) that may be links between components, among members of buckets whose central node doesn't reach all.

    Shingles are ordered by how many such members have them, rarest first. Two
    sets that agree on enough share one among their first ones, and what stands
    before the first that they share bounds how much they can share at all. Both
    bounds are exact; they leave few pairs of members far from the centre, whose
    rare shingles are their own. Of those with a shingle only members outside the
    component that most of them are in are paired with the others.
    """
    of_mid = found.select(F.col("node").alias("mid"), F.col("component").alias("mid_c"))
    many = near.where("n > 2").join(found, "node", "left").join(of_mid, "mid", "left")
    many = many.select("key", "node", F.coalesce("component", "node").alias("c"), F.coalesce("mid_c", "mid").alias("mid_c"))
    mixed = many.where("c <> mid_c").select("key").distinct()
    ids = staged(many.join(mixed, "key", "left_semi").select("node", "c").distinct(), "mixed")
    shingles = _sets_of(ids.select("node"), nodes, texts, repeated).select("node", F.explode("shingles").alias("s"))
    shingles = staged(shingles, "mixed-shingles")
    shared = shingles.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    first = shingles.join(shared, "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("l"))
    first = first.join(nodes.select("node", F.col("n_shingles").alias("n")), "node").join(ids, "node")
    own = F.col("n") - F.size("l")  # they come first and can't be shared
    length = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1 - own
    first = first.where(length > 0).select("node", "n", "c", own.alias("own"), F.posexplode(F.slice("l", F.lit(1), length.cast("int"))).alias("i", "x"))
    first = staged(first.select("node", "c", F.col("x.s").alias("s"), "n", (F.col("own") + F.col("i")).alias("i")), "prefixes")
    most = first.groupBy("s", "c").agg(F.count("*").alias("k")).groupBy("s").agg(F.max_by("c", F.struct("k", "c")).alias("most"), F.count("*").alias("cs")).where("cs > 1")
    both = staged(first.join(staged(most, "most"), "s"), "prefix-pairs")  # staged, so that a shingle of many is split among tasks below
    mine = both.where("c <> most").select("s", F.col("node").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), F.col("i").alias("ix"))
    rest = both.select(F.col("s").alias("t"), F.col("node").alias("y"), F.col("c").alias("cy"), F.col("n").alias("ny"), F.col("i").alias("iy"), (F.col("c") == F.col("most")).alias("inside"))
    m = F.expr("least(nx - ix, ny - iy)")
    may = F.expr("s = t and cx <> cy and (inside or x < y)") & (100 * m >= percent * (F.col("nx") + F.col("ny") - m))
    return mine.join(rest, may).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_dup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id (long), kept (boolean); linked from ``percent`` of similarity on."""
    rows = band_rows(percent)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = staged(mapped(texts, lambda x: _sign(x, rows), _SIGNED, SMALL_BATCH), "signed")
    solid = signed.where("n_shingles > 0 and doc_id is not null")
    named = solid.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc")).withColumn("node", F.monotonically_increasing_id())
    named = staged(named, "named")
    # How often ids occur at most, and whether one has several sets.
    digest = F.struct("d1", "d2")
    per_id = staged(solid.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(digest).alias("low"), F.max(digest).alias("high")).where("n > 1"), "repeated-ids")
    repeated, several = not per_id.isEmpty(), not per_id.where("low <> high").isEmpty()
    s = signed.select(F.col("doc_id").alias("doc"), "d1", "d2", "n_shingles", "bands", "regs")
    nodes = s.join(named, ["doc", "d1", "d2"])
    nodes = staged(nodes.dropDuplicates(["node"]) if repeated else nodes, "nodes")
    members = nodes.select("node", F.explode("bands").alias("key"))
    # Small tables are staged before they are joined, so that a bucket of a third of all nodes is split among tasks.
    sizes = staged(members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low")).where("n > 1"), "sizes")
    near = staged(members.join(sizes, "key"), "members")
    # The node that shares most buckets with most others is the most central one.
    central = staged(near.groupBy("node").agg(F.sum("n").alias("weight")), "central")
    middle = staged(near.join(central, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("mid")), "middle")
    near = staged(near.join(middle, "key"), "near")
    dropped(sizes, central, middle)
    pairs = near.select(F.col("low").alias("a"), F.col("node").alias("b")).union(near.select(F.least("node", "mid").alias("a"), F.greatest("node", "mid").alias("b")))
    links = _verified(pairs.where("a < b").distinct(), nodes, texts, percent, repeated)
    if several:
        of_id = solid.join(per_id.where("low <> high").select("doc_id"), "doc_id").select("doc_id", "d1", "d2").distinct().join(named.select("d1", "d2", "node"), ["d1", "d2"])
        first = of_id.groupBy("doc_id").agg(F.min("node").alias("a"))
        links = links.union(of_id.join(first, "doc_id").where("a < node").select("a", F.col("node").alias("b")))
    links = staged(links, "verified")
    found = components(links)
    more = staged(_beyond_hubs(near, found, nodes, texts, percent, repeated), "more")
    if not more.isEmpty():
        found = components(links.union(_verified(more, nodes, texts, percent, repeated)))

    # A component is named by its smallest id.
    of_node = found.union(found.select(F.col("component").alias("node"), "component").distinct())
    smallest = of_node.join(named.select("node", "doc"), "node").groupBy("component").agg(F.min("doc").alias("least"))
    of_node = of_node.join(smallest, "component").select("node", "least")
    named = named.join(of_node, "node", "left").select("d1", "d2", F.coalesce("least", "doc").alias("component"))
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), own)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that another one stands for; of equal rows with one id, one stays."""
    gone = staged(near_dup(docs, percent=percent).where("not kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    ids = F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), row_key("doc_id", "text").alias("k"))
    left = rows.join(ids, rows["id"] == ids["gone"], "left_anti")
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        left = left.where("id is not null").dropDuplicates(["k"]).unionByName(left.where("id is null"))
    return left.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup(documents(spark, sf_dir))


ORACLE_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + {WORDS - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WORDS - 2}, 2))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {PERCENT} * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(s, d) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.s, e.b FROM r JOIN e ON e.a = r.d),
c AS (SELECT s AS doc_id, min(d) AS component_id FROM r GROUP BY s)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
