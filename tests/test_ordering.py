"""Global order over many ranges, as-of and interval joins, next-fit as composed passages: against plain walks."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codegrain.operators import chunks as ch
from codegrain.operators import ordering, relations, rollup, scoring
from codegrain.sources.staging import staged


@pytest.fixture
def many(spark):
    """Many ranges, merged at run time or not."""
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}

    def put(partitions, merged=False):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)

    yield put
    for c, v in kept.items():
        spark.conf.set(c, v)


@pytest.mark.parametrize("partitions, wide", [(400, False), (40, True)])
def test_places_of_two_million_rows(spark, many, partitions, wide):
    many(partitions, True)
    n = 2_000_000
    df = spark.range(n).select(F.xxhash64("id").alias("a"), F.col("id"))
    if wide:
        df = df.where("id < 300000").withColumn("payload", F.repeat(F.sha2(F.col("id").cast("string"), 256), 3))
        n = 300_000
    placed = staged(ordering.source_order(df, "a", "id"), "placed")
    assert placed.count() == n
    # Places are 0 to n - 1, each once, and follow the order: as many rows, as many places, and no step down between neighbours.
    one = placed.agg(F.min("ordinal"), F.max("ordinal"), F.countDistinct("ordinal"), F.countDistinct("id")).first()
    assert tuple(one) == (0, n - 1, n, n)
    got = placed.select("ordinal", "a").toPandas()
    want = np.sort(df.select("a").toPandas()["a"].to_numpy())
    assert (got.sort_values("ordinal")["a"].to_numpy() == want).all()


def test_places_in_a_long_run_of_one_key(spark, many):
    many(40)
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 1000)).alias("k"), F.col("id"), F.create_map(F.lit("x"), F.col("id")).alias("m"))
    staging = []
    rows = ordering.source_order(df, "k", stage=lambda d, name: staging.append(staged(d, name)) or staging[-1]).toPandas()
    assert sorted(rows["ordinal"]) == list(range(60_000))
    assert (rows.sort_values("ordinal")["k"].to_numpy() == np.sort(rows["k"].to_numpy().astype(str))).all()
    hot = staging[0].where("k = 'hot'").groupBy("_p").count().collect()
    assert len(hot) > 5 and max(r["count"] for r in hot) < 10_000
    odd = spark.createDataFrame([("é",), ("z",), (None,), ("é",), ("a",)], "k string")
    assert [r.k for r in ordering.source_order(odd, "k").orderBy("ordinal").collect()] == [None, "a", "z", "é", "é"]
    assert ordering.source_order(odd.limit(0), "k").count() == 0


def test_one_score_for_all_rows(spark, many):
    many(40)
    df = spark.range(50_000).select(F.col("id"), F.when(F.col("id") % 100 == 0, 9).otherwise(3).alias("priority_score"))
    rows = scoring.ranked(df, "id").collect()
    want = sorted(range(50_000), key=lambda i: (-(9 if i % 100 == 0 else 3), i))
    assert [r.id for r in sorted(rows, key=lambda r: r.priority_rank)] == want and min(r.priority_rank for r in rows) == 1


def test_last_mark_before_each_row(spark, many):
    rng = random.Random(4)
    rows = [(i, rng.choice("abc") if i % 50 else None, rng.randrange(2000) if i % 70 else None) for i in range(3000)]
    marks = [(k, at, f"{k}{at}") for k in "abd" for at in rng.sample(range(100, 2000, 3), 40)]
    for partitions in (1, 60):
        many(partitions)
        got = ordering.last_before(spark.createDataFrame(rows, "i long, k string, at long"), spark.createDataFrame(marks, "k string, m long, name string"), "k", "at", "m").collect()
        assert sorted(r.i for r in got) == list(range(3000))
        for r in got:
            own = [m for k, m, _ in marks if k == r.k and r["at"] is not None and m <= r["at"]]
            assert (r.m, r.name) == ((max(own), f"{r.k}{max(own)}") if own else (None, None))


def test_asof_over_a_file_of_many_spans(spark, many):
    many(60)
    spans = spark.range(200_000).select(F.lit("f").alias("path"), (F.col("id") * 7).alias("s"), (F.col("id") * 7 + 7).alias("e"), F.col("id").alias("nth"))
    points = spark.range(0, 1_400_001, 13).select(F.lit("f").alias("path"), F.col("id").alias("p"), F.lit(1_400_000).alias("size"))
    got = relations.asof(points.unionByName(spark.createDataFrame([("f", 1_400_000, 1_400_000)], "path string, p long, size long")), spans, "path", "p", "s", "e", "size")
    off = got.where(F.col("nth") != F.floor(F.least("p", F.lit(1_399_999)) / 7)).count()
    assert off == 0 and got.count() == 1_400_001 // 13 + 2


SPANS = [(k, s, s + n) for k in "ab" for s, n in [(0, 1), (0, 0), (5, 4096), (4095, 2), (4096, 4096), (0, 100_000), (70_000, 300), (1 << 20, 1 << 25), (50_000, 20_000), (50_000, 20_000), (99_999, 1)]]


def test_overlaps_of_spans_of_all_lengths(spark):
    rng = random.Random(2)
    more = [("a", s, s + rng.choice([1, 50, 5000, 300_000])) for s in (rng.randrange(400_000) for _ in range(80))]
    a, b = SPANS + more[:40], SPANS + more[40:] + [("a", None, 5), ("c", 1, 2)]
    fa = spark.createDataFrame([(*x, i) for i, x in enumerate(a)], "k string, a_start long, a_end long, i long")
    fb = spark.createDataFrame([(*x, j) for j, x in enumerate(b)], "k string, b_start long, b_end long, j long")
    want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if None not in y and x[0] == y[0] and x[1] < y[2] and x[2] > y[1])
    assert sorted((r.i, r.j) for r in relations.overlaps(fa, fb, "k").collect()) == want
    assert sorted(r.i for r in relations.overlaps(fa, fb, "k", "left_semi").collect()) == sorted({i for i, _ in want})
    assert relations.overlaps(fa, fb.limit(0), "k").count() == 0


def test_a_span_of_8_gib_makes_few_rows(spark):
    n = spark.createDataFrame([(3, (8 << 30) + 5000)], "s long, e long").select(F.size(relations._cover(F.col("s"), F.col("e"))).alias("n")).first().n
    assert 1 <= n < 70


def walk(sizes, cap, fill=0):
    out, batch = [], 0
    for s in sizes:
        if fill + s > cap and fill:
            batch, fill = batch + 1, 0
        fill += s
        out.append(batch)
    return out, fill, batch


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 40).flatmap(lambda cap: st.tuples(st.just(cap), st.lists(st.lists(st.integers(0, cap), min_size=1, max_size=30), min_size=1, max_size=4))))
def test_passages_compose(case):
    cap, runs = case
    parts = [ch.Passage.of(np.array(r, np.int64), cap) for r in runs]
    left, right = parts[0], parts[-1]
    for p in parts[1:]:
        left = left.then(p)
    for p in reversed(parts[:-1]):
        right = p.then(right)
    flat = [s for r in runs for s in r]
    for fill in range(cap + 1):
        _, end, closed = walk(flat, cap, fill)
        for p in (left, right):
            (got,), (n,) = p.after(np.array([fill]))
            assert (got, n) == (end, closed)
        offsets, end = ch._walk(np.array(flat, np.int64), cap, fill)
        assert offsets.tolist() == walk(flat, cap, fill)[0] and end == walk(flat, cap, fill)[1]


@pytest.mark.parametrize("block", [3, 50, 100_000])
def test_next_fit_by_levels_equals_the_walk(spark, many, block, monkeypatch):
    many(20)
    monkeypatch.setattr(ch, "FAN", 4)
    rng = random.Random(block)
    sizes = [rng.choice([0, 1, 7, 40, 99, 100]) for _ in range(900)]
    items = spark.createDataFrame([(i, s, "p" * s) for i, s in enumerate(sizes)], "i long, s int, payload string")
    got = {r.i: r.batch_ordinal for r in ch.next_fit(items, "i", "s", 100, block).collect()}
    assert [got[i] for i in range(len(sizes))] == walk(sizes, 100)[0]


def test_next_fit_of_two_million_items(spark):
    n = 2_000_000
    items = spark.range(n).select(F.col("id").alias("i"), (F.pmod(F.xxhash64("id"), F.lit(97)) + 1).alias("s"))
    got = ch.next_fit(items, "i", "s", 1000, 20_000).toPandas().sort_values("i")
    offsets, _, _ = walk(got["s"].tolist(), 1000)
    assert len(got) == n and (got["batch_ordinal"].to_numpy() == np.array(offsets)).all()


def test_hashes_of_ordered_sets(spark, many):
    import hashlib

    many(30)
    rng = random.Random(9)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), i, None if i % 40 == 7 else f"é{i}") for i in range(2000)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, i long, v string").repartition(7, "k")
    sha = lambda parts: hashlib.sha256("\0".join(parts).encode()).hexdigest()
    own = {k: [r[2] for r in rows if r[0] == k] for k in ("hot", "a", "b", None)}
    got = {r.k: (r.ordered_hash, r.n) for r in rollup.ordered_hash(df, ["k"], ["i"], "v").collect()}
    assert got == {k: (sha([v for v in vs if v is not None]), len(vs)) for k, vs in own.items()}
    tree = {r.k: (r.tree_hash, r.n) for r in rollup.tree_hash(df, "k", ["i"], "v", leaf=50).collect()}
    assert tree == {k: (sha([sha([v for v in vs[j : j + 50] if v is not None]) for j in range(0, len(vs), 50)]), len(vs)) for k, vs in own.items()}
    assert rollup.ordered_hash(df.limit(0), ["k"], ["i"], "v").count() == rollup.tree_hash(df.limit(0), "k", ["i"], "v").count() == 0


def test_equal_tables_move_digests_alone(spark):
    a = spark.range(5000).select((F.col("id") % 900).alias("x"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("y"))
    assert tuple(relations.equal_tables(a, a.orderBy("y").select("y", "x")).first()) == (0, 0)
    b = a.where("x <> 5").unionByName(a.where("x = 6")).unionByName(spark.createDataFrame([(-1, None)], "x long, y string"))
    want = (a.exceptAll(b).count(), b.exceptAll(a).count())
    assert tuple(relations.equal_tables(a, b).first()) == want and min(want) > 0
    assert tuple(relations.equal_tables(a, b, 1).first()) == want
    assert tuple(relations.equal_tables(a.limit(0), a.limit(0)).first()) == (0, 0)


def test_priority_calls_are_dealt_in_bounded_parts(spark, sf_dir, monkeypatch):
    """The number of tasks that score batches rises with the calls, and Spark doesn't join them again."""
    monkeypatch.setattr(ordering, "DEALT", 500)
    import __spark_entry__

    scores = __spark_entry__.queries()["priority_score"](spark, sf_dir)
    assert scores.rdd.getNumPartitions() >= -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 500)


def test_python_workers_get_batches_of_bounded_bytes(spark, sf_dir):
    import __spark_entry__

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    try:
        assert __spark_entry__.queries()["chunk_facts"](spark, sf_dir).count() > 0
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
