"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codegrain.llm import phrases as ph
from codegrain.llm.common import staged
from tests.llm.fixtures import ascii_lower, frame, rows

FILL = ("s", 0, 7, "z", 1, "h", 0)


def counted(listed):
    f, n = Counter(), Counter()
    for r in listed:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", ascii_lower(r[1])):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for d in (1, 2, 3):
                f.update((lang, *w[i : i + d]) for i in range(len(w) - d + 1))
    return f, n


def brute(listed, least, top, within=50):
    f, n = counted(listed)
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for p, a in candidates.items():
        lang, w = p[0], p[1:]
        longer = [c for q, c in candidates.items() if q[0] == lang and len(q) > len(p) and any(q[i : i + len(w)] == w for i in range(1, len(q)))]
        if any(100 * c >= within * a for c in longer):
            continue
        score, k, left, right = min((1000000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i + 1, phrase.decode(), -a, left, right, n[lang], -score) for lang, l in out.items() for i, (score, a, phrase, left, right) in enumerate(sorted(l)[:top])}


def listed(n=60, seed=1):
    rng = random.Random(seed)
    vocab = ["the", "of", "a", "é", "New", "york", "É", "中", "zz\x1f", "x" * 300, "c++", "\x00", "😀", "k", "b"]
    out = []
    for i in range(n):
        words = rng.choices(vocab, [9, 8, 7, 6, 5, 5, 4, 4, 2, 1, 2, 1, 2, 3, 3], k=rng.randint(0, 120))
        text = "".join(w + rng.choice([" ", " ", " ", " ", " ", "\t ", ". ", ",", "\n", " ; "]) for w in words)
        out.append((i, text, rng.choice(["en", "en", "en", None, "fr", "und", ""]), *FILL))
    return out


@pytest.mark.parametrize("n, shard, block, nodes, least, top", [(60, 1 << 20, 1 << 16, 1 << 22, 2, 2000), (40, 300, 15, 400, 3, 40), (8, 40, 1, 9, 2, 2000), (60, 5000, 64, 400, 10, 5)])
def test_phrases_equal_brute_force(spark, n, shard, block, nodes, least, top):
    docs = [*listed(n), *(rows() if n == 60 else [])]
    got = ph.phrases(frame(spark, docs).repartition(3), least=least, n=top, shard=shard, block=block, nodes=nodes)
    assert {tuple(r) for r in got.collect()} == brute(docs, least, top) and got.count()


def test_one_pair_in_a_third_of_all_places(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(x for _ in range(40) for x in ("hot", "pair", f"w{rng.randrange(30)}")), "en", *FILL) for i in range(30)]
    assert {tuple(r) for r in ph.phrases(frame(spark, docs), shard=900, block=16, nodes=60).collect()} == brute(docs, 10, 2000)


def test_all_words_of_a_language_and_no_rows(spark):
    docs = listed()
    f, n = counted(docs)
    blocks = staged(ph.tries(frame(spark, docs), shard=500, block=20), "tries")
    cuts = ph.bounds(blocks, 100)
    merged = ph.merge(ph.ranges(blocks, cuts), 1).collect()
    assert len(cuts) > 5 and {(r.lang, *[w for w in (r.w1, r.w2, r.w3) if w is not None]): r.f for r in merged if r.w1 is not None} == dict(f)
    assert all(r.f1 == f[(r.lang, r.w1)] and (r.w2 is None or r.f12 == f[(r.lang, r.w1, r.w2)]) for r in merged if r.w1 is not None)
    totals = Counter()
    for r in merged:
        totals[r.lang] += r.f if r.w1 is None else 0
    assert totals == n
    assert ph.phrases(frame(spark, [])).count() == 0
    assert ph.phrases(frame(spark, [(1, None, "en", *FILL), (2, " \n.", None, *FILL)])).count() == 0


def test_stretches_lose_and_repeat_nothing():
    text = np.frombuffer(("a b c. dd  ee\n" * 30 + "y" * 50 + " , q " * 20).encode(), np.uint8)
    for most in (1, 3, 10, 64, 10_000):
        got = ph.shard_nodes(list(ph._stretches("en", text, most)))
        whole = ph.shard_nodes([("en", text, 0)])
        assert {got.key(i): got.n[i] for i in range(len(got)) if got.n[i]} == {whole.key(i): whole.n[i] for i in range(len(whole))}


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 2_999_999_999_999, 3_000_000_000_001, 9_999_999_999_999
    row = spark.range(1).select(ph._score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first()
    assert row.s == 1_000_000 * a * a // (left * right)


def test_sql_gives_the_same_rows(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = ph.query(spark, sf_dir)
    want = con.sql(f"select {', '.join(got.columns)} from ({ph.ORACLE_SQL})").fetchall()
    assert {tuple(r) for r in got.collect()} == set(want) and len(want) > 100


def test_keys_beyond_64_bits():
    """As if there were very many words in one range: the same merge over unbounded integers."""
    texts = [np.frombuffer((" ".join(f"w{i}" for i in range(a, 3000, 7)) + " w1 w2 w1 w2").encode(), np.uint8) for a in (0, 2)]
    runs = [ph.shard_nodes([("en", t, 0)]) for t in texts]
    want = Counter()
    for r in runs:
        for i in range(len(r)):
            want[r.key(i)] += int(r.n[i])
    small, keys, _ = ph._merged([pa.py_buffer(r.dump()) for r in runs])
    assert {small.key(i): int(small.n[i]) for i in range(len(small))} == want and keys.dtype == np.uint64
    kept, ph.KEY_BITS = ph.KEY_BITS, 8
    try:
        wide, keys, bits = ph._merged([pa.py_buffer(r.dump()) for r in runs])
        assert {wide.key(i): int(wide.n[i]) for i in range(len(wide))} == want and keys.dtype == object
        assert [x.tolist() for x in ph._walked(wide, keys, bits, np.arange(len(wide)))] == [x.tolist() for x in ph._walked(small, np.array([int(k) for k in keys], object), bits, np.arange(len(small)))]
    finally:
        ph.KEY_BITS = kept


def test_joins_of_phrases_are_never_broadcast(spark):
    """However small the staged nodes look, the driver gets none of them."""
    nodes = spark.createDataFrame([("en", "a", None, None, 30, 30, 0), ("en", "b", None, None, 30, 30, 0), ("en", "a", "b", None, 20, 30, 20), ("en", "a", "b", "a", 12, 30, 20), ("en", "b", "a", None, 12, 30, 12)], "lang string, w1 string, w2 string, w3 string, f long, f1 long, f12 long")
    found = ph.scored(staged(nodes, "nodes"))
    assert {r.phrase for r in found.collect()} == {"a b a"}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def _range_sizes(blocks, nodes):
    """Nodes of each range, without those above its bound."""
    dealt = ph.ranges(blocks, ph.bounds(blocks, nodes)).where("block is not null").collect()
    sizes = Counter()
    for r in dealt:
        sizes[r.part] += len(ph.Nodes.load(pa.py_buffer(bytes(r.block))))
    return sizes


def test_no_range_grows_with_the_number_of_shards_alike(spark):
    """Shards that begin, and are cut into blocks, at nearly the same nodes: ranges have about the nodes asked for, however many shards there are."""
    words = sorted({f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"})
    texts = [(i, "\n".join(random.Random(i).sample(words, 100)), "en", *FILL) for i in range(150)]
    blocks = staged(ph.tries(frame(spark, texts).repartition(3, "doc_id"), shard=350, block=40), "tries")
    sizes = _range_sizes(blocks, 400)
    total = sum(sizes.values())
    assert total == blocks.agg(F.sum("n")).first()[0] and total > 10_000
    assert max(sizes.values()) < 4 * 400


def test_nodes_above_a_bound_are_one_number_for_each_shard(spark):
    docs = [(i, " ".join(f"hot w{(i + j) % 40:02}" for j in range(40)), "en", *FILL) for i in range(40)]
    blocks = staged(ph.tries(frame(spark, docs), shard=500, block=16), "tries")
    dealt = ph.ranges(blocks, ph.bounds(blocks, 100))
    lent = dealt.where("block is null").groupBy("part", "lang", "w1", "w2").agg(F.sum("n").alias("n")).collect()
    f, _ = counted(docs)
    assert lent and all(r.n == f[(r.lang, *[w for w in (r.w1, r.w2) if w])] for r in lent)
    assert {(r.lang, *[w for w in (r.w1, r.w2, r.w3) if w is not None]): r.f for r in ph.merge(dealt, 1).where("w1 is not null").collect()} == dict(f)
