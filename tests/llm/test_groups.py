"""Operators on pairs, passages and pieces, against plain re-implementations."""

import hashlib
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codegrain.llm import common, near_dup, packing, pii, repeats, token_counts, tokens
from codegrain.llm.components import components
from tests.llm.fixtures import SCHEMA, ascii_lower, frame, prose, rows, split


def as_multiset(found):
    return Counter(map(tuple, found))


def brute_near(listed, percent=85):
    sets = {}
    for r in listed:
        w = split(ascii_lower(r[1]))
        sets[id(r)] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted({r[0] for r in listed if r[0] is not None})
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    named = [r for r in listed if r[0] is not None and sets[id(r)]]
    for i, a in enumerate(named):
        for b in named[:i]:
            x, y = sets[id(a)], sets[id(b)]
            if 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a[0]), find(b[0])
                root[max(p, q)] = min(p, q)
    for r in listed:
        c = None if r[0] is None else find(r[0]) if sets[id(r)] else r[0]
        yield r[0], len(sets[id(r)]), c, c is None or c == r[0]


def edited(text, n, seed):
    rng = random.Random(seed)
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_dup(spark):
    # Chains, stars, and groups near the threshold, where hubs don't reach everyone.
    listed = [tuple(r[:2]) + r[2:] for r in rows()]
    fill = ("en", "s", 0, 7, "z", 1, "h", 0)
    for g in range(6):
        text = prose(150, 900 + g)
        for i in range(14):
            listed.append((1000 + 100 * g + (i * 37) % 97, edited(text, 1 + (i + g) % 4, 7 * i + g), *fill))
        for i in range(12):
            listed.append((3000 + 100 * g + i, text, *fill))
            text = edited(text, 1, i)
    # An id with two texts, each of which another document nearly has: all of them are one component.
    two = [prose(100, 40), prose(100, 41)]
    listed += [(7000, two[0], *fill), (7000, two[1], *fill), (7001, edited(two[0], 1, 5), *fill), (6990, edited(two[1], 1, 6), *fill)]
    got = near_dup.near_dup(frame(spark, listed)).collect()
    assert as_multiset(got) == as_multiset(brute_near(listed))
    assert near_dup.near_dup(frame(spark, [])).count() == 0


def test_near_dup_keep(spark):
    docs = frame(spark)
    kept = near_dup.keep(spark, docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    want = Counter({r[0] for r in brute_near(rows()) if r[3] and r[0] is not None})
    assert {k: v for k, v in ids.items() if k is not None} == want and ids[None] == 2


def test_near_dup_keeps_other_texts_of_an_id(spark):
    from pyspark.sql import functions as F

    fill = ("en", "s", 0, 7, "z", 1, "h", 0)
    docs = frame(spark, [(1, prose(90, 1), *fill), (1, prose(90, 2), *fill), (1, prose(90, 1), *fill)]).withColumns({c: F.lit(0) for c in ("row", "id", "gone", "d1")})
    kept = near_dup.keep(spark, docs)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == sorted([prose(90, 1), prose(90, 2)])


def test_estimate_is_unbiased():
    rng = np.random.default_rng(1)
    got = []
    for _ in range(40):
        both, a, b = (np.sort(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)) for n in (800, 100, 100))
        x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
        r = near_dup.registers(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        got.append(near_dup.estimate(r[:1], r[1:])[0])
    assert abs(np.mean(got) - 0.8) < 0.02


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(205, 201), (201, 203), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 203: 201, 205: 201}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))


def odd_texts(spark, sf_dir):
    return [r[1] or "" for r in rows()] + ["á ́b   c\x1fd e f", "it's   they'll", "\n\n ", "x" * 300, "<|startoftext|>a <|endoftext|>", "Ａ１ ﬁ Σς ΑΣ Σ"] + [
        r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()
    ]


def test_tokens_equal_whole_encoding(spark, sf_dir, tokenizer):
    encoder = tokens.PartEncoder.of(None)
    for t in odd_texts(spark, sf_dir):
        whole = tokenizer.encode(t, add_special_tokens=False)
        assert np.frombuffer(encoder.ids(t), "<u4").tolist() == whole.ids
        assert encoder.spans(t).tolist() == [list(x) for x in whole.offsets]


@pytest.mark.parametrize("vocabulary", [None, "byte_bpe_50k.json"])
def test_tokens_of_a_column(spark, sf_dir, vocabulary):
    encoder = tokens.PartEncoder.of(vocabulary and public_tokenizers.path(vocabulary))
    texts = [None, *odd_texts(spark, sf_dir), "", None]
    column = pa.concat_arrays([pa.array(["x", None]), pa.array(texts), pa.array(["y"])])[2:-1]
    ids, at = encoder.batch_ids(column)
    assert [ids[a:b].tobytes() for a, b in zip(at, at[1:])] == [encoder.ids(t or "") for t in texts]
    assert [x.tolist() for x in encoder.batch_ids(pa.array([], pa.string()))] == [[], [0]]


def test_other_vocabularies_are_encoded_whole(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    other, encoder = Tokenizer.from_file(path), tokens.PartEncoder.of(path)
    assert not encoder.by_parts and tokens.PartEncoder.of(None).by_parts
    for t in odd_texts(spark, sf_dir)[:40]:
        whole = other.encode(t, add_special_tokens=False)
        assert np.frombuffer(encoder.ids(t), "<u4").tolist() == whole.ids
        assert encoder.spans(t).tolist() == [list(x) for x in whole.offsets]


def check_packing(found, capacity):
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, tokenizer):
    for capacity in (2048, 100):
        found = packing.pack(frame(spark), capacity).collect()
        n = check_packing(found, capacity)
        want = []
        for r in rows():
            ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
            want += [(r[0], i, i * capacity, len(p := ids[i * capacity : (i + 1) * capacity]), zlib.crc32(p.tobytes())) for i in range(-(-len(ids) // capacity))]
        assert as_multiset(tuple(r)[:5] for r in found) == as_multiset(want)
        gaps = []
        for length in sorted((w[3] for w in want), reverse=True):
            fit = [g for g in gaps if g >= length]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - length)
            else:
                gaps.append(capacity - length)
        assert n == len(gaps)
    assert packing.pack(frame(spark, [])).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(30):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(1, 300))]
        gaps = []
        for s in sorted(sizes, reverse=True):
            fit = [g for g in gaps if g >= s]
            if fit:
                gaps.remove(min(fit))
            gaps.append((min(fit) if fit else 50) - s)
        used = {}
        for length, rank, each, first, offset in (rules := packing.plan(Counter(sizes), 50)):
            later = [r[1] for r in rules if r[0] == length and r[1] > rank]
            for r in range(rank, min(later, default=Counter(sizes)[length])):
                used.setdefault(first + (r - rank) // each, []).append((offset + (r - rank) % each * length, length))
        assert len(used) == len(gaps)
        for held in used.values():
            assert all(a + n == b for (a, n), (b, _) in zip(sorted(held), sorted(held)[1:])) and sum(n for _, n in held) <= 50


def test_token_counts(spark, tokenizer):
    got = token_counts.token_counts(frame(spark), token_counts.pages("text", 7)).collect()
    want = []
    for r in rows():
        text = r[1] or ""
        spans = tokenizer.encode(text, add_special_tokens=False).offsets
        pages = [(i, i + 7 if i + 7 < len(text) else len(text)) for i in range(0, max(len(text), 1), 7)]
        n, c = Counter(), Counter()
        for a, b in spans:
            share = {i: min(b, pages[i][1]) - max(a, pages[i][0]) for i in range(a // 7, min(len(pages), b // 7 + 1))}
            best = max(share, key=lambda i: (share[i], -i))
            n[best] += 1
            c[best] += share[best] < b - a
        want += [(r[0], i, f"page {i + 1}", a, b, n[i], c[i]) for i, (a, b) in enumerate(pages)]
    assert as_multiset(got) == as_multiset(want)


def test_tokens_outside_sections(spark):
    from pyspark.sql import functions as F

    one = F.expr("array(named_struct('name', 'head', 'start', 0L, 'end', 3L))")
    docs = frame(spark, [(1, "one two three", None, None, 0, 0, "", 0, "", 0), (2, None, None, None, 0, 0, "", 0, "", 0)])
    got = {(r.doc_id, r.section): r.n_tokens for r in token_counts.token_counts(docs, one).collect()}
    assert got == {(1, -1): 2, (1, 0): 1, (2, 0): 0}


def brute_repeats(listed, length):
    seen = Counter()
    raws = [(r[1] or "").encode() for r in listed]
    for raw in raws:
        seen.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    for r, raw in zip(listed, raws):
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        yield r[0], len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()


def brute_passages(listed, length, words):
    """The longest stretches covered by repeated strings of ``length`` bytes that have so many words."""
    raws = [(r[1] or "").encode() for r in listed]
    seen = Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    for r, raw in zip(listed, raws):
        ends = []
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                if ends and i <= ends[-1][1]:
                    ends[-1][1] = i + length
                else:
                    ends.append([i, i + length])
        yield str(r[0]), sum(len(raw[a:b].split()) >= words for a, b in ends)


@pytest.mark.parametrize("hot", [repeats.HOT, 3])
def test_repeats(spark, hot):
    fill = ("en", "s", 0, 7, "z", 1, "h", 0)
    rng = random.Random(3)
    shared = [prose(12, 50 + i) for i in range(4)]
    listed = [r for r in rows() if r[0] != 8]
    for i in range(40):
        parts = [prose(rng.randint(3, 20), 500 + i)] + rng.sample(shared, rng.randint(0, 3)) + [prose(5, 700 + i)]
        listed.append((5000 + i, " ".join(parts), *fill))
    listed.append((6000, "ab" * 100 + shared[0] * 2, *fill))
    listed.append((6001, "ab" * 5000 + "c" + "xyz" * 700 + " . " + "ab" * 30, *fill))
    found = repeats.remove_repeats(frame(spark, listed), length=40, gram=8, hot=hot, short=24, words=4)
    assert as_multiset(found.drop("kept", "n_passages").collect()) == as_multiset(brute_repeats(listed, 40))
    assert sorted((str(r.doc_id), r.n_passages) for r in found.collect()) == sorted(brute_passages(listed, 24, 4))


def test_repeats_numbers_by_production_parameters(spark):
    listed = [r for r in rows() if r[0] is not None]
    seen = {}
    listed = [seen.setdefault(r[0], r) for r in listed if r[0] not in seen]
    found = repeats.remove_repeats(frame(spark, listed))
    assert as_multiset(found.drop("kept", "n_passages").collect()) == as_multiset(brute_repeats(listed, 400))
    assert sorted((str(r.doc_id), r.n_passages) for r in found.collect()) == sorted(brute_passages(listed, 200, 50))
    assert repeats.remove_repeats(frame(spark, [])).count() == 0
    assert SCHEMA.startswith("doc_id long")


def test_near_dup_at_another_threshold(spark):
    # Two words changed far apart in 110: 96 of 116 shingles are shared, a similarity of 0.83.
    fill = ("en", "s", 0, 7, "z", 1, "h", 0)
    listed = []
    for g in range(20):
        w = prose(110, 300 + g).split()
        listed.append((10 * g, " ".join(w), *fill))
        w[30], w[70] = f"x{g}", f"y{g}"
        listed.append((10 * g + 1, " ".join(w), *fill))
    docs = frame(spark, listed)
    assert near_dup.near_dup(docs).where("not kept").count() == 0
    assert near_dup.near_dup(docs, percent=80).where("not kept").count() == 20
    assert near_dup.keep(spark, docs, percent=80).count() == 20
    assert [near_dup.band_rows(p) for p in (85, 80)] == [5, 4]


def test_workers_keep_values_for_one_function_only(spark):
    """A worker's encoder stays for later tasks of its function, and goes when another function's task comes."""
    here = SimpleNamespace(sparkSession=spark, mapInArrow=lambda run, schema: run)  # tasks run in this process

    def counts(batches):
        yield len(tokens._OPEN) + len(common._POWERS) + pii._known.cache_info().currsize

    def fills(batches):
        yield len(tokens._OPEN)
        tokens.PartEncoder.of(None), common._powers(10), pii.shape("word")

    tasks = [common.mapped(here, run, "n long") for run in (fills, fills, counts)]
    assert [list(run([])) for run in tasks] == [[0], [1], [0]]


@pytest.mark.parametrize("step", [near_dup.near_dup, pii.redact, packing.pack])
def test_steps_of_the_pipeline_take_small_batches(spark, step):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(common.BATCH_BYTES))
    try:
        step(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"))
        assert int(spark.conf.get(key)) <= 2 << 20
    finally:
        spark.conf.set(key, before)
