"""Trained classifiers by held-out accuracy, and the pipeline."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from codegrain.llm import language_id, quality_model
from tests.llm.fixtures import frame, rows

SF = "/root/testdata/sf0.01"


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97 and len(got) > 200
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_awkward_rows(spark):
    found = language_id.language_id(frame(spark)).collect()
    assert len(found) == len(rows())
    assert {(r.lang_pred, r.score) for r in found if r.doc_id in (4, 5, 6)} == {("und", 0.0)}
    assert language_id.language_id(frame(spark, [])).count() == 0
    nothing = language_id.language_id(frame(spark, [(1, "some words", None, None, 0, 0, "", 0, "", 0)])).collect()
    assert [r.lang_pred for r in nothing] == ["und"]


def test_quality_model(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_model.query(spark, SF).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9, auc


def test_quality_model_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (8, 1), (12, 0), (None, 1), (9, None)], "doc_id long, quality int")
    found = quality_model.quality_model(frame(spark), labels).collect()
    assert len(found) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert {r.score for r in quality_model.quality_model(frame(spark), labels.where("false")).collect()} == {0.5}
    assert quality_model.quality_model(frame(spark, []), labels).count() == 0


def test_attention_gradients():
    rng = np.random.default_rng(2)
    model = quality_model.Attention(rng)
    x, own, y = rng.normal(size=(7, quality_model.WIDTH)), np.array([0, 3, 7]), np.array([1.0, 0.0])

    def loss():
        logits, _ = model.forward(x, own)
        return (np.log1p(np.exp(logits)) - y * logits).sum()

    logits, kept = model.forward(x, own)
    grads = model.backward(1 / (1 + np.exp(-logits)) - y, kept, own)
    for k, p in model.p.items():
        at = tuple(rng.integers(0, n) for n in p.shape)
        p[at] += 1e-5
        up = loss()
        p[at] -= 2e-5
        down = loss()
        p[at] += 1e-5
        assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-5, k


def test_passages_cover_all_words():
    x, own = quality_model.encode(pa.array(["a b " * 130, None, "", "c"]))
    assert np.diff(own).tolist() == [3, 1, 1, 1]
    assert np.allclose(x[:, quality_model.WORD_CELLS + quality_model._CLASSES] * quality_model.PASSAGE, [100, 100, 60, 0, 0, 1])


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at, left = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf_dir)
        assert at.columns == docs.columns, name
        n = at.count()
        assert 0 < n <= left, name
        left = n
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in at.select("doc_id").collect()}


def test_pipeline_stages_against_brute_force(spark, sf_dir):
    """Every stage over the rows of its predecessor, against plain re-implementations."""
    from collections import Counter

    from codegrain.llm import pii
    from tests.llm.test_groups import brute_near, check_packing, edited
    from tests.llm.test_rows import brute_hits, brute_hot_lines, brute_quality, plain_line

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    listed = [(*r, 7, "z", 1, "h", 0) for r in docs.collect()]
    listed += [(9000 + i, edited(r[1], 2, i), *r[2:]) for i, r in enumerate(listed[:40]) if r[1]]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    at = frame(spark, listed)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "quality_rules":
            hot = brute_hot_lines(listed)
            kept = [r for r, v in zip(listed, brute_quality(listed)) if v[-1]]
            want = [(r[0], "\n".join(x for x in r[1].split("\n") if (r[3] or "", plain_line(x)) not in hot), *r[2:]) for r in kept]
        elif name == "near_dup":
            want = [r for r, v in zip(listed, brute_near(listed, 80)) if v[-1]]
        elif name == "decontaminate":
            want = [r for r, v in zip(listed, brute_hits(listed, bench)) if not v[-1]]
        else:
            field = pii.fit()
            want = [(r[0], pii.redacted(r[1], pii.all_spans([r[1]], field)[0][1]), *r[2:]) for r in listed]
        at = stage(spark, at, sf_dir)
        got = [tuple(r) for r in at.collect()]
        assert Counter(got) == Counter(want) and 0 < len(got) <= len(listed), name
        at, listed = frame(spark, got), got
    out = corpus_pipeline.STAGES[-1][1](spark, at, sf_dir).collect()
    assert {r.doc_id for r in out} == {r[0] for r in listed} and check_packing(out, 2048) <= len(out)


def test_pipeline_over_awkward_rows(spark, sf_dir):
    for listed in (None, []):
        at = frame(spark, listed)
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, sf_dir)
        assert at.count() >= 0
