"""Texts of a megabyte in hostile forms: every operator gives a row for each, in bounded time."""

import time

from codegrain.llm import decontaminate, language_id, near_dup, packing, pii, quality_model, quality_rules, repeats, suffix_tree, token_counts
from tests.llm.fixtures import frame, prose

N = 1 << 20
TEXTS = ["a" * N, "ab" * (N // 2), "0 " * (N // 2), "\n" * N, "x y\n" * (N // 4), "a@" * (N // 2), "é" * (N // 2), prose(60_000, 9)]


def docs(spark):
    fill = ("s", 0, 7, "z", 1, "h", 0)
    return frame(spark, [(i, t, "en", *fill) for i, t in enumerate([*TEXTS, prose(100, 3)])])


def test_every_operator_takes_long_hostile_texts(spark):
    d = docs(spark).repartition(4)
    bench = spark.createDataFrame([(1, "x y x y x y x y x y x y x y"), (2, prose(40, 77))], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    runs = {
        "op1": lambda: language_id.language_id(d), "op2": lambda: quality_rules.quality_rules(d), "op3": lambda: token_counts.token_counts(d, token_counts.pages()).select("doc_id").distinct(), "op4": lambda: decontaminate.decontaminate(d, bench),
        "op5": lambda: quality_model.quality_model(d, labels), "op6": lambda: pii.find(d), "op7": lambda: suffix_tree.lm_scores(d), "op8": lambda: packing.pack(d).select("doc_id").distinct(), "op9": lambda: near_dup.near_dup(d), "op10": lambda: repeats.remove_repeats(d).drop("kept"),
    }
    for name, run in runs.items():
        began = time.time()
        rows = run().collect()
        assert sorted(r.doc_id for r in rows) == list(range(9)), name
        assert time.time() - began < 240, name
    gone = {r.doc_id: r.n_removed for r in repeats.remove_repeats(d).collect()}
    assert [gone[i] for i in (0, 1, 2, 3, 4)] == [len(t) for t in TEXTS[:5]] and gone[8] == 0
    hit = {r.doc_id: r.contaminated for r in decontaminate.decontaminate(d, bench).collect()}
    assert hit[4] and not hit[7]
