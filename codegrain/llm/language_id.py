"""Operator 1, language identification.

Sparse multinomial logistic regression on TF-IDF of character n-grams, trained
by follow-the-regularised-leader with elastic-net penalties, then calibrated by
a temperature.

Characters are lower-cased code points; n-grams of 1 to 3 of them, digits folded,
are hashed to FEATURES cells. Document frequencies are counted over all
documents that may be learned from. The regression is fitted on a bounded
sample: PER_LANGUAGE documents of each language, by hash of the id. A fifth of
the sample chooses the temperature.

What is sent to all executors is a table of FEATURES rows and as many columns as
there are languages. Texts are never shuffled.

Defined results: null text, or one without a letter (of a Unicode category of
letters), gets `und` with score 0; of languages with equal scores the first by
name is given; texts of any length are whole;
null languages are not learned from; without anything to learn from every text
gets `und`; repeated rows get the same result; an empty table gives an empty
result; other columns are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codegrain.llm.common import documents, fold, mapped, pieces, staged

FOLDS, HELD_OUT = 3, 1
FEATURES = 1 << 14
ORDERS = 3
PER_LANGUAGE, EPOCHS = 400, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.01
UNKNOWN = "und"
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells and counts of a text's n-grams."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where((c >= 48) & (c < 58), np.uint32(48), c)
    counts = np.zeros(FEATURES, np.int64)
    h = np.zeros(len(c), np.uint32)
    for n in range(ORDERS):
        h = (h[: len(c) - n] * np.uint32(31) + c[n:] + np.uint32(n + 1)) * _MULT[n]
        if len(h):
            cells = (h ^ h >> np.uint32(15)) & np.uint32(FEATURES - 1)
            for i in range(0, len(cells), 1 << 20):
                counts += np.bincount(cells[i : i + (1 << 20)], minlength=FEATURES)
        h = h[: max(0, len(c) - n - 1)]
    at = np.flatnonzero(counts)
    return at, counts[at].astype(np.float64)


def has_letter(text: str) -> bool:
    """Whether a character is of a category of letters; numbers such as a half or a raised two aren't."""
    return any(map(str.isalpha, text))


def _frequencies(batches):
    """Documents that have a cell: a partial count for each task."""
    total, rows = np.zeros(FEATURES, np.int64), 0
    for batch in pieces(batches, "text"):
        for text in batch.column("text").to_pylist():
            if text:
                total[features(text)[0]] += 1
                rows += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(FEATURES), -1)), pa.array(np.append(total, rows))], ["cell", "n"])


def _examples(batches):
    for batch in pieces(batches, "text"):
        at = [features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array([a.astype(np.int32).tobytes() for a, _ in at]), pa.array([c.astype(np.float32).tobytes() for _, c in at])], ["lang", "cells", "counts"]
        )


def _unit(cells: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[cells]
    return x / max(np.sqrt(x @ x), 1e-12)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, size: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (size, classes) of a multinomial regression over sparse rows (cells, values)."""
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(cells):
        zs, ns = z[cells], n[cells]
        return np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    rng = np.random.Generator(np.random.PCG64(1))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            cells, x = rows[i]
            w = weights(cells)
            p = _softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[cells] + g * g) - np.sqrt(n[cells])) / ALPHA
            z[cells] += g - sigma * w
            n[cells] += g * g
    return weights(np.arange(size))


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least log loss, by golden section over its logarithm."""

    def loss(t):
        p = _softmax(scores / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    a, b, r = np.log(0.02), np.log(5.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Languages, idf, weights and temperature, from rows (doc_id, text, lang) that may be learned from."""
    counts = mapped(docs.select("text"), _frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(FEATURES), 0
    for cell, n in counts:
        if cell < 0:
            total = n
        else:
            df[cell] = n
    idf = np.log((1 + total) / (1 + df)) + 1
    # The first by hash of each language. Only hashes so small that four times as many are expected
    # are ranked, so that a language of a third of all rows isn't ranked in one task.
    ids = docs.where("text is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("o"))
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n"))
    low = (F.col("o") / 2.0**64 + 0.5) * F.col("n") <= 4.0 * per_language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o", "doc_id"))
    sample = staged(ids.join(F.broadcast(sizes), "lang").where(low).withColumn("r", rank).where(F.col("r") <= per_language).select("doc_id").distinct(), "sample")
    got = mapped(docs.join(F.broadcast(sample), "doc_id").select("lang", "text"), _examples, "lang string, cells binary, counts binary")
    examples = sorted(map(tuple, got.collect()))
    langs = sorted({x[0] for x in examples})
    rows = []
    for _, cells, values in examples:
        c = np.frombuffer(bytes(cells), np.int32)
        rows.append((c, _unit(c, np.frombuffer(bytes(values), np.float32).astype(np.float64), idf)))
    labels = np.array([langs.index(x[0]) for x in examples], np.int64)
    held = np.arange(len(rows)) % 5 == 4
    if not langs:
        return langs, idf, np.zeros((FEATURES, 0)), 1.0
    w = ftrl([r for r, h in zip(rows, held) if not h], labels[~held], len(langs), FEATURES)
    t = temperature(np.array([rows[i][1] @ w[rows[i][0]] for i in np.flatnonzero(held)]), labels[held]) if held.any() else 1.0
    return langs, idf, w, t


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score."""
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows.where("not held_out and lang is not null").drop("held_out"), per_language))

    def run(batches):
        langs, idf, w, t = model.value
        for batch in pieces(batches, "text"):
            guess, score = [], []
            for text in batch.column("text").to_pylist():
                if not langs or not text or not has_letter(text):
                    guess.append(UNKNOWN)
                    score.append(0.0)
                    continue
                cells, counts = features(text)
                p = _softmax(_unit(cells, counts, idf) @ w[cells] / t)
                guess.append(langs[i := int(p.argmax())])
                score.append(float(p[i]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(guess, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return mapped(rows.select("doc_id", "held_out", "text"), run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))
