"""Operator 5, a quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. A passage is encoded from its
hashed words and a few shares of its bytes and words; gated attention (a softmax
over the products of a tanh and a sigmoid gate) weighs the passages, and the
weighted sum is scored. Encoder, gates and scorer are learned together from the
documents' labels.

The model is fitted on a bounded sample: SAMPLE labelled documents outside the
held-out fold, by hash of the id. Its size is fixed. Texts are never shuffled;
all passages of all documents are scored where they lie.

Defined results: null or empty text is one passage without words; a document
labelled more than once counts with each label; null labels are left out;
without labels every score is 0.5; repeated rows get the same result; an empty
table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.llm.common import _SPACE, documents, fold, mapped, pieces, staged, utf8, word_hashes

FOLDS, HELD_OUT = 5, 0
PASSAGE = 100
SAMPLE = 4000
#: Few word cells: with 4,000 documents to learn from, more of them fit the words of the sample instead of what marks quality.
WORD_CELLS, HIDDEN, GATE = 128, 24, 12
EPOCHS, BATCH, RATE, DECAY = 16, 64, 0.01, 1e-4
THRESHOLD = 0.3

#: A class for every byte: letters by case, digits, white space, continuation and lead bytes, and punctuation by character.
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:192], _CLASS[192:] = 1, 2, 3, 4, 5
_CLASS[[32, 10]] = 6, 7
for _i, _c in enumerate(b".,;:!?#*$%&|<>@()-_=/'\""):
    _CLASS[_c] = 8 + _i
_CLASSES = int(_CLASS.max()) + 1
WIDTH = WORD_CELLS + _CLASSES + 4


def encode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and each row's bounds among them."""
    raw, bounds = utf8(column)
    words, at = word_hashes(raw, bounds)
    rows = len(at) - 1
    n = np.diff(at)
    passages = np.maximum(1, -(-n // PASSAGE))
    own = np.concatenate([[0], np.cumsum(passages)])
    total = int(own[-1])
    of_word = np.repeat(own[:-1], n) + (np.arange(len(words)) - np.repeat(at[:-1], n)) // PASSAGE
    cells = (words >> np.uint64(57)).astype(np.int64) % WORD_CELLS
    bag = np.bincount(of_word * WORD_CELLS + cells, minlength=total * WORD_CELLS).reshape(total, WORD_CELLS)
    # A byte belongs to the passage of the word that it is in or that came before it in its row.
    first = ~_SPACE[raw]
    first[1:] &= _SPACE[raw[:-1]]
    starts = bounds[:-1][np.diff(bounds) > 0]
    first[starts] = ~_SPACE[raw[starts]]
    word = np.cumsum(first) - 1
    row = np.repeat(np.arange(rows), np.diff(bounds))
    of_byte = np.where(word >= at[row], of_word[np.maximum(word, 0)] if len(of_word) else own[row], own[row])
    shares = np.bincount(of_byte * _CLASSES + _CLASS[raw], minlength=total * _CLASSES).reshape(total, _CLASSES)
    count, size = bag.sum(1), shares.sum(1)
    key = of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + words
    _, one = np.unique(key, return_index=True)
    distinct = np.bincount(of_word[one], minlength=total)
    follows = np.zeros(len(words), bool)
    follows[1:] = (words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])
    again = np.bincount(of_word[follows], minlength=total)
    c = np.maximum(count, 1)[:, None]
    out = np.concatenate([np.sqrt(bag / c), np.sqrt(shares / np.maximum(size, 1)[:, None]), np.stack([count / PASSAGE, size / np.maximum(count, 1) / 10, distinct / np.maximum(count, 1), again / np.maximum(count, 1)], 1)], axis=1)
    return out.astype(np.float32), own


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """Gated attention over encoded passages; parameters by name."""

    def __init__(self, rng: np.random.Generator) -> None:
        shapes = {"e": (WIDTH, HIDDEN), "eb": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "cb": (1,)}
        self.p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 else np.zeros(s) for k, s in shapes.items()}
        self.p["a"] = rng.normal(0, 0.3, GATE)
        self.p["c"] = rng.normal(0, 0.3, HIDDEN)
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, x: np.ndarray, own: np.ndarray) -> tuple:
        """Logits of the bags, and what backward() needs."""
        p, starts = self.p, own[:-1]
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["e"] + p["eb"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        s = (t * g) @ p["a"]
        sizes = np.diff(own)
        w = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes))
        w /= np.repeat(np.add.reduceat(w, starts), sizes)
        z = np.add.reduceat(w[:, None] * h, starts)
        return z @ p["c"] + p["cb"], (x, h, t, g, w, z, sizes)

    def backward(self, d: np.ndarray, kept: tuple, own: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients from those of the logits."""
        x, h, t, g, w, z, sizes = kept
        p = self.p
        dz = np.repeat(d[:, None] * p["c"], sizes, axis=0)
        dw = (dz * h).sum(1)
        ds = w * (dw - np.repeat(np.add.reduceat(w * dw, own[:-1]), sizes))
        dt, dg = ds[:, None] * p["a"] * g * (1 - t * t), ds[:, None] * p["a"] * t * g * (1 - g)
        dh = (w[:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
        return {"e": x.T @ dh, "eb": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ ds, "c": z.T @ d, "cb": d.sum(keepdims=True)}

    def score(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(x, own)[0])


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 3) -> Attention:
    """Fit by Adam on log loss, batches of documents."""
    rng = np.random.Generator(np.random.PCG64(seed))
    model = Attention(rng)
    everything = np.concatenate(bags)
    model.mean, model.scale = everything.mean(0), everything.std(0) + 0.05
    m, v, step = {k: 0.0 for k in model.p}, {k: 0.0 for k in model.p}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            own = np.concatenate([[0], np.cumsum([len(bags[j]) for j in some])])
            logits, kept = model.forward(np.concatenate([bags[j] for j in some]), own)
            grads = model.backward((_sigmoid(logits) - labels[some]) / len(some), kept, own)
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, grad in grads.items():
                grad = grad + DECAY * model.p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                model.p[k] = model.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _bags(batches):
    for batch in pieces(batches, "text"):
        x, own = encode(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([x[a:b].tobytes() for a, b in zip(own[:-1], own[1:])])], ["doc_id", "label", "bag"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Attention | None:
    """The model, from rows (doc_id, text) and (doc_id, label) that may be learned from."""
    some = staged(labels.where("label is not null and doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample), "labelled")
    rows = mapped(docs.join(F.broadcast(some), "doc_id").select("doc_id", "label", "text"), _bags, "doc_id long, label double, bag binary").collect()
    if not rows:
        return None
    rows = sorted((r["doc_id"], r["label"], bytes(r["bag"])) for r in rows)
    return train([np.frombuffer(b, np.float32).reshape(-1, WIDTH) for _, _, b in rows], np.array([y for _, y, _ in rows]))


def quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    learn = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label")).where(fold("doc_id", FOLDS) != HELD_OUT)
    model = docs.sparkSession.sparkContext.broadcast(fit(rows.where("not held_out").select("doc_id", "text"), learn, sample))

    def run(batches):
        for batch in pieces(batches, "text"):
            score = np.full(batch.num_rows, 0.5)
            if model.value is not None and batch.num_rows:
                score = model.value.score(*encode(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return mapped(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
