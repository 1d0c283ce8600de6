"""Operator 3, token counts of sections by offset-mapped attribution.

A whole document is encoded once. Every token has the characters it came from;
joining these spans with the sections' gives each section its tokens. A token
that crosses a boundary goes to the section that holds most of its characters,
the earlier one of equals. Tokens in no section are counted in a row of their
own with section -1.

Sections are an array of (name, start, end) in characters, end exclusive, sorted
and disjoint; the join is a merge of two sorted lists within a row, so nothing is
shuffled.

Defined results: null and empty texts have no tokens and a row for each section
they are given; a null array of sections is an empty one; null and repeated ids
get a result for each row; a text of any length is encoded whole; an empty table
gives an empty result; other columns are never looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.llm.common import documents, mapped, pieces
from codegrain.llm.tokens import PartEncoder

PAGE = 1000


def attribute(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token span, -1 for none, and whether it touches more than that section."""
    a, b = spans[:, 0], spans[:, 1]
    first = np.searchsorted(ends, a, side="right")
    last = np.searchsorted(starts, b, side="left") - 1
    best, most = np.full(len(a), -1), np.zeros(len(a), np.int64)
    step = 0
    while len(ends) and (open_ := first + step <= last).any():
        i = np.minimum(first + step, len(ends) - 1)
        share = np.where(open_, np.minimum(b, ends[i]) - np.maximum(a, starts[i]), 0)
        better = share > most
        best[better], most[better] = i[better], share[better]
        step += 1
    return best, most < b - a


def token_counts(docs: DataFrame, sections: Column, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """A row for each section of each document: doc_id, section (int, from 0), name, start, end, n_tokens, n_crossing (of these, cut by a boundary)."""

    def run(batches):
        encoder = PartEncoder.of(tokenizer)
        for batch in pieces(batches, "text"):
            cols = [[] for _ in range(7)]
            for row, (text, secs) in enumerate(zip(batch.column("text").to_pylist(), batch.column("sections").to_pylist())):
                secs = secs or []
                starts, ends = np.array([s["start"] for s in secs], np.int64), np.array([s["end"] for s in secs], np.int64)
                at, crossing = attribute(encoder.spans(text or ""), starts, ends)
                n, c = np.bincount(at + 1, minlength=len(secs) + 1), np.bincount(at[crossing] + 1, minlength=len(secs) + 1)
                listed = [(i, s["name"], s["start"], s["end"]) for i, s in enumerate(secs)]
                for i, name, start, end in ([(-1, None, None, None)] if n[0] else []) + listed:
                    for col, x in zip(cols, (row, i, name, start, end, int(n[i + 1]), int(c[i + 1]))):
                        col.append(x)
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(arrays[0]), *arrays[1:]], ["doc_id", "section", "name", "start", "end", "n_tokens", "n_crossing"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), sections.alias("sections"))
    return mapped(rows, run, "doc_id long, section int, name string, start long, end long, n_tokens long, n_crossing long")


def pages(text_col: str = "text", size: int = PAGE) -> Column:
    """Sections of ``size`` characters each, over the whole text."""
    n = f"coalesce(length({text_col}), 0)"
    one = f"named_struct('name', concat('page ', i + 1), 'start', cast(i * {size} as bigint), 'end', cast(least((i + 1) * {size}, {n}) as bigint))"
    return F.expr(f"transform(sequence(0, greatest({n} - 1, 0) div {size}), i -> {one})")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), pages())
