"""Operator 8, bulk-synchronous best-fit packing.

Texts are encoded once; of a document remain its pieces (length, checksum).
Pieces are range-sorted by length: each gets its rank among those of its length,
from a rank within a shard and the counts of all shards. Gaps of open sequences
are kept sorted too, as runs of equal gaps. A superstep takes the next shorter
length: a sweep over the sorted gaps gives every document the smallest gap that
holds it, ranks settle which document gets which of equal gaps, the gaps shrink,
and what found no gap opens sequences. There are as many supersteps as lengths,
``capacity`` at most, and the result is that of best-fit over pieces sorted by
falling length.

Equal lengths and equal gaps are interchangeable, so a superstep needs their
counts alone: the plan is computed from a table of at most ``capacity`` rows,
whatever the corpus, and has rules of the form "ranks a to b of length l go to
sequences from s on". Ranking and applying the rules are distributed. A length
that a third of all pieces share is sharded by hash.

Defined results: null text is empty; an empty text is one piece of length 1;
null and repeated ids are packed row by row; an empty table gives an empty
result; other columns are never looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codegrain.llm.common import SMALL_BATCH, documents, mapped, pieces, staged
from codegrain.llm.tokens import KEPT, PartEncoder

CAPACITY = 2048
END = b"\0\0\0\0"
#: Pieces to a shard, about.
SHARD = 200_000


def cut(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, kept: int = KEPT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32. ``kept``: token parts that a worker keeps."""

    def run(batches):
        encoder = PartEncoder.of(tokenizer, kept)
        for batch in pieces(batches, "text", 1 << 20):
            ids, cols = batch.column("doc_id"), [[], [], [], [], []]
            coded, bounds = encoder.batch_ids(batch.column("text"))
            for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                whole = coded[a:b].tobytes() + END
                for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[at : at + 4 * capacity]
                    for col, x in zip(cols, (row, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, piece int, start long, length long, ids_crc32 long", SMALL_BATCH)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rules (length, first rank, pieces to a sequence, first sequence, first offset) of best-fit, sorted by length and rank.

    ``counts`` has the number of pieces of each length. The piece of rank r
    under a rule that starts at rank a and puts t to a sequence goes to sequence
    ``first + (r - a) // t``, at ``offset + (r - a) % t * length``.
    """
    gaps: list[tuple[int, int, int]] = []  # runs of equal gaps: gap, first sequence, sequences
    rules, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect_left(gaps, (length, -1, -1))
            if i < len(gaps):
                gap, first, n = gaps.pop(i)
            else:
                each = capacity // length
                gap, first, n = capacity, opened, -(-left // each)
                opened += n
            each = gap // length
            full = min(n, left // each)
            if full:
                rules.append((length, rank, each, first, capacity - gap))
                rank, left = rank + full * each, left - full * each
                if gap - each * length:
                    insort(gaps, (gap - each * length, first, full))
            if full < n:
                if left:
                    rules.append((length, rank, left, first + full, capacity - gap))
                    if gap - left * length:
                        insort(gaps, (gap - left * length, first + full, 1))
                    full, left = full + 1, 0
                if full < n:
                    insort(gaps, (gap, first + full, n - full))
    return sorted(rules)


def best_fit(cuts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cuts`` with sequence_id and offset. It must be a staged table: it is read twice."""
    shards = max(1, cuts.count() // SHARD)
    sharded = cuts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    sizes = sharded.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = staged(sizes.withColumn("before", before), "sizes")
    rules = plan({r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    table = np.array(rules, np.int64).reshape(-1, 5).T
    keys = (table[0] << 44) + table[1]

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            rule = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            nth = rank - table[1][rule]
            sequence, offset = table[3][rule] + nth // table[2][rule], table[4][rule] + nth % table[2][rule] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    order = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = sharded.withColumn("nth", F.row_number().over(order) - 1).join(F.broadcast(sizes) if shards <= 50 else sizes, ["length", "shard"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return mapped(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", SMALL_BATCH)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, kept: int = KEPT) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return best_fit(staged(cut(docs, capacity, tokenizer, kept), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
