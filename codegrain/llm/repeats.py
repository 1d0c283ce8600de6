"""Operator 10, removal of repeated passages: strings of 400 bytes that start more than once.

Equal passages are brought together first. Of every 400 bytes in a row the
32-byte window with the smallest hash is the anchor, so equal strings have equal
anchors at equal places. Anchors that occur once can't be in a repeated string
and are dropped; around the others the bytes of all strings that have them are
cut out, at most 768 for each anchor, and dealt out by the anchor.

There the strings of a task are sorted by column-wise multi-document
construction: the sequences, aligned at their anchors, lie in columns that are
read once from the last to the first; a task has a bounded number of them, so
they stay in its memory instead of a file. A round inserts one symbol
in front of every sequence's suffix; the order of all suffixes after it follows
from the order before it and the symbols inserted (the Burrows-Wheeler column),
and so do the common prefixes of neighbours: one more than the least between two
suffixes that get the same symbol. A suffix that has 400 bytes in common with a
neighbour starts a repeated string.

Method as named, but for one change: the construction is applied to the aligned
sequences of each anchor, up to 768 symbols long, rather than to whole
documents. Inserting one symbol of each document a round takes as many rounds as
the longest document has bytes, each over the whole transform so far, which for
texts of 100,000 bytes and more can't be done in any useful time; README has
figures.

The same rounds find shorter strings too, of SHORT bytes, which have anchors of
their own: a run of them with PASSAGE_WORDS words and more is a repeated passage.
These are counted, not removed, as a passage of 50 words may have under 400
bytes.

A text that repeats a short period has an anchor in every period; such anchors
are one row each period's length, and of equal sequences of a text one is cut.
Candidates and spans grow with the corpus, so they meet their texts by a shuffle
whatever their size. The anchors' table is joined with those that occur twice, so
that an anchor of a third of all texts is split among tasks like any skewed join.

An anchor of more than HOT sequences isn't dealt to one task: of its sequences
every string is fingerprinted with 128 bits and counted, which adds up before it
is shuffled. With 10**12 different strings, the chance of one false repeat is
about 10**-15.

Defined results: null text is empty; texts under 400 bytes keep everything;
repeated rows are documents of their own, so they repeat each other; null ids
too; a text of any length is one row; an empty table gives an empty result;
other columns are never looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.llm.common import _BYTE, _powers, documents, dropped, mapped, mix, pieces, staged, utf8

LENGTH = 400
GRAM = 32
#: Bytes of a shorter string, and words of a passage made of such.
SHORT, PASSAGE_WORDS = 200, 50
#: Sequences of an anchor that one task sorts at most.
HOT = 50_000


def _fingerprints(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit code of every ``size`` bytes in a row."""
    up, down = _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: len(raw) - size + 1])


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w values in a row, from least values before and behind the ends of blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    fore = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], fore[w - 1 : n])


def _chosen(code: np.ndarray, bounds: np.ndarray, size: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every string of ``length`` bytes within a row its anchor: place, first and last start of the strings that share it."""
    none = np.zeros(0, np.int64)
    if size < length:
        return none, none, none
    bits = np.uint64(max(24, int(size).bit_length()))
    key = code >> bits << bits | np.arange(len(code), dtype=np.uint64)
    least = _sliding_least(key, length - gram + 1)
    whole = np.zeros(len(least) + 1, np.int64)
    long = np.diff(bounds) >= length
    np.add.at(whole, bounds[:-1][long], 1)
    np.add.at(whole, bounds[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(whole[:-1]) > 0)
    if not len(starts):
        return none, none, none
    place = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return place[new], starts[new], starts[np.append(new[1:], len(starts)) - 1]


def anchors(raw: np.ndarray, bounds: np.ndarray, length: int, short: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of the strings of ``short`` and of ``length`` bytes, in order: code, place, first byte and end of all strings that share it.

    The least of a longer string is the least of a shorter one around it, so
    anchors of the longer strings are among those of the shorter, and their
    bytes include the others'.
    """
    none = np.zeros(0, np.int64)
    if len(raw) < short:
        return none, none, none, none
    code = _fingerprints(raw, gram)
    place, first, last = _chosen(code, bounds, len(raw), short, gram)
    end = last + short
    far, far_first, far_last = _chosen(code, bounds, len(raw), length, gram)
    at = np.searchsorted(place, far)
    first[at], end[at] = far_first, far_last + length
    return code[place].view(np.int64), place, first, end


_FOUND = "k long, code long, place long, first long, end long, step long, times long"


def _find(length: int, short: int, gram: int):
    """Anchors by row; of anchors of one code that follow each other at equal distances, with as many bytes around them, the first with step and times."""

    def run(batches):
        for batch in pieces(batches, "text"):
            raw, bounds = utf8(batch.column("text"))
            code, place, first, end = anchors(raw, bounds, length, short, gram)
            row = np.searchsorted(bounds, first, side="right") - 1
            step = np.diff(place, append=0)
            # Whether an anchor is followed by one like it, and continues a run.
            like = np.zeros(len(code), bool)
            like[:-1] = (code[1:] == code[:-1]) & (row[1:] == row[:-1]) & (np.diff(first) == step[:-1]) & (np.diff(end) == step[:-1])
            goes = np.zeros(len(code), bool)
            goes[1:] = like[:-1]
            goes[2:] &= ~like[:-2] | (step[1:-1] == step[:-2])
            head = np.flatnonzero(~goes)
            times = np.diff(np.append(head, len(code)))
            base = bounds[row[head]]
            columns = [code[head], *[x[head] - base for x in (place, first, end)], np.where(times > 1, step[head], 0), times]
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(row[head])), *[pa.array(x.astype(np.int64)) for x in columns]], _FOUND.replace(",", "").split()[::2])

    return run


_SEQUENCES = "code long, k long, firsts array<long>, before int, bytes binary"


def _cut(batches):
    """The bytes around the anchors that rows have; of a row's equal sequences one, with the places of all."""
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary())
    for batch in pieces(batches, "text", 1 << 20):
        raw, bounds = utf8(batch.column("text"))
        data, out, size = raw.tobytes(), {}, 0
        for base, k, listed in zip(bounds.tolist(), batch.column("k").to_pylist(), batch.column("found").to_pylist()):
            for x in listed:
                for i in range(x["times"]):
                    at = x["first"] + i * x["step"]
                    key = (x["code"], k, x["place"] - x["first"], data[base + at : base + at + x["end"] - x["first"]])
                    if key not in out:
                        out[key] = []
                        size += len(key[3])
                    out[key].append(at)
            if size > 4 << 20:
                yield _sequences(out, kinds)
                out, size = {}, 0
        if out:
            yield _sequences(out, kinds)


def _sequences(out: dict, kinds) -> pa.RecordBatch:
    columns = [[c for c, *_ in out], [k for _, k, *_ in out], list(out.values()), [b for _, _, b, _ in out], [s for *_, s in out]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["code", "k", "firsts", "before", "bytes"])


def repeated_starts(group: np.ndarray, before: np.ndarray, sequences: list[bytes], lengths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of ``lengths`` (sequence, start) of strings of so many bytes that another sequence of the group has at the same distance from its anchor.

    ``before``: bytes of each sequence before its anchor. Groups must be contiguous.
    """
    m = len(sequences)
    left = int(before.max())
    sizes = np.array([len(s) for s in sequences])
    right = int((sizes - before).max())
    width = left + right
    columns = np.zeros((width, m), np.uint8)
    lo = left - before
    for step in range(0, m, 4096):
        part = np.zeros((min(4096, m - step), width), np.uint8)
        for i in range(len(part)):
            s = step + i
            part[i, lo[s] : lo[s] + sizes[s]] = np.frombuffer(sequences[s], np.uint8)
        columns[:, step : step + len(part)] = part.T
    hi = lo + sizes
    order, common = np.arange(m), np.zeros(m, np.int64)
    found: list[list] = [[] for _ in lengths]
    for c in range(width - 1, -1, -1):
        symbol = columns[c][order].astype(np.int64)
        symbol[(hi[order] <= c) | (lo[order] > c)] = -1  # before its end, or past its start: no suffix here
        key = group[order] * 257 + symbol
        rank = np.argsort(key, kind="stable")
        key = key[rank]
        same = np.zeros(m, bool)
        same[1:] = (key[1:] == key[:-1]) & (symbol[rank[1:]] >= 0)
        now = np.zeros(m, np.int64)
        here = np.flatnonzero(same)
        a, b = rank[here - 1], rank[here]
        near = b == a + 1
        now[here[near]] = common[b[near]] + 1
        far = ~near
        if far.any():
            pairs = np.stack([a[far] + 1, b[far] + 1], axis=1).reshape(-1)
            padded = np.append(common, np.iinfo(np.int64).max)
            now[here[far]] = np.minimum.reduceat(padded, pairs)[::2] + 1
        order, common = order[rank], now
        if c <= left:
            for own, length in zip(found, lengths):
                twice = common >= length
                if twice.any():
                    twice[:-1] |= twice[1:]
                    hit = order[twice]
                    own.append((hit, c - lo[hit]))
    none = np.zeros(0, np.int64)
    return [tuple(np.concatenate([none, *(x[i] for x in own)]) for i in (0, 1)) for own in found]


def _spans(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts: row, first, last."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])) if len(row) else np.zeros(0, np.int64)
    return row[new], start[new], start[np.append(new[1:], len(start)) - 1] if len(row) else start


_SPAN = "k long, length int, first long, end long"


def _spread(k: np.ndarray, firsts: list[list[int]], at: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> tuple[list, list, list]:
    """k, first, end of the strings that start at a to b of the sequences ``at``, wherever these lie; what touches within a sequence's places is one."""
    ks, begins, ends = [], [], []
    for i, x, y in zip(at.tolist(), a.tolist(), b.tolist()):
        last = None
        for f in firsts[i]:
            if last is not None and f + x <= last:
                last = ends[-1] = max(last, f + y + length)
                continue
            ks.append(int(k[i]))
            begins.append(f + x)
            ends.append(last := f + y + length)
    return ks, begins, ends


def _span_batch(parts: list[tuple[int, tuple[list, list, list]]]) -> pa.RecordBatch:
    columns = [sum((p[i] for _, p in parts), []) for i in range(3)]
    lengths = [n for n, p in parts for _ in p[0]]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(lengths, pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["k", "length", "first", "end"])


def _many(firsts: list[list[int]], sequences: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sequences that lie at several places all strings: sequence, first start, last start."""
    at = np.array([i for i, f in enumerate(firsts) if len(f) > 1 and len(sequences[i]) >= length], np.int64)
    return at, np.zeros(len(at), np.int64), np.array([len(sequences[i]) - length for i in at], np.int64)


def _sort(lengths: tuple[int, ...], at_once: int = 30_000):
    """Takes rows sorted by anchor; whole anchors are gathered up to ``at_once`` sequences."""

    def solve(code, k, before, firsts, seqs):
        # Equal sequences of different rows are one that lies at several places.
        _, group = np.unique(code, return_inverse=True)
        of: dict[tuple, int] = {}
        one = np.array([of.setdefault((int(g), int(b), s), len(of)) for g, b, s in zip(group, before, seqs)], np.int64)
        own_group, own_before, own_seqs = np.array([x[0] for x in of]), np.array([x[1] for x in of]), [x[2] for x in of]
        order = np.argsort(own_group, kind="stable")
        found = repeated_starts(own_group[order], own_before[order], [own_seqs[i] for i in order], lengths)
        held = np.bincount(one, minlength=len(of)) > 1
        rows_of = np.argsort(one, kind="stable")
        bounds = np.searchsorted(one[rows_of], np.arange(len(of) + 1))
        parts = []
        for length, (row, start) in zip(lengths, found):
            row, a, b = _spans(order[row], start)
            alone = ~held[row]  # sequences of several rows are repeated as a whole
            row, a, b = row[alone], a[alone], b[alone]
            n = bounds[row + 1] - bounds[row]
            at = np.concatenate([rows_of[bounds[r] : bounds[r + 1]] for r in row]) if len(row) else row
            parts.append((length, _spread(k, firsts, at, np.repeat(a, n), np.repeat(b, n), length)))
            whole = np.array([i for i in np.flatnonzero(held[one]) if len(seqs[i]) >= length], np.int64)
            parts.append((length, _spread(k, firsts, whole, np.zeros(len(whole), np.int64), np.array([len(seqs[i]) - length for i in whole], np.int64), length)))
            parts.append((length, _spread(k, firsts, *_many(firsts, seqs, length), length)))
        return _span_batch(parts)

    def run(batches):
        held, firsts, seqs = [np.zeros(0, np.int64)] * 3, [], []
        for batch in batches:
            held = [np.concatenate([h, batch.column(c).to_numpy().astype(np.int64)]) for h, c in zip(held, ("code", "k", "before"))]
            firsts += batch.column("firsts").to_pylist()
            seqs += batch.column("bytes").to_pylist()
            if len(held[0]) >= at_once:
                cut = int(np.searchsorted(held[0], held[0][-1]))  # the last anchor may go on
                if cut:
                    yield solve(*[h[:cut] for h in held], firsts[:cut], seqs[:cut])
                    held, firsts, seqs = [h[cut:] for h in held], firsts[cut:], seqs[cut:]
        if len(held[0]):
            yield solve(*held, firsts, seqs)

    return run


def _prints(lengths: tuple[int, ...]):
    """Of sequences of hot anchors every string's distance from the anchor and 128-bit fingerprint; weight 2 if the sequence lies at several places."""

    def run(batches):
        for batch in batches:
            for code, k, firsts, before, data in zip(*(batch.column(c).to_pylist() for c in ("code", "k", "firsts", "before", "bytes"))):
                raw = np.frombuffer(data, np.uint8)
                for length in lengths:
                    if len(raw) < length:
                        continue
                    one, two = _fingerprints(raw, length), _fingerprints(_LOW[raw], length)
                    n = len(one)
                    columns = [np.full(n, code), np.full(n, k), firsts[0] + np.arange(n), np.arange(n) - before, one.view(np.int64), two.view(np.int64), np.full(n, min(2, len(firsts)))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, length, np.int32)), *map(pa.array, columns)], ["length", "code", "k", "start", "at", "p", "q", "weight"])

    return run


def _placed(lengths: tuple[int, ...]):
    """The strings of sequences that lie at several places of their row."""

    def run(batches):
        for batch in batches:
            k, firsts, seqs = batch.column("k").to_numpy(), batch.column("firsts").to_pylist(), batch.column("bytes").to_pylist()
            yield _span_batch([(n, _spread(k, firsts, *_many(firsts, seqs, n), n)) for n in lengths])

    return run


#: Another order of the bytes, for a second code.
_LOW = np.random.Generator(np.random.PCG64(5)).permutation(256).astype(np.uint8)


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, short: int = SHORT) -> DataFrame:
    """k, spans: array of (length, first, end), stretches of repeated strings of either length, for rows (k, text) with distinct k."""
    found = staged(mapped(rows, _find(length, short, gram), _FOUND), "anchors", "zstd")
    often = staged(found.groupBy("code").agg(F.sum("times").alias("n")).where("n > 1"), "often")
    per_row = found.join(often, "code").groupBy("k").agg(F.collect_list(F.struct("code", "place", "first", "end", "step", "times")).alias("found"))
    per_row = staged(per_row, "candidates")
    hot_codes = staged(often.where(F.col("n") > hot).select("code"), "hot")
    dropped(found, often)
    cut = mapped(rows.join(per_row, "k").select("k", "text", "found"), _cut, _SEQUENCES)
    lengths = (length, short)
    if hot_codes.isEmpty():
        cold, spans = cut, None
    else:
        # Their number is bounded: the anchors of all rows divided by ``hot``.
        cut = staged(cut, "sequences")
        sequences = cut.join(hot_codes, "code", "left_semi")
        prints = staged(mapped(sequences, _prints(lengths), "length int, code long, k long, start long, at long, p long, q long, weight long"), "prints")
        key = ["length", "code", "at", "p", "q"]
        twice = staged(prints.groupBy(*key).agg(F.sum("weight").alias("n")).where("n > 1").drop("n"), "twice")
        spans = prints.join(twice, key).select("k", "length", F.col("start").alias("first"), (F.col("start") + F.col("length")).alias("end"))
        spans = spans.unionByName(mapped(sequences, _placed(lengths), _SPAN))
        cold = cut.join(hot_codes, "code", "left_anti")
    sorted_ = mapped(cold.repartition("code").sortWithinPartitions("code"), _sort(lengths), _SPAN)
    spans = sorted_ if spans is None else sorted_.unionByName(spans)
    return staged(spans.groupBy("k").agg(F.collect_list(F.struct("length", "first", "end")).alias("spans")), "spans")


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


def _remove(length: int, words: int):
    def run(batches):
        for batch in pieces(batches, "text"):
            raw, bounds = utf8(batch.column("text"))
            data, cols = raw.tobytes(), [[], [], [], [], [], []]
            for a, b, spans in zip(bounds[:-1].tolist(), bounds[1:].tolist(), batch.column("spans").to_pylist()):
                gone = _merged([(x["first"], x["end"]) for x in spans or () if x["length"] == length])
                passages = sum(len(data[a + x : a + y].split()) >= words for x, y in _merged([(x["first"], x["end"]) for x in spans or ()]))
                at, kept = a, []
                for first, end in gone:
                    kept.append(data[at : a + first])
                    at = a + end
                kept = b"".join([*kept, data[at:b]])
                for col, x in zip(cols, (b - a, b - a - len(kept), len(gone), passages, hashlib.sha256(kept).hexdigest(), kept)):
                    col.append(x)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "n_passages", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string()), pa.array(cols[5], pa.binary())], names)

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, short: int = SHORT, words: int = PASSAGE_WORDS
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, n_passages (long), kept_sha256 (string), kept (the bytes left).

    n_passages counts the longest stretches of repeated strings of ``short``
    bytes (at most ``length``, at least ``gram``) that have ``words`` words and more.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if rows.select("doc_id").where("doc_id is null").isEmpty() and rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = rows.withColumn("k", F.col("doc_id"))
    else:  # rows get numbers of their own, written down so that they stay
        rows = staged(rows.withColumn("k", F.monotonically_increasing_id()), "numbered")
    spans = repeated_spans(rows.select("k", "text"), length, gram, hot, short)
    both = rows.join(spans, "k", "left").select("doc_id", "text", "spans")
    return mapped(both, _remove(length, words), "doc_id long, n_bytes long, n_removed long, n_spans long, n_passages long, kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")
