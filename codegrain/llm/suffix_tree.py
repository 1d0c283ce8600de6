"""Operator 7, language-model scores by a probabilistic suffix tree.

Symbols are the bytes of the text, A-Z lower-cased, and one end; a document is
padded in front. Runs of DEPTH + 1 symbols of all training documents are counted.
A context, up to DEPTH symbols long, is retained when its next symbols diverge
from those of the context one symbol shorter: its count times the divergence
must reach a threshold. Suffixes of retained contexts are retained. A context's
next-symbol distribution is smoothed towards that of its parent, the empty
context's by a half for each symbol. A symbol is scored by the longest retained
suffix of what stands before it.

A context is looked at from LEAST_COUNT occurrences on, whatever the size of the
corpus, so the tree grows with it. Its upper part, contexts of SHALLOW symbols and
fewer, has 256 ** 3 numbers at most and is computed on the driver. The subtree
below a context one symbol longer has as many numbers at most: the runs that end
alike in that many symbols and their next one meet in one task, which computes
their subtree with numpy and writes each run's score down. Counts are made in
blocks of text, added up by task and shuffled by symbol run or word. Runs of
held-out documents are in these tables too, with a count of 0, so that every run
has its score there.

Documents are scored in blocks of BLOCK bytes: a block asks for its distinct runs,
sorted and dealt to buckets by hash; a bucket answers with scores in the order
asked, and the answers meet the block's texts again, which look each symbol's run
up in a table of their own. The base score needs every word's count, which is
asked for in the same way. Nothing that grows with the corpus is collected or
broadcast.

Defined results: null text is empty and has the end alone; rows without an id
train; with no training rows every count is 0; repeated rows count each; texts
with equal symbols have equal scores; a text longer than a block is a block; an
empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.llm.common import _LOWER, documents, dropped, fold, mapped, mix, pieces, release, staged, utf8, word_hashes

FOLDS, HELD_OUT = 7, 2
DEPTH = 5
#: Least count, and least count times divergence (bits) of a context.
LEAST_COUNT, GAIN = 8, 24.0
#: Contexts of so many symbols and fewer are computed together; longer ones by task.
SHALLOW = 2
#: Bytes of text that are scored together.
BLOCK = 32 << 20
#: Runs of which a task computes the scores, or answers with them, at once, about.
RUNS, ASKED = 500_000, 10_000_000
#: Pseudo-counts that a context takes from its parent.
TRUST = 16.0
_START, _END = 0xFE, 0xFF
#: The end's code among words; codes have 63 bits.
END_WORD = 0x1D8AF066E6F4C3A9
_POSITIVE = np.uint64((1 << 63) - 1)


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All symbols, each document padded in front and ended; and where each document's first symbol is."""
    raw, bounds = utf8(column)
    rows = len(bounds) - 1
    starts = bounds[:-1] + np.arange(rows) * (DEPTH + 1) + DEPTH
    out = np.full(len(raw) + rows * (DEPTH + 1), _START, np.uint8)
    out[np.arange(len(raw)) + np.repeat(starts - bounds[:-1], np.diff(bounds))] = _LOWER[raw]
    out[starts + np.diff(bounds)] = _END
    return out, starts


def _runs(symbols: np.ndarray) -> np.ndarray:
    """The code of each symbol and the DEPTH before it, the symbol itself lowest; runs that end in padding are left out."""
    code = np.zeros(len(symbols) - DEPTH, np.int64)
    for d in range(DEPTH + 1):
        code = code << 8 | symbols[d : len(symbols) - DEPTH + d]
    return code[symbols[DEPTH:] != _START]


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words, and each row's bounds among them."""
    codes, bounds = word_hashes(*utf8(column))
    return (codes & _POSITIVE).view(np.int64), bounds


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _counts(batches):
    """Counts of words (kind 0) and symbol runs (kind 1), merged while they fit and sent on; held-out rows count 0 and give no words."""
    held = ([], []), ([], [])
    size = 0

    def out():
        for kind, (keys, n) in enumerate(held):
            if keys:
                k, c = _added(keys, n)
                for i in range(0, len(k), 100_000):
                    part = k[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part), pa.array(c[i : i + 100_000])], ["kind", "key", "n"])
                keys.clear()
                n.clear()

    for batch in pieces(batches, "text", 2 << 20):
        if "held_out" in batch.schema.names:
            away = batch.filter(batch.column("held_out"))
            batch = batch.filter(pc.invert(batch.column("held_out")))
            if away.num_rows:
                k = np.unique(_runs(_symbols(away.column("text"))[0]))
                held[1][0].append(k)
                held[1][1].append(np.zeros(len(k), np.int64))
                size += len(k)
            if not batch.num_rows:
                continue
        words, _ = _words(batch.column("text"))
        for (keys, n), code in zip(held, (words, _runs(_symbols(batch.column("text"))[0]))):
            k, c = np.unique(code, return_counts=True)
            keys.append(k)
            n.append(c)
            size += len(k)
        keys, n = held[0]
        keys.append(np.array([END_WORD]))
        n.append(np.array([batch.num_rows]))
        if size > 3_000_000:
            yield from out()
            size = 0
    yield from out()


class Tree:
    """Child table and next-symbol scores of the retained contexts: the plain form, for what fits in one process.

    ``child[i, b]`` leads from context i to the one that has b in front of it; a
    missing child leads to i's twin, size + i, which only leads to itself.
    """

    def __init__(self, child: np.ndarray, score: np.ndarray) -> None:
        self.size, self.child, self.score = len(score), child.reshape(-1), score.reshape(-1)

    @classmethod
    def fit(cls, levels: list[tuple[np.ndarray, np.ndarray]], total: int) -> "Tree":
        """From counts of runs, one level for each context length: (code of context and next symbol, count), sorted."""
        base = np.zeros(256)
        code, n = levels[0]
        base[code] = n
        probs = [(base + 0.5) / (total + 128.0)]
        where: dict[int, int] = {1: 0}  # context with a leading 1 byte -> index
        smooth: dict[int, np.ndarray] = {1: probs[0].astype(np.float32)}
        retained: set[int] = set()
        for depth in range(1, len(levels)):
            code, n = levels[depth]
            context = code >> 8
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(code) else []
            for a, b in zip(first, [*first[1:], len(code)]):
                own = int(context[a])
                key, parent = 1 << 8 * depth | own, 1 << 8 * (depth - 1) | own & (1 << 8 * (depth - 1)) - 1
                if parent not in smooth:
                    continue  # the parent is more frequent, so this can't be but for an empty level
                p, symbol, count = smooth[parent].astype(np.float64), code[a:b] & 255, n[a:b]
                now = TRUST * p
                now[symbol] += count
                now /= count.sum() + TRUST
                smooth[key] = now.astype(np.float32)
                if (count * np.log2(now[symbol] / p[symbol])).sum() >= GAIN:
                    while key not in retained and key != 1:
                        retained.add(key)
                        key = 1 << 8 * (d := key.bit_length() // 8 - 1) | key & (1 << 8 * d) - 1
        keys = sorted(retained, key=lambda k: (k.bit_length(), k))
        where |= {k: i + 1 for i, k in enumerate(keys)}
        size = len(where)
        child = np.repeat(np.arange(2 * size, dtype=np.int32) % size + size, 256).reshape(-1, 256)
        for k in keys:
            depth = k.bit_length() // 8
            parent = 1 << 8 * (depth - 1) | k & (1 << 8 * (depth - 1)) - 1
            child[where[parent], k >> 8 * (depth - 1) & 255] = where[k]
        score = np.log10(np.stack([smooth[1], *(smooth[k] for k in keys)]))
        return cls(child, score)

    def scores(self, column: pa.Array) -> np.ndarray:
        """log10 of the probability of each text and its end."""
        symbols, starts = _symbols(column)
        if not len(starts):
            return np.zeros(0)
        at = np.zeros(len(symbols) - DEPTH, np.int32)
        for d in range(1, DEPTH + 1):
            at = self.child[at.astype(np.int64) << 8 | symbols[DEPTH - d : len(symbols) - d]]
        at[at >= self.size] -= self.size
        own = self.score[at.astype(np.int64) << 8 | symbols[DEPTH:]].astype(np.float64)
        own[symbols[DEPTH:] == _START] = 0
        return np.add.reduceat(own, starts - DEPTH)


def _probabilities(key: np.ndarray, n: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smoothed probability of each run's last symbol, NaN where the context is too rare, and whether the context tells.

    Runs are sorted and of one length. ``above``: the probability without the
    first symbol, NaN where that shorter context is too rare already.
    """
    if not len(key):
        return np.zeros(0), np.zeros(0, bool)
    context = key >> 8
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    size = np.diff(np.append(first, len(key)))
    m = np.repeat(np.add.reduceat(n, first), size)
    p = np.where((m >= LEAST_COUNT) & ~np.isnan(above), (n + TRUST * above) / (m + TRUST), np.nan)
    gain = np.where(np.isnan(p) | (n == 0), 0.0, n * np.log2(np.where(np.isnan(p), 1.0, p) / np.where(np.isnan(above), 1.0, above)))
    return p, np.repeat(np.add.reduceat(gain, first) >= GAIN, size)


def _shorter(key: np.ndarray, n: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ends of runs, ``symbols`` long and the next one: sorted, their counts, and each run's place among them."""
    own, at = np.unique(key & ((1 << 8 * (symbols + 1)) - 1), return_inverse=True)
    return own, np.bincount(at, weights=n, minlength=len(own)), at


class Upper:
    """Probabilities of runs with contexts of SHALLOW symbols and fewer, and what remains of them once it is known what is retained below."""

    def __init__(self, key: np.ndarray, n: np.ndarray) -> None:
        self.key = key
        total = n.sum()
        own, m, at = _shorter(key, n, 0)
        self.p, self.tells = [((m + 0.5) / (total + 128.0))[at]], [np.ones(len(key), bool)]
        for d in range(1, SHALLOW + 1):
            own, m, at = _shorter(key, n, d)
            above = np.zeros(len(own))
            above[at] = self.p[-1]
            p, tells = _probabilities(own, m, above)
            self.p.append(p[at])
            self.tells.append(tells[at])

    def scores(self, retained: np.ndarray) -> np.ndarray:
        """log10 of the probability by the longest retained context; ``retained``: the contexts of SHALLOW symbols with a retained longer one."""
        out, below = np.log10(self.p[0]), np.isin(self.key >> 8, retained)
        keep = [below | self.tells[SHALLOW]]
        for d in range(SHALLOW - 1, 0, -1):
            context = self.key >> 8 & (1 << 8 * d) - 1
            keep.insert(0, self.tells[d] | np.isin(context, context[keep[0]]))
        for d, kept in enumerate(keep, 1):
            out = np.where(kept & ~np.isnan(self.p[d]), np.log10(self.p[d]), out)
        return out


def _subtrees(upper_key: np.ndarray, upper_p: np.ndarray, batches):
    """key, score of runs that lie sorted by their last SHALLOW + 1 symbols of context; NaN where no context longer than SHALLOW is retained."""

    def solve(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(key)
        key, n = key[order], n[order].astype(np.float64)
        levels = [_shorter(key, n, d) for d in range(SHALLOW + 1, DEPTH + 1)]
        above = upper_p[np.searchsorted(upper_key, levels[0][0] & (1 << 8 * (SHALLOW + 1)) - 1)]
        p, tells = [], []
        for i, (own, m, _) in enumerate(levels):
            if i:
                above = p[-1][np.searchsorted(levels[i - 1][0], own & (1 << 8 * (SHALLOW + 1 + i)) - 1)]
            one, telling = _probabilities(own, m, above)
            p.append(one)
            tells.append(telling)
        score, longer = np.full(len(key), np.nan), np.zeros(0, np.int64)
        for i in range(len(levels) - 1, -1, -1):
            own, _, at = levels[i]
            context = own >> 8
            kept = tells[i] | np.isin(context, longer)
            longer = np.unique(context[kept] & (1 << 8 * (SHALLOW + i)) - 1)
            found = kept[at] & np.isnan(score)
            score[found] = np.log10(p[i][at][found])
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(score.astype(np.float32))], ["key", "score"])

    key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        key, n = np.concatenate([key, batch.column("key").to_numpy()]), np.concatenate([n, batch.column("n").to_numpy()])
        if len(key) >= RUNS:
            group = _group(key)
            cut = int(np.searchsorted(group, group[-1]))  # the last subtree may go on
            if cut:
                yield solve(key[:cut], n[:cut])
                key, n = key[cut:], n[cut:]
    if len(key):
        yield solve(key, n)


def _group(key):
    return (key >> 8) & (1 << 8 * (SHALLOW + 1)) - 1


def run_scores(runs: DataFrame) -> DataFrame:
    """key, score: log10 of the probability of each run's last symbol, from a staged table of runs (key, n)."""
    end = lambda symbols: F.col("key") % F.lit(1 << 8 * (symbols + 1))
    # Not more than 256 ** (SHALLOW + 1) rows, whatever the corpus.
    table = runs.groupBy(end(SHALLOW).alias("key")).agg(F.sum("n").alias("n")).orderBy("key").toArrow()
    upper = Upper(table.column("key").to_numpy(), table.column("n").to_numpy().astype(np.float64))
    context = runs.sparkSession.sparkContext
    above = context.broadcast((upper.key, upper.p[-1]))
    group = F.shiftright("key", 8) % F.lit(1 << 8 * (SHALLOW + 1))
    sorted_ = runs.select("key", "n").repartition(group).sortWithinPartitions(group)
    deep = staged(mapped(sorted_, lambda batches: _subtrees(*above.value, batches), "key long, score float"), "subtrees")
    # Not more than 256 ** SHALLOW rows.
    below = deep.where(~F.isnan("score")).select((F.shiftright("key", 8) % F.lit(1 << 8 * SHALLOW)).alias("c")).distinct().toArrow().column("c").to_numpy()
    final = context.broadcast((upper.key, upper.scores(below).astype(np.float32)))

    def fill(batches):
        keys, scores = final.value
        for batch in batches:
            key, score = batch.column("key").to_numpy(), batch.column("score").to_numpy()
            at = np.searchsorted(keys, key & (1 << 8 * (SHALLOW + 1)) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.where(np.isnan(score), scores[at], score))], ["key", "score"])

    return mapped(deep, fill, "key long, score float")


def _blocked(batches):
    """The rows with a block's number in front; a block has BLOCK bytes of text at most, or a single row."""
    block, size = TaskContext.get().partitionId() << 32, 0
    for batch in pieces(batches, "text", BLOCK >> 2):
        own = int(utf8(batch.column("text"))[1][-1])
        if size and size + own > BLOCK:
            block, size = block + 1, 0
        size += own
        yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, block)), *batch.columns], ["block", *batch.schema.names])


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _packed(key: np.ndarray) -> bytes:
    """Sorted keys as differences, lowest bytes of all first, so that the many empty high ones compress to nothing."""
    return np.diff(key, prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1).cumsum().astype(np.int64)


def _wanted(column: pa.Array, kind: int) -> np.ndarray:
    """The distinct words (kind 0, the end included) or symbol runs (kind 1) of some texts."""
    return np.unique(np.append(_words(column)[0], END_WORD) if kind == 0 else _runs(_symbols(column)[0]))


def _asked(batches, buckets: int):
    """block, kind, bucket, m, keys: what each block asks for, by bucket, sorted and packed."""
    at, keys = None, ([], [])

    def out():
        for kind, held in enumerate(keys):
            if not held:
                continue
            key = np.unique(np.concatenate(held))
            bucket = _bucket(key, buckets)
            order = np.argsort(bucket, kind="stable")
            key, bucket = key[order], bucket[order]
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            parts = np.split(key, first[1:])
            n = len(parts)
            arrays = [pa.array(np.full(n, at)), pa.array(np.full(n, kind, np.int32)), pa.array(bucket[first]), pa.array([len(p) for p in parts], pa.int64()), pa.array([_packed(p) for p in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["block", "kind", "bucket", "m", "keys"])

    for batch in pieces(batches, "text"):
        blocks = batch.column("block").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
        for a, b in zip(first, [*first[1:], len(blocks)]):
            if blocks[a] != at:
                yield from out()
                at, keys = int(blocks[a]), ([], [])
            for kind, held in enumerate(keys):
                held.append(_wanted(batch.column("text").slice(a, b - a), kind))
                if len(held) == 8:
                    held[:] = [np.unique(np.concatenate(held))]
    yield from out()


def _answers(table: pa.Table, asked: pa.Table) -> pa.Table:
    """block, kind, keys as asked, values of what was asked of a bucket, in the order of the keys; 0 for what it hasn't."""
    key = table.column("key").to_numpy()
    order = np.argsort(key)
    key, value = np.append(key[order], -1), np.append(table.column("value").to_numpy()[order], 0.0)
    found = []
    for x in asked.column("keys"):
        wanted = _unpacked(x.as_py())
        at = np.searchsorted(key[:-1], wanted)
        found.append(np.where(key[at] == wanted, value[at], 0.0).astype("<f8").tobytes())
    return pa.table({"block": asked.column("block"), "kind": asked.column("kind"), "keys": asked.column("keys"), "values": pa.array(found, pa.binary())})


def _answered(rows: DataFrame, table: DataFrame) -> DataFrame:
    """block, kind, keys, values: the answers to all blocks of ``rows`` from the staged ``table`` (kind, key, value)."""
    spark = rows.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), table.count() // RUNS)
    asked = staged(mapped(rows.select("block", "text"), lambda batches: _asked(batches, buckets), "block long, kind int, bucket long, m long, keys binary"), "asked")
    # So many parts of a bucket that a part is asked for ASKED keys, about.
    salts = 1 + (asked.agg(F.sum("m")).first()[0] or 0) // buckets // ASKED

    def dealt(batches):
        for batch in batches:
            bucket = _bucket(batch.column("key").to_numpy(), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], ["bucket", *batch.schema.names])

    own = mapped(table.select("kind", "key", "value"), dealt, "bucket long, kind int, key long, value double").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    by = ("kind", "bucket", "salt")
    return own.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(_answers, "block long, kind int, keys binary, values binary")


class Scores:
    """A table of values by key with open addressing: a look-up touches a slot or two instead of a search through all keys."""

    def __init__(self, key: np.ndarray, score: np.ndarray) -> None:
        bits = max(8, int(4 * len(key)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.score = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            at = slot[left]
            free = self.key[at] < 0
            self.key[at[free]] = key[left[free]]  # of keys with one slot the last stays
            mine = free & (self.key[at] == key[left])
            self.score[at[mine]] = score[left[mine]]
            left = left[~mine]
            slot[left] = (slot[left] + 1) & self.last

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def of(self, key: np.ndarray) -> np.ndarray:
        """The values of keys that the table has."""
        slot = self._slot(key)
        missed = np.flatnonzero(self.key[slot] != key)
        while len(missed):
            slot[missed] = (slot[missed] + 1) & self.last
            missed = missed[self.key[slot[missed]] != key[missed]]
        return self.score[slot]


def _sums(column: pa.Array, scores: Scores) -> np.ndarray:
    """The sum of each text's run scores."""
    symbols, starts = _symbols(column)
    own = np.zeros(len(symbols) - DEPTH)
    own[symbols[DEPTH:] != _START] = scores.of(_runs(symbols))
    return np.add.reduceat(own, starts - DEPTH)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double"


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col, folds) == held_out).alias("held_out"), F.col(text_col).alias("text"))
    rows = staged(mapped(rows, _blocked, "block long, doc_id long, held_out boolean, text string"), "blocks", "zstd")
    counts = mapped(rows.select("held_out", "text"), _counts, "kind int, key long, n long")
    counts = staged(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = counts.where("kind = 0").select("key", "n")
    n_words, n_tokens = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    scores = run_scores(counts.where("kind = 1").select("key", "n"))
    table = words.select(F.lit(0).alias("kind"), "key", F.col("n").cast("double").alias("value")).union(scores.select(F.lit(1), "key", F.col("score").cast("double")))
    table = staged(table, "values")
    dropped(counts, scores)
    answers = _answered(rows, table)
    kinds = dict(zip(_SCORED.replace(",", "").split()[::2], (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())))

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        tables = []
        for kind in (0, 1):
            own = found.filter(pc.equal(found.column("kind"), kind))
            key = np.concatenate([np.zeros(0, np.int64), *(_unpacked(x.as_py()) for x in own.column("keys"))])
            tables.append(Scores(key, np.frombuffer(b"".join(x.as_py() for x in own.column("values")), "<f8")))
        done = list(scored_batches(texts.to_batches(), *tables))
        del tables
        release()
        return pa.Table.from_batches(done) if done else pa.table({c: pa.array([], t) for c, t in kinds.items()})

    def scored_batches(batches, word_counts, scores):
        end = word_counts.of(np.array([END_WORD]))[0]
        for batch in pieces(batches, "text"):
            codes, bounds = _words(batch.column("text"))
            count = word_counts.of(codes)
            n = np.diff(bounds) + 1
            known, value = np.full(len(n), int(end > 0)), np.full(len(n), np.log10(end + 1.0))
            full = np.flatnonzero(n > 1)
            if len(full):
                value[full] += np.add.reduceat(np.log10(count + 1.0), bounds[:-1][full])
                known[full] += np.add.reduceat((count > 0).astype(np.int64), bounds[:-1][full])
            score = _sums(batch.column("text"), scores)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *map(pa.array, (n, known, value, score))], list(kinds))

    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _SCORED)
    share = float(np.log10(n_tokens + n_words + 1))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.lit(share)).alias("base_score"), "score"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
