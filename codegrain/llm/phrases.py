"""Operator 12, collocations: phrases of two and three words that occur more often than their parts suggest.

1. tries(): a task takes shards of text and builds, for each, a count trie of
   depth three below the languages, level by level: a node is its parent's
   number and a word's number, so that counting is sorting numbers. The sorted
   nodes are serialised in blocks of BLOCK nodes, each with the words it uses.
2. ranges(): bounds that cut all nodes into ranges of about RANGE nodes are
   chosen among nodes drawn at random, one in each block, which only decides how
   work is dealt. (Blocks' first nodes won't do: shards alike have them at the same
   places, and nothing would cut what lies between.) Every block is cut at the
   bounds that fall into it. A range also gets the counts of the two nodes above
   its bound, wherever they lie, so that walks need no other range.
3. merge(): a range's sorted runs are merged, equal nodes added up. A walk down
   the merged trie gives each node the counts of its left parts, which are its
   parents; nodes below the least count go, as no phrase with them can stay.
4. scored(): suffix links, from a node to that of its words without the first,
   are joins: a phrase of two words finds its last one, a phrase of three its
   last two, which have found theirs.

Counts are exact: words are told apart by their bytes, nothing is hashed, and
scores are decimals and whole division.

At scale: a range has about RANGE nodes whatever the corpus, as some 32 drawn nodes
fall into each; a node that every shard has costs one number for each shard. The
bounds, one for each range, are sent to the tasks. Every shard has a piece of nearly
every range, so that pieces grow with the square of the corpus. The joins have the
counted phrases alone; a word that very many phrases end in is salted. They are
sort-merge joins at every size: a broadcast would be chosen by a staged table's bytes,
of which its rows, salted or spread, have a hundred times as many in the driver.

Defined results: a null text has no words, a null language is ``und``; a text of
any length is cut into stretches that overlap by two words, so nothing is lost
between them; equal scores and counts are ordered by the phrase's bytes;
repeated rows count severally; an empty table gives an empty table; other
columns are never looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codegrain.llm.common import SMALL_BATCH, documents, mapped, pieces, release, staged, utf8

LEAST, TOP, WITHIN = 10, 2000, 50
#: Bytes of a shard; nodes of a block; nodes of a range; words of a stretch's overlap.
SHARD, BLOCK, RANGE, OVERLAP = 5 << 20, 1 << 16, 2 << 20, 2
#: Drawn nodes that bounds are chosen from, about, at most, and bytes of one at most.
DRAWN, KEY_BYTES = 1 << 20, 256
#: Bits of a key that numbers of fixed size can hold.
KEY_BITS = 64
#: Parts that the phrases ending in one word are dealt to.
SALTS = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True

# ---------------------------------------------------------------- blocks of nodes


class Nodes:
    """Sorted trie nodes: a language's and three words' numbers into sorted lists (0 is no word), and counts."""

    def __init__(self, langs: pa.Array, words: pa.Array, lang: np.ndarray, w: np.ndarray, n: np.ndarray) -> None:
        self.langs, self.words, self.lang, self.w, self.n = langs, words, lang, w, n

    def __len__(self) -> int:
        return len(self.n)

    def part(self, i: int, j: int) -> "Nodes":
        return Nodes(self.langs, self.words, self.lang[i:j], self.w[:, i:j], self.n[i:j])

    def key(self, i: int) -> tuple[str, str, str, str]:
        """Language and words as texts; '' for no word."""
        return (self.langs[int(self.lang[i])].as_py(), *[self.words[int(x) - 1].as_py() if x else "" for x in self.w[:, i]])

    def place(self, key: tuple) -> int:
        """The first node at ``key`` or behind it."""
        want, lo, hi = _bytes(key), 0, len(self)
        while lo < hi:
            mid = (lo + hi) // 2
            if _bytes(self.key(mid)) < want:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def dump(self) -> bytes:
        """Only the words that the nodes use, then the numbers in as few bytes as they need, compressed."""
        flags = np.zeros(len(self.words) + 1, bool)
        flags[self.w] = True
        flags[0] = False
        used, w = np.flatnonzero(flags), np.cumsum(flags, dtype=np.uint32)[self.w]
        lang = self.lang.astype(np.uint32)
        size = min(8, max(1, (int(self.n.max(initial=0)).bit_length() + 7) // 8))
        count = self.n.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]
        batch = pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in ((self.langs.to_pylist(), pa.list_(pa.string())), (lang.tobytes(), pa.binary()), (w.astype("<u4").tobytes(), pa.binary()), (count.tobytes(), pa.binary()))] + [pa.LargeListArray.from_arrays(pa.array([0, len(used)], pa.int64()), self.words.take(pa.array(used - 1)))],
            ["langs", "lang", "w", "n", "words"],
        )
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def load(raw, fields: tuple[str, ...] | None = None) -> "Nodes":
        """Nodes from their bytes; of the fields that aren't asked for nothing is unpacked."""
        names = ("langs", "lang", "w", "n", "words")
        wanted = [names.index(f) for f in fields or names]
        with pa.ipc.open_stream(raw, options=pa.ipc.IpcReadOptions(included_fields=wanted, use_threads=False)) as stream:
            batch = stream.read_next_batch()
        get = lambda f: batch.column(f)[0] if f in batch.schema.names else None
        langs, lang, w, n = map(get, names[:4])
        numbers = (None,) * 3
        if lang is not None:
            lang = np.frombuffer(lang.as_buffer(), "<u4")
            wide = np.zeros((len(lang), 8), np.uint8)
            if len(lang):
                few = np.frombuffer(n.as_buffer(), np.uint8).reshape(len(lang), -1)
                wide[:, : few.shape[1]] = few
            numbers = lang, np.frombuffer(w.as_buffer(), "<u4").reshape(3, -1), wide.view("<u8").ravel().astype(np.int64)
        return Nodes(langs and langs.values, batch.column("words").flatten() if "words" in batch.schema.names else None, *numbers)


def _bytes(key: tuple) -> tuple:
    return tuple(x.encode() for x in key)


# ---------------------------------------------------------------- shards


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their number for each key, in 32 bits."""
    by = np.argsort(keys).astype(np.uint32)
    keys = keys[by]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    at = np.empty(len(keys), np.int32)
    at[by] = np.cumsum(fresh, dtype=np.int32) - 1
    return keys[fresh], at


def shard_nodes(stretches: list[tuple[str, np.ndarray, int]]) -> Nodes:
    """The trie of some stretches of text: (language, bytes, leading words that an earlier stretch has counted)."""
    langs = sorted({s[0] for s in stretches}, key=str.encode)
    number = {x: i for i, x in enumerate(langs)}
    raw = _LOWER[np.concatenate([x for _, part, _ in stretches for x in (part, np.array([10], np.uint8))])]
    bounds = np.cumsum([0, *[len(part) + 1 for _, part, _ in stretches]])
    solid = ~_GAP[raw]
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    of = (np.searchsorted(bounds, begin, side="right") - 1).astype(np.int32)
    piece = np.searchsorted(np.flatnonzero(_BREAK[raw]), begin).astype(np.int32)
    first = np.searchsorted(begin, bounds[:-1])
    fresh = np.arange(len(begin)) - first[of] >= np.array([s[2] for s in stretches], np.int64)[of]
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(end - begin)])
    coded = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(raw[solid])).dictionary_encode()
    del raw, solid, starts, ends, offsets, end, first
    order = pc.sort_indices(coded.dictionary).to_numpy()
    words = coded.dictionary.take(pa.array(order))
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    w = rank[coded.indices.to_numpy()]
    lang = np.array([number[s[0]] for s in stretches], np.uint32)[of]
    del begin, of, coded
    shift = np.uint64(32)

    joined = lambda up, word: up.astype(np.uint64) << shift | word
    k1, at1 = _distinct(joined(lang, w))
    del lang
    n1 = np.bincount(at1[fresh], minlength=len(k1))
    go = piece[1:] == piece[:-1]
    del piece
    i2 = np.flatnonzero(go).astype(np.int32)
    k2, at2 = _distinct(joined(at1[i2], w[i2 + 1]))
    del at1
    n2 = np.bincount(at2[fresh[i2 + 1]], minlength=len(k2))
    node2 = np.zeros(len(w), np.int32)
    node2[i2] = at2
    del i2, at2
    i3 = np.flatnonzero(go[:-1] & go[1:]).astype(np.int32)
    k3, at3 = _distinct(joined(node2[i3], w[i3 + 2]))
    n3 = np.bincount(at3[fresh[i3 + 2]], minlength=len(k3))

    del at3, node2, i3, w, go, fresh
    # Each node's place: its own level's nodes before it, and those of the other levels. What a level needs goes before the next.
    total = len(k1) + len(k2) + len(k3)
    out = Nodes(pa.array(langs, pa.string()), words, np.empty(total, np.uint32), np.zeros((3, total), np.uint32), np.empty(total, np.int64))
    low = lambda k: (k & np.uint64(0xFFFFFFFF)).astype(np.uint32) + np.uint32(1)
    up2, up3 = (k2 >> shift).astype(np.int32), (k3 >> shift).astype(np.int32)
    l1, w1, w2, w3 = (k1 >> shift).astype(np.uint32), low(k1), low(k2), low(k3)
    del k1, k2, k3
    top3 = up2[up3] if len(up3) else up3
    own = lambda n: np.arange(len(n), dtype=np.int32)
    place = own(n3) + up3 + top3 + 2
    out.lang[place], out.w[0, place], out.w[1, place], out.w[2, place], out.n[place] = l1[top3], w1[top3], w2[up3], w3, n3
    del w3, n3
    place = own(n2) + up2 + 1 + np.searchsorted(up3, own(n2)).astype(np.int32)
    out.lang[place], out.w[0, place], out.w[1, place], out.n[place] = l1[up2], w1[up2], w2, n2
    del w2, n2
    place = own(n1) + np.searchsorted(up2, own(n1)).astype(np.int32) + np.searchsorted(top3, own(n1)).astype(np.int32)
    out.lang[place], out.w[0, place], out.n[place] = l1, w1, n1
    return out


def _last_words(raw: np.ndarray, end: int) -> tuple[int, int]:
    """Where the last OVERLAP words before ``end`` begin, and how many there are."""
    step = 1 << 12
    while True:
        low = max(0, end - step)
        solid = ~_GAP[raw[low:end]]
        starts = solid.copy()
        starts[1:] &= ~solid[:-1]
        if low:
            starts[0] = False  # it may have begun before
        found = np.flatnonzero(starts)
        if len(found) >= OVERLAP or not low:
            found = found[-OVERLAP:]
            return (low + int(found[0]), len(found)) if len(found) else (end, 0)
        step *= 4


def _stretches(lang: str, raw: np.ndarray, most: int):
    """Stretches of a text of about ``most`` bytes, cut before a gap; each begins with the last words of the one before it, which are not counted again."""
    at = old = done = 0
    while True:
        end, look, step = len(raw), done + most, 1 << 12
        while look < len(raw):
            gaps = np.flatnonzero(_GAP[raw[look : look + step]])
            if len(gaps):
                end = look + int(gaps[0])
                break
            look, step = look + step, 4 * step
        yield lang, raw[at:end], old
        if end == len(raw):
            return
        done = end
        at, old = _last_words(raw, end)


def tries(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The serialised tries of all shards: n (nodes), lang, w1, w2, w3 (a node of a block, drawn at random) and block."""

    def rows(stretches, draw):
        nodes = shard_nodes(stretches)
        for i in range(0, len(nodes), block):
            part = nodes.part(i, min(i + block, len(nodes)))
            cols = [[len(part)], *[[x] for x in part.key(int(draw.integers(len(part))))], [part.dump()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), *[pa.string()] * 4, pa.binary()))], ["n", "lang", "w1", "w2", "w3", "block"])

    def run(batches):
        held, size, draw = [], 0, np.random.default_rng(TaskContext.get().partitionId())
        for batch in pieces(batches, "text"):
            raw, bounds = utf8(batch.column("text"))
            for lang, a, b in zip(batch.column("lang").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                for stretch in _stretches(lang, raw[a:b], shard):
                    if held and size + len(stretch[1]) > shard:
                        yield from rows(held, draw)
                        held, size = [], 0
                    held.append(stretch)
                    size += len(stretch[1]) + 1
        if held:
            yield from rows(held, draw)

    return mapped(docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), run, "n long, lang string, w1 string, w2 string, w3 string, block binary", SMALL_BATCH)


# ---------------------------------------------------------------- merging


def bounds(blocks: DataFrame, nodes: int = RANGE) -> list[tuple[str, str, str, str]]:
    """First nodes of ranges of about ``nodes`` nodes, the first range's left out; from the blocks' drawn nodes, or some DRAWN of them. A drawn node stands for its block's number of nodes."""
    n_blocks, total = blocks.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_ranges = -(-total // nodes)
    if n_ranges < 2:
        return []
    key = ["lang", "w1", "w2", "w3"]
    drawn = blocks.select(*key, "n").where(F.octet_length(F.concat(*key)) <= KEY_BYTES)
    if n_blocks > DRAWN:
        drawn = drawn.sample(DRAWN / n_blocks, 7)
    drawn = drawn.toArrow().sort_by([(k, "ascending") for k in key])
    if not len(drawn):
        return []
    reached = np.cumsum(drawn.column("n").to_numpy())
    at = np.searchsorted(reached, np.arange(1, n_ranges) * (int(reached[-1]) / n_ranges))
    chosen = drawn.select(key).take(pa.array(np.unique(at))).to_pylist()
    return list(dict.fromkeys(tuple(c[k] for k in key) for c in chosen))


def ranges(blocks: DataFrame, cuts: list[tuple[str, str, str, str]]) -> DataFrame:
    """Blocks cut at the bounds: part (the range) and block; and without a block, lang, w1, w2 and n of nodes above a range's bound, for walks alone."""
    sorted_cuts = [_bytes(c) for c in cuts]
    above: dict[tuple, list[int]] = {}
    for part, cut in enumerate(cuts, 1):
        for depth in (2, 3):
            up = (*cut[:depth], *[""] * (4 - depth))
            if up != cut:
                above.setdefault(up, []).append(part)
    ups = sorted(above, key=_bytes)
    sorted_ups = [_bytes(u) for u in ups]
    none = (None,) * 4

    def run(batches):
        for batch in batches:
            out = []
            for raw in batch.column("block"):
                nodes = Nodes.load(raw.as_buffer())
                first, last = _bytes(nodes.key(0)), _bytes(nodes.key(len(nodes) - 1))
                part, at = bisect_right(sorted_cuts, first), 0
                while part < len(cuts) and sorted_cuts[part] <= last:
                    end = nodes.place(cuts[part])
                    if end > at:
                        out.append((part, *none, nodes.part(at, end).dump()))
                    at, part = end, part + 1
                out.append((part, *none, nodes.part(at, len(nodes)).dump() if at else raw.as_py()))
                i = bisect_left(sorted_ups, first)
                while i < len(ups) and sorted_ups[i] <= last:
                    at = nodes.place(ups[i])
                    if nodes.key(at) == ups[i]:
                        one = (*ups[i][:3], int(nodes.n[at]), None)
                        out.extend((part, *one) for part in above[ups[i]])
                    i += 1
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.string()] * 3, pa.int64(), pa.binary()))], ["part", "lang", "w1", "w2", "n", "block"])

    return mapped(blocks.select("block"), run, "part int, lang string, w1 string, w2 string, n long, block binary", SMALL_BATCH)


def _merged(runs: list) -> tuple[Nodes, np.ndarray, int]:
    """The serialised, sorted runs as one, equal nodes added up; with the nodes' sorted keys and the bits of a word in them.

    A key is a language's and three words' numbers in one, 64 bits if that is
    enough and an unbounded integer if it isn't. Words are read first and
    numbers run by run, so that a range is never there twice.
    """
    words = [Nodes.load(raw, ("langs", "words")) for raw in runs]
    langs = sorted({x for r in words for x in r.langs.to_pylist()}, key=str.encode)
    number = {x: i for i, x in enumerate(langs)}
    coded = pa.concat_arrays([r.words for r in words]).dictionary_encode()
    sizes = [(len(r.words), np.array([number[x] for x in r.langs.to_pylist()], np.uint64)) for r in words]
    del words
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.uint64)
    rank[order] = np.arange(1, len(order) + 1, dtype=np.uint64)
    indices, sorted_words = coded.indices.to_numpy(), coded.dictionary.take(pa.array(order))
    del coded, order
    bits = len(rank).bit_length()
    kind = np.uint64 if 3 * bits + len(langs).bit_length() <= KEY_BITS else object
    keys, counts, at = [], [], 0
    for raw, (n_words, own) in zip(runs, sizes):
        r = Nodes.load(raw, ("lang", "w", "n"))
        new = np.concatenate([np.zeros(1, np.uint64), rank[indices[at : at + n_words]]]).astype(kind)
        key = own[r.lang].astype(kind)
        for w in r.w:
            key = key << kind(bits) | new[w] if kind is np.uint64 else (key << bits) | new[w]
        keys.append(key)
        counts.append(r.n)
        at += n_words
    key, n = np.concatenate(keys), np.concatenate(counts)
    del keys, counts
    by = np.argsort(key)
    key, n = key[by], n[by]
    del by
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    key, n = key[fresh], np.add.reduceat(n, np.flatnonzero(fresh))
    low = (1 << bits) - 1
    part = lambda k: ((key >> kind(k * bits)) & kind(low) if kind is np.uint64 else (key >> k * bits) & low).astype(np.uint32)
    lang = (key >> kind(3 * bits) if kind is np.uint64 else key >> 3 * bits).astype(np.uint32)
    return Nodes(pa.array(langs, pa.string()), sorted_words, lang, np.stack([part(2), part(1), part(0)]), n), key, bits


def _walked(nodes: Nodes, key: np.ndarray, bits: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the nodes at ``at`` the count of their first word, and of their first two (0 for a node of one word): up the trie, whose nodes lie in order."""
    up = []
    for words in (1, 2):
        low = (3 - words) * bits
        parent = key[at] >> np.uint64(low) << np.uint64(low) if key.dtype == np.uint64 else key[at] >> low << low
        up.append(nodes.n[np.searchsorted(key, parent)])
    return up[0], np.where(nodes.w[1, at] > 0, up[1], 0)


def _lent(above: pa.Table) -> dict[tuple[str, str, str, str], Nodes]:
    """The nodes above a range's bound by their keys, equal ones added up."""
    out = {}
    for r in above.select(["lang", "w1", "w2", "n"]).group_by(["lang", "w1", "w2"]).aggregate([("n", "sum")]).to_pylist():
        words = sorted({r["w1"], r["w2"]} - {""}, key=str.encode)
        w = np.array([[words.index(x) + 1 if x else 0] for x in (r["w1"], r["w2"], "")], np.uint32)
        out[r["lang"], r["w1"], r["w2"], ""] = Nodes(pa.array([r["lang"]], pa.string()), pa.array(words, pa.large_string()), np.zeros(1, np.uint32), w, np.array([r["n_sum"]], np.int64))
    return out


def merge(dealt: DataFrame, least: int = LEAST) -> DataFrame:
    """The nodes of ``least`` occurrences and more: lang, w1, w2, w3 (null for none), f, f1 (of the first word), f12 (of the first two); and for every range and language a row without words, whose f is the number of all words."""
    schema = "lang string, w1 string, w2 string, w3 string, f long, f1 long, f12 long"

    def run(table: pa.Table) -> pa.Table:
        # Nodes above the bound belong to other ranges.
        lent = _lent(table.filter(pc.is_null(table.column("block"))))
        nodes, keys, bits = _merged([*[raw.as_buffer() for raw in table.column("block").drop_null()], *[pa.py_buffer(one.dump()) for one in lent.values()]])
        mine = np.ones(len(nodes), bool)
        for key in lent:
            mine[nodes.place(key)] = False
        totals = np.zeros(len(nodes.langs), np.int64)
        single = mine & (nodes.w[1] == 0)
        np.add.at(totals, nodes.lang[single], nodes.n[single])
        keep = np.flatnonzero(mine & (nodes.n >= least))
        f1, f12 = _walked(nodes, keys, bits, keep)
        w = [nodes.words.take(pa.array(nodes.w[k, keep].astype(np.int64) - 1, mask=nodes.w[k, keep] == 0)).cast(pa.string()) for k in range(3)]
        some = np.flatnonzero(totals)
        none, zero = pa.nulls(len(some), pa.string()), pa.array(np.zeros(len(some), np.int64))
        table = lambda *columns: pa.Table.from_arrays(list(columns), ["lang", "w1", "w2", "w3", "f", "f1", "f12"])
        kept = table(nodes.langs.take(pa.array(nodes.lang[keep])), *w, *[pa.array(x.astype(np.int64)) for x in (nodes.n[keep], f1, f12)])
        return pa.concat_tables([kept, table(nodes.langs.take(pa.array(some)), none, none, none, pa.array(totals[some]), zero, zero)])

    def lean(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            release()

    return dealt.groupBy("part").applyInArrow(lean, schema)


# ---------------------------------------------------------------- scores


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (l r)); a million at most, as neither part is rarer than the phrase."""
    wide = lambda c: c.cast("decimal(18,0)")
    over = (F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)).cast("decimal(31,0)")).cast("decimal(38,0)")
    return F.call_function("div", over, (wide(left) * wide(right)).cast("decimal(38,0)"))


def scored(nodes: DataFrame, within: int = WITHIN) -> DataFrame:
    """The candidates that stay: lang, phrase, a, l, r, score. ``nodes``: those of merge(), staged, as they are read several times."""
    one = nodes.where("w1 is not null and w2 is null").select("lang", F.col("w1").alias("last"), F.col("f").alias("f_last"))
    # Phrases that end in one word are dealt to SALTS parts, each of which has the word.
    one = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    two = nodes.where("w2 is not null and w3 is null").withColumn("salt", F.pmod(F.xxhash64("w1"), F.lit(SALTS)).cast("int"))
    two = two.join(one.withColumnRenamed("last", "w2").hint("merge"), ["lang", "w2", "salt"]).select("lang", "w1", "w2", "f", "f1", "f_last")
    three = nodes.where("w3 is not null")
    ends = two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("f_last_two"), "f_last")
    three = three.join(ends.hint("merge"), ["lang", "w2", "w3"]).select("lang", "w1", "w2", "w3", "f", "f1", "f12", "f_last_two", "f_last")
    longer = three.select("lang", "f", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    longer = longer.groupBy("lang", "p.w1", "p.w2").agg(F.max("f").alias("f_longer"))
    kept = two.join(longer.hint("merge"), ["lang", "w1", "w2"], "left").where(f"f_longer is null or 100 * f_longer < {within} * f")
    pairs = kept.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f_last").alias("r"), _score(F.col("f"), F.col("f1"), F.col("f_last")).alias("score"))
    early, late = _score(F.col("f"), F.col("f1"), F.col("f_last_two")), _score(F.col("f"), F.col("f12"), F.col("f_last"))
    cut = F.col("early") <= F.col("late")
    triples = three.withColumn("early", early).withColumn("late", late).select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), F.when(cut, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(cut, F.col("f_last_two")).otherwise(F.col("f_last")).alias("r"), F.least("early", "late").alias("score"),
    )
    return pairs.unionByName(triples)


def top(phrases: DataFrame, n: int = TOP) -> DataFrame:
    """``phrases`` with rank, each language's first ``n``: parts of a language are ranked first, so that none is sorted as a whole."""
    order = (F.desc("score"), F.desc("a"), "phrase")
    parts = phrases.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= n)
    return few.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def phrases(docs: DataFrame, least: int = LEAST, n: int = TOP, within: int = WITHIN, shard: int = SHARD, block: int = BLOCK, nodes: int = RANGE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    blocks = staged(tries(docs, shard=shard, block=block), "tries")
    merged = staged(merge(ranges(blocks, bounds(blocks, nodes)), least), "nodes")
    words = merged.where("w1 is null").groupBy("lang").agg(F.sum("f").alias("n"))
    ranked = top(scored(merged, within), n)
    return ranked.join(F.broadcast(words), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(documents(spark, sf_dir))


ORACLE_SQL = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM d),
g AS (SELECT lang, unnest(flatten([list_transform(range(1, len(w) + 1), lambda i: w[i:i]), list_transform(range(1, len(w)), lambda i: w[i:i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])])) AS q FROM p),
f AS (SELECT lang, q, count(*)::HUGEINT AS c FROM g GROUP BY lang, q),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE len(q) = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE len(q) > 1 AND c >= {LEAST}),
k AS (SELECT c.lang, c.q, c.c AS a, k, x.c AS l, y.c AS r, (1000000 * c.c * c.c) // (x.c * y.c) AS score FROM (SELECT *, unnest(range(1, len(q))) AS k FROM c) c JOIN f x ON x.lang = c.lang AND x.q = c.q[1:k] JOIN f y ON y.lang = c.lang AND y.q = c.q[k + 1:]),
b AS (SELECT lang, q, a, min((score, k, l, r)) AS m FROM k GROUP BY lang, q, a),
o AS (SELECT lang, q, max(c) AS longer FROM (SELECT lang, unnest([q[1:2], q[2:3]]) AS q, c FROM c WHERE len(q) = 3) GROUP BY lang, q),
s AS (SELECT b.lang, array_to_string(b.q, ' ') AS phrase, a::BIGINT AS a, m[3]::BIGINT AS l, m[4]::BIGINT AS r, m[1]::BIGINT AS score FROM b LEFT JOIN o ON o.lang = b.lang AND o.q = b.q WHERE len(b.q) = 3 OR longer IS NULL OR 100 * longer < {WITHIN} * a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM s JOIN n USING (lang)) WHERE rank <= {TOP}"""
