"""Token ids of whole texts, word by word from a cache.

The tokenizer drops white space and never joins what white space separates, so
the ids of a text are those of its space-separated parts in a row. Nor does it
join a run of letters with its neighbours, so a part of plain characters is cut
into such runs, which recur far more often than parts do; the vocabulary's own
merging encodes a run once and it is kept. Parts with any other character go
through the whole tokenizer. Ids and places are the same as those of encoding
every text as a whole; tests hold one against the other. That is so for
vocabularies that split and normalise as SPLITS says; with any other, texts are
encoded as a whole.

Defined results: an empty text has no ids; a text of any length is taken whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct

import numpy as np
import pyarrow as pa

from codegrain.llm.common import KEPT_VALUES, utf8

TOKENIZER = "word_bpe_49k.json"
# How a vocabulary normalises and splits for which parts may be encoded one by one.
SPLITS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
#: Parts and runs kept at most, some 400 bytes for both, those kept until there are as many newer ones, and characters of one that is kept.
KEPT, RECENT, _LONG = 120_000, 20_000, 64
#: A part of printable ASCII but the apostrophe, and of Latin letters with accents, which normalising leaves but for case.
_PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]*", re.ASCII)
_RUNS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: The same for parts in lines.
_PLAIN_LINES = re.compile(r"[\n!-&(-~À-ÖØ-öø-ÿ]*", re.ASCII)
_LINE_RUNS = re.compile(r"\n|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+")
#: Bytes of texts whose parts are looked up at once; numpy and Python take some 15 times as much for them, whatever the length of the column.
_AT_ONCE = 2 << 20
_PACKS = [struct.Struct(f"<{n}I").pack for n in range(33)]
_OPEN: dict[str, "PartEncoder"] = {}
KEPT_VALUES.append(_OPEN.clear)


def _blocks(raw: np.ndarray, bounds: np.ndarray):
    """First and end byte of blocks of _AT_ONCE bytes at most that end with white space or a text, so that no part is in two; only one with a longer part has more."""
    lo, n, size = 0, len(raw), _AT_ONCE
    while lo < n:
        hi = min(lo + size, n)
        if hi < n:
            gaps = np.flatnonzero((raw[lo:hi] == 32) | (raw[lo:hi] == 10))
            hi = max(lo + int(gaps[-1]) + 1 if len(gaps) else lo, int(bounds[np.searchsorted(bounds, hi, side="right") - 1]))
        if hi > lo:
            yield lo, hi
            lo, size = hi, _AT_ONCE
        else:
            size *= 2


class _Values(dict):
    """Values of parts: the first ``most`` stay, as what is frequent comes early; others until RECENT newer ones have come."""

    def __init__(self, value, most: int) -> None:
        self.value, self.most, self.recent = value, most, {}

    def __missing__(self, part: str):
        got = self.recent.get(part)
        if got is None:
            got = self.value(part)
            if len(part) <= _LONG:
                if len(self) < self.most:
                    self[part] = got
                else:
                    if len(self.recent) >= RECENT:
                        self.recent.clear()
                    self.recent[part] = got
        return got


class PartEncoder:
    """Ids (and places) of texts by a tokenizer, part by part where it drops white space as SPLITS has it."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        # Of these parts alone: the whole configuration has the vocabulary in it.
        config = {k: json.loads(part.__getstate__()) if (part := getattr(self._tokenizer, k)) is not None else None for k in SPLITS}
        #: Whether parts may be encoded one by one.
        self.by_parts = config == SPLITS and getattr(self._model, "end_of_word_suffix", None) == "</w>"
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        chars = [chr(c) for c in (*range(33, 127), *range(192, 256))]
        self._bytes = {ord(c): level.pre_tokenize_str(c)[0][0] for c in chars}
        self._ids, self._spans = _Values(self._part_ids, KEPT), _Values(self._part_spans, KEPT)
        self._runs, self._run_spans = _Values(self._run_ids, KEPT), _Values(self._places, KEPT)

    @classmethod
    def of(cls, path: str | None, kept: int = KEPT) -> "PartEncoder":
        """The worker's encoder for a vocabulary file; None: the public one."""
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        if path not in _OPEN:
            _OPEN[path] = cls(path)
        encoder = _OPEN[path]
        for values in (encoder._ids, encoder._spans, encoder._runs, encoder._run_spans):
            values.most = kept
        return encoder

    @functools.cached_property
    def largest(self) -> int:
        """The largest id."""
        return max(self._tokenizer.get_vocab(with_added_tokens=True).values(), default=0)

    def _run_ids(self, run: str) -> bytes:
        # ASCII stands for its own bytes.
        ids = [t.id for t in self._model.tokenize(run if run.isascii() else run.translate(self._bytes))]
        return _PACKS[len(ids)](*ids) if len(ids) < len(_PACKS) else struct.pack(f"<{len(ids)}I", *ids)

    def _places(self, run: str) -> list[tuple[int, int]]:
        # One symbol for each byte; a token that has part of a character has it.
        of_byte = [i for i, c in enumerate(run) for _ in self._bytes[ord(c)]]
        at, got = 0, []
        for t in self._model.tokenize(run.translate(self._bytes)):
            n = len(t.value.removesuffix("</w>"))
            got.append((of_byte[at], of_byte[at + n - 1] + 1))
            at += n
        return got

    def _part_ids(self, part: str) -> bytes:
        if _PLAIN.fullmatch(part) and "<|" not in part:
            return b"".join(map(self._runs.__getitem__, _RUNS.findall(part.lower())))
        ids = self._tokenizer.encode(part, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part_spans(self, part: str) -> bytes:
        if _PLAIN.fullmatch(part) and "<|" not in part:
            flat = [x + m.start() for m in _RUNS.finditer(part.lower()) for ab in self._run_spans[m[0]] for x in ab]
        else:
            flat = [x for ab in self._tokenizer.encode(part, add_special_tokens=False).offsets for x in ab]
        return struct.pack(f"<{len(flat)}q", *flat)

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not self.by_parts:
            ids = self._tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self._ids.__getitem__, text.replace("\n", " ").split(" ")))

    def _of_all(self, parts: list[str]) -> list[bytes]:
        """The ids of different parts; those that aren't kept are cut into runs all at once."""
        got = list(map(self._ids.get, parts))
        new = [i for i, ids in enumerate(got) if ids is None]
        text = "\n".join([parts[i] for i in new])
        if not _PLAIN_LINES.fullmatch(text) or "<|" in text:
            for i in new:
                got[i] = self._ids[parts[i]]
            return got
        runs = _LINE_RUNS.findall(text.lower())
        values = list(map(self._runs.__getitem__, runs))
        ends = [k for k, run in enumerate(runs) if run == "\n"]
        start = 0
        for i, end in zip(new, [*ends, len(runs)]):
            got[i] = values[start] if end - start == 1 else b"".join(values[start:end])
            start = end + 1
        room = self._ids.most - len(self._ids)
        if room > 0:
            self._ids.update((parts[i], got[i]) for i in new[:room] if len(parts[i]) <= _LONG)
        return got

    def batch_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column in a row, a null text as an empty one, and each text's bounds among them. Every different part is looked up once."""
        if not self.by_parts:
            each = [np.frombuffer(self.ids(t or ""), "<u4") for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, "<u4"), *each]), np.cumsum([0, *map(len, each)])
        raw, bounds = utf8(texts)
        at, found, total = np.zeros(len(bounds), np.int64), [np.zeros(0, "<u4")], 0
        for lo, hi in _blocks(raw, bounds):
            a, b = np.searchsorted(bounds, [lo, hi])
            ids, before = self._block_ids(raw[lo:hi], bounds[a:b] - lo)
            found.append(ids)
            at[a:b], total = before + total, total + len(ids)
        at[np.searchsorted(bounds, len(raw)) :] = total
        return np.concatenate(found), at

    def _block_ids(self, raw: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block, and how many of them come before each of ``firsts``, where texts begin in it."""
        solid = (raw != 32) & (raw != 10)
        starts = solid.copy()
        starts[1:] &= ~solid[:-1]
        starts[firsts] = solid[firsts]
        begin = np.flatnonzero(starts)
        # Parts lie one behind the other once the gaps are left out.
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.add.reduceat(solid, begin, dtype=np.int64))])
        coded = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(raw[solid])).dictionary_encode()
        values = self._of_all(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(values), "<u4")
        n = np.fromiter(map(len, values), np.int64, len(values)) // 4
        of = coded.indices.to_numpy()
        each = n[of]
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(each)])
        shift = (np.cumsum(n) - n)[of] - before[:-1]
        return flat[np.repeat(shift, each) + np.arange(before[-1])], before[np.searchsorted(begin, firsts)]

    def spans(self, text: str) -> np.ndarray:
        """First and end character of every token, in order."""
        if not self.by_parts:
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        parts = text.replace("\n", " ").split(" ")
        found = list(map(self._spans.__getitem__, parts))
        at = np.cumsum([0] + [len(p) + 1 for p in parts])[:-1]
        spans = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
        return spans + np.repeat(at, [len(f) // 16 for f in found])[:, None]
