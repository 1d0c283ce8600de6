"""Operator 6, personal data: rules, and a linear-chain conditional random field.

The base rules find e-mail and IP addresses, card and phone numbers. A
conditional random field over word shapes finds what the rules' fixed forms
miss: phone numbers without a plus sign, addresses with "(at)" and "(dot)",
and secrets such as keys and tokens. It is trained here from a small table of
labelled lines and decoded by Viterbi for batches of lines in numpy. Its spans
are added where they touch no span of the rules.

Shapes are of words, that is what stands between white space: its form (letters,
digits, mixtures), length, outer punctuation and whether it is one of a few cue
words; features are those of a word and its two neighbours. Lines without a
digit, an at sign, "(at)" or "(dot)" needn't be decoded where the trained field
can give no span on them: fit() bounds what any stretch of span labels gains over
plain ones, by longest paths through all sequences of the shapes that such lines
have, of any length, and decodes every line unless that bound is below zero.

Everything is by row; nothing is shuffled, and what is sent to executors is the
field's weights. All rules take time in proportion to the text, whatever it holds.

Defined results: null text is empty and has no spans; a text of any length is
taken whole; of labels with equal scores the first is taken; repeated rows and
null ids get a result each; an empty table gives an empty result; other columns
stay as they are (redact) or are never looked at (find).
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.llm.common import KEPT_VALUES, SMALL_BATCH, documents, mapped, pieces

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
_ORDER = {k: i for i, k in enumerate(KINDS)}
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A start within a run of digits can't match where the run's start didn't.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of characters of _LOCAL, an at sign and a domain: from each at sign back, as only one can end there."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            first = low + len(text[low:at].rstrip(_LOCAL))
            if first < at:
                out.append((first, m.end()))
        low = out[-1][1] if out and out[-1][1] > at else at + 1
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the rules, by kind as listed, then start."""
    out = []
    if "@" in text:
        out += [("email", *span) for span in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


# ---------------------------------------------------------------- the field

LABELS = ("O", "B-phone", "I-phone", "B-secret", "I-secret", "B-email", "I-email")
_CUES = {
    "call": "tel", "tel": "tel", "phone": "tel", "fax": "tel", "mobile": "tel", "cell": "tel", "dial": "tel",
    "token": "key", "key": "key", "secret": "key", "password": "key", "passwd": "key", "api_key": "key", "apikey": "key", "bearer": "key",
    "=": "is", ":": "is", "(at)": "at", "[at]": "at", "(dot)": "dot", "[dot]": "dot",
    "order": "no", "page": "no", "version": "no", "year": "no", "number": "no", "chapter": "no", "no.": "no", "room": "no",
}
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shape(word: str) -> str:
    """A word's shape; words of letters alone have one unless they are cues."""
    return _known(word) if len(word) <= 64 else _shape(word)


def _shape(word: str) -> str:
    low = word.lower()
    cue = _CUES.get(low) or _CUES.get(low.strip("\"'`.,;:!?"))
    if cue:
        return cue
    core = word.strip("\"'`.,;:!?")
    if not any(c in "0123456789" for c in core):
        return "at-sign" if "@" in core else "word"
    digits = sum(c in "0123456789" for c in core)
    if digits == len(core):
        return f"d{min(digits, 6)}" if digits < 7 else "d7-11" if digits < 12 else "d12+"
    inner = core.strip("()")
    if inner.isdigit():
        return f"(d{min(len(inner), 6)})"
    if re.fullmatch(r"\(?[0-9]{2,4}\)?[-.][0-9]{2,4}(?:[-.][0-9]{2,6})+", core):
        return "d-d-d"
    if re.fullmatch(r"[0-9]{2,4}[-.][0-9]{3,6}", core):
        return "d-d"
    if re.fullmatch(r"[0-9]+(?:[.,:/%][0-9]+)*[%a-z]{0,2}", core):
        return "figure"
    solid = re.sub(r"[^A-Za-z0-9]", "", core)
    if len(solid) >= 16 and len(solid) >= 0.8 * len(core):
        return "hex16+" if re.fullmatch(r"[0-9a-fA-F]+", solid) else "mix16+"
    return "mixed"


#: Shapes of words that are not too long to be kept.
_known = lru_cache(50_000)(_shape)
KEPT_VALUES.append(_known.cache_clear)

#: The labelled table: lines with the words of each span in braces, the kind in front. They are varied by _table().
_LINES = (
    "the meeting is on page D of the report",
    "in the year D there were D of them",
    "version D.D came out in D",
    "it cost D,D in all and D% more",
    "order number D was sent on D",
    "see chapter D page D for more",
    "W W W D W W",
    "W W D-D W W",
    "W W figure D.D W",
    "meet me at the station at D",
    "W at W and W at W",
    "W dot W W",
    "W W D W D W D W",
    "the token of thanks W W",
    "key = D W",
    "the key is W in room D",
    "call me W W",
    "W code AD W",
    "W W XSHORT W W",
    "call {phone (P3) P3-P4} W W",
    "tel {phone P3-P3-P4} W",
    "phone : {phone P3 P3 P4} W W",
    "W W {phone (P3) P3-P4} W W",
    "W W {phone P3-P3-P4} W W",
    "W W {phone P3.P3.P4}",
    "mobile {phone (P3) P3 P4}",
    "fax {phone P3-P3-P4}",
    'token = {secret "HEX"} W W',
    'W W token = {secret "HEX"} W W',
    "key = {secret MIX} W",
    "secret : {secret HEX} W",
    "password = {secret MIX} W W",
    "bearer {secret MIX} W",
    "W W {secret HEX} W W",
    "W W {secret MIX} W W",
    "W {email W (at) W (dot) W} W",
    "W W {email W [at] W [dot] W} W",
)


def _table(copies: int = 12, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """The labelled lines with made-up words and figures: words and labels."""
    rng = np.random.Generator(np.random.PCG64(seed))
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda n, of: "".join(rng.choice(list(of), n))
    fill = {
        "HEX": lambda: letters(int(rng.choice([32, 40, 64])), "0123456789abcdef"),
        "MIX": lambda: letters(10, "abcdefghijklmnop0123456789") + "9Z" + letters(int(rng.integers(8, 30)), "ABCDEFGHXYZabcdefxyz0123456789"),
        "XSHORT": lambda: letters(3, "abc") + digits(2),
        "P3": lambda: digits(3), "P4": lambda: digits(4), "AD": lambda: letters(2, "ABC") + digits(3),
        "D": lambda: digits(int(rng.integers(1, 5))),
        "W": lambda: letters(int(rng.integers(2, 9)), "abcdefghilmnorstu") + str(rng.choice(["", "", "", ",", "."])),
    }
    slot = re.compile("|".join(fill))
    out = []
    for line in _LINES:
        for _ in range(copies):
            words, labels, kind = [], [], None
            for item in line.split():
                if item.startswith("{"):
                    kind, begins = item[1:], True
                    continue
                ends = item.endswith("}")
                words.append(slot.sub(lambda m: fill[m[0]](), item.rstrip("}")))
                labels.append("O" if kind is None else ("B-" if begins else "I-") + kind)
                begins = False
                kind = None if ends else kind
            out.append((words, labels))
    return out


class Field:
    """Weights of a linear chain: of (place, shape) features for each label, and between labels."""

    def __init__(self, shapes: dict[str, int], emit: np.ndarray, step: np.ndarray) -> None:
        self.shapes, self.emit, self.step = shapes, emit, step
        #: Whether lines that _SPELT doesn't match have no span, so that they needn't be decoded.
        self.skips = False

    def codes(self, words: list[str]) -> list[int]:
        """The shapes' numbers; an unknown shape is 0."""
        return [self.shapes.get(shape(w), 0) for w in words]

    def potentials(self, codes: np.ndarray) -> np.ndarray:
        """(lines, places, labels) from (lines, places) of shape numbers, where 1 stands outside the line."""
        wide = np.pad(codes, ((0, 0), (1, 1)), constant_values=1)
        return self.emit[0][wide[:, :-2]] + self.emit[1][wide[:, 1:-1]] + self.emit[2][wide[:, 2:]]

    def viterbi(self, lines: list[list[int]]) -> list[np.ndarray]:
        """The best labels of each line; lines are batched by length, so that padding stays small."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lines)
        order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and j - i < 512 and len(lines[order[j]]) <= max(16, 1.3 * len(lines[order[i]])):
                j += 1
            some = order[i:j]
            n = np.array([len(lines[k]) for k in some])
            codes = np.ones((len(some), int(n.max())), np.int64)
            for row, k in enumerate(some):
                codes[row, : n[row]] = lines[k]
            own = self.potentials(codes)
            best, back = own[:, 0], np.zeros((*codes.shape, len(LABELS)), np.int8)
            for t in range(1, codes.shape[1]):
                through = best[:, :, None] + self.step
                back[:, t] = through.argmax(1)
                now = through.max(1) + own[:, t]
                best = np.where((t < n)[:, None], now, best)
            at = best.argmax(1)
            path = np.zeros(codes.shape, np.int64)
            for t in range(codes.shape[1] - 1, -1, -1):
                path[:, t] = at
                if t:
                    at = np.where(t < n, back[np.arange(len(some)), t, at], at)
            for row, k in enumerate(some):
                out[k] = path[row, : n[row]]
            i = j
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


@lru_cache(1)
def fit(rounds: int = 150, rate: float = 0.15, penalty: float = 0.002) -> Field:
    """The field of the greatest penalised likelihood of the labelled table, by Adam on exact gradients."""
    table = _table()
    names = sorted({shape(w) for words, _ in table for w in words})
    shapes = {s: i + 2 for i, s in enumerate(names)}
    most, k = max(len(w) for w, _ in table), len(LABELS)
    codes, gold = np.ones((len(table), most), np.int64), np.zeros((len(table), most), np.int64)
    inside = np.zeros((len(table), most), bool)
    field = Field(shapes, np.zeros((3, len(shapes) + 2, k)), np.zeros((k, k)))
    for i, (words, labels) in enumerate(table):
        codes[i, : len(words)], inside[i, : len(words)] = field.codes(words), True
        gold[i, : len(words)] = [LABELS.index(x) for x in labels]
    wide = np.pad(codes, ((0, 0), (1, 1)), constant_values=1)
    around = (wide[:, :-2], wide[:, 1:-1], wide[:, 2:])
    hot = np.eye(k)[gold] * inside[..., None]
    steps = np.einsum("bti,btj->ij", hot[:, :-1], hot[:, 1:])
    params = [field.emit, field.step]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for r in range(1, rounds + 1):
        own = field.potentials(codes)
        fore, hind = np.zeros_like(own), np.zeros_like(own)
        fore[:, 0] = own[:, 0]
        for t in range(1, most):
            now = _log_sum(fore[:, t - 1, :, None] + field.step, 1) + own[:, t]
            fore[:, t] = np.where(inside[:, t, None], now, fore[:, t - 1])
        total = _log_sum(fore[:, -1], 1)
        for t in range(most - 2, -1, -1):
            now = _log_sum(field.step + (own[:, t + 1] + hind[:, t + 1])[:, None, :], 2)
            hind[:, t] = np.where(inside[:, t + 1, None], now, 0.0)
        one = np.exp(fore + hind - total[:, None, None]) * inside[..., None]
        pair = fore[:, :-1, :, None] + field.step + (own[:, 1:] + hind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        pair = np.exp(pair) * inside[:, 1:, None, None]
        g_emit = np.zeros_like(field.emit)
        for place in range(3):
            np.add.at(g_emit[place], around[place][inside], (hot - one)[inside])
        for i, (p, g) in enumerate(zip(params, (g_emit / len(table) - penalty * field.emit, (steps - pair.sum((0, 1))) / len(table) - penalty * field.step))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            p += rate * m[i] / (1 - 0.9**r) / (np.sqrt(v[i] / (1 - 0.99**r)) + 1e-6)
    # An inner word never starts a span.
    for i, a in enumerate(LABELS):
        for j, b in enumerate(LABELS):
            if b[0] == "I" and a[2:] != b[2:]:
                field.step[i, j] = -1e4
    field.skips = most_gain(field, [shapes[x] for x in PLAIN]) < 0
    return field


#: Shapes of words without a digit, an at sign, "(at)" or "(dot)".
PLAIN = ("word", "tel", "key", "is", "no")


def most_gain(field: Field, shapes: list[int]) -> float:
    """The most that a stretch of span labels can gain over plain ones, in any line of words of ``shapes``; infinite if it grows with length.

    Longest paths over (label, shape before, shape): a stretch begins after a
    plain word or at the line's start, and ends before one or at its end. A line
    has other labels than plain ones only if some stretch gains.
    """
    k = len(LABELS)
    around = np.array([1, *shapes])  # 1: outside the line
    n = len(around)
    # gain[l, p, c, x]: of label l on c between p and x.
    own = [e - e[:, :1] for e in field.emit]
    gain = own[0][around].T[:, :, None, None] + own[1][around].T[:, None, :, None] + own[2][around].T[:, None, None, :]
    gain[:, :, 0, :] = -np.inf  # outside is no word
    step = field.step - field.step[0, 0]
    begin = np.broadcast_to(step[0][:, None, None], (k, n, n)).copy()
    begin[:, 0, :] = 0.0  # at the line's start
    begin[0], begin[:, :, 0] = -np.inf, -np.inf
    best = begin.copy()
    for _ in range(k * n * n + 1):
        through = best[:, :, :, None] + gain  # after the word, by the next shape
        going = through.max(1)  # label, shape, next shape
        after = (going[:, None, :, :] + step[:, :, None, None]).max(0)  # next label, shape, next shape
        after[0], after[:, :, 0] = -np.inf, -np.inf
        now = np.maximum(best, after)
        if np.allclose(now, best, atol=1e-9, rtol=0, equal_nan=True):
            through = best[:, :, :, None] + gain
            ends = through + step[:, 0][:, None, None, None]
            ends[..., 0] = through[..., 0]  # at the line's end
            return float(ends[1:].max())
        best = now
    return float("inf")


_SPELT = re.compile(r"[0-9@]|[(\[](?i:at|dot)[)\]]")


def field_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """Spans that the field finds in each text, sequences being lines."""
    lines, where = [], []
    for i, text in enumerate(texts):
        if field.skips and not _SPELT.search(text):
            continue
        at = 0
        for line in text.split("\n"):
            if not field.skips or _SPELT.search(line):
                words = list(_WORD.finditer(line))
                lines.append(field.codes([w[0] for w in words]))
                where.append((i, at, words))
            at += len(line) + 1
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (i, at, words), labels in zip(where, field.viterbi(lines)):
        j = 0
        while j < len(words):
            label = LABELS[labels[j]]
            if label[0] != "B":
                j += 1
                continue
            k = j + 1
            while k < len(words) and LABELS[labels[k]] == "I-" + label[2:]:
                k += 1
            line_end = words[k - 1].end()
            start, core = words[j].start(), words[k - 1][0]
            start += len(words[j][0]) - len(words[j][0].lstrip("\"'`<[{"))
            end = line_end - (len(core) - len(core.rstrip("\"'`.,;:!?>]}")))
            if start < end:
                out[i].append((label[2:], at + start, at + end))
            j = k
    return out


def all_spans(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """For each text the rules' spans and all spans, both by kind, then start."""
    out = []
    for text, found in zip(texts, field_spans(texts, field)):
        base = base_spans(text)
        added = [s for s in found if all(s[2] <= b[1] or s[1] >= b[2] for b in base)]
        out.append((base, sorted(base + added, key=lambda s: (_ORDER[s[0]], s[1]))))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (rules), base_sha256, spans, n_spans (all)."""
    field = docs.sparkSession.sparkContext.broadcast(fit())

    def run(batches):
        for batch in pieces(batches, "text"):
            cols: list[list] = [[] for _ in range(7)]
            for base, spans in all_spans([t or "" for t in batch.column("text").to_pylist()], field.value):
                kinds = [s[0] for s in base]
                for col, x in zip(cols, (*(kinds.count(k) for k in BASE), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans))):
                    col.append(x)
            arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(c, pa.string()) for c in cols[4:6]] + [pa.array(cols[6], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(rows, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind; of spans that touch, the first names them all."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all spans of the text replaced; rows, order and other columns stay, null text stays null."""
    field = docs.sparkSession.sparkContext.broadcast(fit())
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in pieces(batches, text_col):
            texts = batch.column(at).to_pylist()
            clean = [None if t is None else redacted(t, spans) for t, (_, spans) in zip(texts, all_spans([t or "" for t in texts], field.value))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(clean, batch.schema.field(at).type), *batch.columns[at + 1 :]], batch.schema.names)

    return mapped(docs, run, docs.schema, SMALL_BATCH)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))
