"""Awkward documents: nulls, blanks, ties, repeated rows, long texts, columns whose names an operator uses itself."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, code string, node long, host string, kind int"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
_SYLLABLES = ["th", "er", "on", "é", "an", "re", "ñ", "ing", "qu", "ou"]


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(n, seed):
    w = words(n, seed)
    return "\n".join(" ".join(w[i : i + 12]).capitalize() + "." for i in range(0, n, 12))


def rows():
    long = prose(3000, 1)
    base = prose(120, 2)
    near = base.replace(" ", " x ", 1)
    line = "This very line stands in many documents of one host."
    out = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, near, None, "a"),
        (3, near, None, "a"),
        (4, None, "en", "a"),
        (5, "", "fr", None),
        (6, " \t\n \x0b", "fr", "b"),
        (7, "Éa É ÉA éa 12 <|endoftext|> ǅ İ K", "fr", "b"),
        (8, long, "en", "b"),
        (None, "lost words without an id " * 30, None, None),
        (None, None, None, None),
        (9, "one", "en", "a"),
        (10, "a b c d e", "en", "a"),
        (11, "a b c d e", "en", "a"),
        (12, "x " * 500, "en", "b"),
        (13, base.upper(), "en", "c"),
        (14, "mail a.b@c.example.org, 1.2.3.400 and 10.0.0.1; +1 (555) 123-4567, 4539578763621486", "en", "c"),
    ]
    out += [(20 + i, prose(80, 100 + i) + "\n" + line, "en", "a") for i in range(25)]
    out += [(60 + i, line + "\n" + line + "\n" + " ".join(words(10, 200 + i)), "en", "a") for i in range(3)]
    return [(d, t, la, s, None if t is None else len(t), 7, "z", 1, "h", 0) for d, t, la, s in out]


def frame(spark, listed=None):
    return spark.createDataFrame(rows() if listed is None else listed, SCHEMA)


def split(text):
    return [w for w in SPACE.split(text or "") if w]


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
