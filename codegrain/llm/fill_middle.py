"""Operator 13, texts turned so that a model learns to fill in a middle.

A text is cut at line ends into prefix, middle and suffix, and written in
another order with marks between the parts. For each batch of texts two packed
bit vectors are made: one has a bit for every byte that ends a line, the other
for every byte that begins a character. The ones of a text in the first are its
number of lines n; two numbers drawn from the id's hash, modulo n + 1, are ranks,
and select() on them gives the bytes to cut at. The ones of the second between
two cuts are the characters of a part. Texts never become lists of lines.

Defined results: a null text is an empty one, and that is plain, with n = 0; a
text that holds one of the marks is plain, so that every other output can be
taken apart again; null ids are hashed as no digits, repeated ids draw the same
cuts; a text of any length is one row and is cut as a whole; an empty table
gives an empty table; other columns are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.llm.common import documents, mapped, pieces, utf8
from codegrain.llm.succinct import BitVector

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: In percent: texts that are turned at all, and of those the ones that begin with the suffix.
RATE, SPM = 100, 50


def _draw(id_col: str, seed: int, k: int) -> Column:
    """The k-th group, from 0, of eight hex digits of the hash of seed and id, as a number."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long")


def _cuts(column: pa.Array, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each text of a batch: the number of lines, and the bytes and the characters (prefix, middle) that its two cuts give."""
    raw, bounds = utf8(column)
    first, last = bounds[:-1], bounds[1:]
    ends = raw == 10
    ends[last[last > first] - 1] = True  # the rest without a newline is a line too
    lines = BitVector.of(ends)
    before = lines.rank(bounds)
    n = np.diff(before)
    ranks = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
    cuts = np.tile(first, (2, 1))
    for cut, rank in zip(cuts, ranks):
        some = rank > 0
        cut[some] = lines.select((before[:-1] + rank - 1)[some]) + 1
    chars = BitVector.of((raw & 0xC0) != 0x80)
    placed = chars.rank(np.concatenate([first, *cuts])).reshape(3, -1)
    return n, cuts - first, np.diff(placed, axis=0)


def fill_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = (text == "") | (_draw(id_col, seed, 2) % 100 >= rate)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain |= F.contains(text, F.lit(mark))
    form = F.when(plain, "plain").when(_draw(id_col, seed, 3) % 100 < spm, "spm").otherwise("psm")
    drawn = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), form.alias("form"), _draw(id_col, seed, 0).alias("h1"), _draw(id_col, seed, 1).alias("h2"))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches):
        for batch in pieces(batches, "text"):
            forms = batch.column("form").to_pylist()
            n, cuts, chars = _cuts(batch.column("text"), batch.column("h1").to_numpy(), batch.column("h2").to_numpy())
            raw, bounds = utf8(batch.column("text"))
            whole, out = raw.tobytes(), []
            for form, at, end, a, b in zip(forms, bounds[:-1].tolist(), bounds[1:].tolist(), *cuts.tolist()):
                prefix, middle, suffix = whole[at : at + a], whole[at + a : at + b], whole[at + b : end]
                out.append(whole[at:end] if form == "plain" else b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)))
            no = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), batch.column("form"), *[pa.array(c, mask=no) for c in chars], pa.array(out, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    of = docs.schema[id_col].dataType.simpleString()
    return mapped(drawn, run, f"doc_id {of}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from. The marks stand in an output once each, as texts with a mark are plain."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    prefix, suffix = F.when(form == "psm", F.get(part, F.lit(1))).otherwise(F.get(part, F.lit(2))), F.when(form == "psm", F.get(part, F.lit(2))).otherwise(F.get(part, F.lit(1)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.get(part, F.lit(3)), suffix))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = fill_middle(documents(spark, sf_dir))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256")]
    return turned.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLE_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u FROM documents),
x AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
