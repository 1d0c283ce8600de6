"""Token files and turned texts, against plain re-implementations; the structures below them against plain lists."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codegrain.llm import fill_middle, token_files, tokens
from codegrain.llm.succinct import BitVector, EliasFano
from tests.llm.fixtures import frame, prose, rows
from tests.llm.test_long import TEXTS


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), max_size=3000), st.integers(1, 40))
def test_rank_and_select(bits, sparse):
    flags = np.array([b for x in bits for b in [x] + [False] * (sparse - 1)], bool)
    v = BitVector.of(flags)
    assert v.rank(np.arange(len(flags) + 1)).tolist() == [0, *np.cumsum(flags).tolist()] and v.ones == flags.sum()
    assert v.select(np.arange(v.ones)).tolist() == np.flatnonzero(flags).tolist()
    with pytest.raises(IndexError):
        v.select(np.array([v.ones]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=400), st.integers(0, 62))
def test_elias_fano(values, shift):
    values = sorted(x >> shift for x in values)
    raw = b"12345678" + EliasFano.dump(np.array(values, np.uint64))
    got, end = EliasFano.load(raw, 8)
    assert end == len(raw) and got.select(np.arange(len(values))).tolist() == values
    for x in values[:5]:
        assert got.first_at_least(x) == values.index(x)


def test_boundaries_take_few_bits():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    assert 8 * len(EliasFano.dump(ends)) / len(ends) < 2 + np.log2(ends[-1] / len(ends)) + 1


def listed_ids(listed):
    """doc_id, start, ids of all documents in order, by the whole tokenizer; equal ids in any order."""
    t = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    return [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, token_files.END]) for r in sorted(listed, key=lambda r: (r[0] is not None, r[0] or 0))]


@pytest.mark.parametrize("file_ids", [1, 700, 1 << 20])
def test_token_files_round_trip(spark, tmp_path, file_ids):
    listed = [*rows(), (-5, "below nought", None, None, 1, 7, "z", 1, "h", 0)]
    want = listed_ids(listed)
    token_files.write(frame(spark, listed).repartition(3), f"{tmp_path}/t", file_ids=file_ids)
    got = sorted(token_files.read(spark, f"{tmp_path}/t").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [w[0] for w in want]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((d, tuple(ids)) for d, ids in want)
    files = token_files.files(spark, f"{tmp_path}/t")
    assert sum(r.n_docs for r in files.collect()) == len(want) and (file_ids > 1 or files.count() == len(want))
    crcs = Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.digests(spark, f"{tmp_path}/t").collect())
    assert crcs == Counter((r.doc_id, r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got)
    some = token_files.lookup(spark, f"{tmp_path}/t", [3, 8, -5, 10**6])
    assert Counter((r.doc_id, r.start, tuple(r.ids)) for r in some.collect()) == Counter((r.doc_id, r.start, tuple(r.ids)) for r in got if r.doc_id in (3, 8, -5))


def test_token_files_of_nothing_and_of_other_vocabularies(spark, tmp_path):
    token_files.write(frame(spark, []), f"{tmp_path}/none")
    assert token_files.read(spark, f"{tmp_path}/none").count() == 0 and token_files.lookup(spark, f"{tmp_path}/none", [1]).count() == 0
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write(frame(spark), f"{tmp_path}/wide", tokenizer=path, end=70_000)  # an id that needs more than 16 bits
    t = Tokenizer.from_file(path)
    got = Counter((r.doc_id, tuple(r.ids)) for r in token_files.read(spark, f"{tmp_path}/wide").collect())
    assert got == Counter((r[0], (*t.encode(r[1] or "", add_special_tokens=False).ids, 70_000)) for r in rows())


def most_held(run):
    """The most bytes that Python and numpy hold during run(), and what it gives."""
    tracemalloc.start()
    try:
        got = run()
        return tracemalloc.get_traced_memory()[1], got
    finally:
        tracemalloc.stop()


def test_a_task_holds_few_times_its_text(spark, tmp_path, monkeypatch):
    text = prose(100_000, 4)
    size = 8 << 20
    text = (text + "\n") * (2 * size // len(text.encode()) + 1)
    encoder = tokens.PartEncoder.of(None)
    encoder.ids(text)
    held, (ids, at) = most_held(lambda: encoder.batch_ids(pa.array([text])))
    assert held < 8 * 2 * size and ids.tobytes() == encoder.ids(text) and at.tolist() == [0, len(ids)]
    runs = []
    monkeypatch.setattr(token_files, "mapped", lambda df, run, schema, *_: runs.append(run) or spark.createDataFrame([], schema))
    monkeypatch.setattr(token_files, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 5)))
    token_files.write(frame(spark, []), f"{tmp_path}/t")
    lines = text.splitlines()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lines))), pa.array(lines)], ["doc_id", "text"])
    held, (row,) = most_held(lambda: [b.column("file")[0].as_buffer() for b in runs[0](iter([batch]))])
    assert held < 6 * 2 * size
    f = token_files.TokenFile(row)
    assert (f.part, f.n_docs, f.n_ids) == (5, len(lines), len(ids) + len(lines))


@pytest.mark.parametrize("at_once", [1, 7, 1000])
def test_ids_of_columns_in_blocks(monkeypatch, at_once):
    texts = [None, "", " ", *[r[1] for r in rows()], *[t[: at_once * 300] for t in TEXTS], "", "x" * 5000, "y", "中文" * 700, "\n", None]
    encoder = tokens.PartEncoder.of(None)
    want = [encoder.ids(t or "") for t in texts]
    monkeypatch.setattr(tokens, "_AT_ONCE", at_once)
    for column in (pa.array(texts), pa.array(["before", *texts, "behind"]).slice(1, len(texts)), pa.array(texts[:1])):
        ids, at = encoder.batch_ids(column)
        assert [ids[a:b].tobytes() for a, b in zip(at, at[1:])] == want[: len(column)] and at[0] == 0 and at[-1] == len(ids)


def turned(doc_id, text):
    """The contract, word for word."""
    text = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, h = len(u), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 50:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_middle(spark):
    fill = ("en", "s", 0, 7, "z", 1, "h", 0)
    odd = ["\n", "\n\n\n", "a", "a\n", "\na", "é\r\nß x\x0b\n\n中", "has <M> in it\nx", "<P", "P>\n<S", "\n<\nM>\n<", "x" * 5000 + "\n" + "é\n" * 3000]
    listed = [*rows(), *[(500 + i, t, *fill) for i, t in enumerate(odd * 6)], *[(900 + i, t, *fill) for i, t in enumerate(TEXTS)]]
    docs = frame(spark, listed).repartition(3)
    got = fill_middle.fill_middle(docs)
    assert Counter(map(tuple, got.collect())) == Counter(turned(r[0], r[1]) for r in listed)
    back = got.select("doc_id", fill_middle.restored(got["form"], got["output"]).alias("t"))
    assert Counter(map(tuple, back.collect())) == Counter((r[0], r[1] or "") for r in listed)
    assert fill_middle.fill_middle(frame(spark, [])).count() == 0
    assert {r.form for r in fill_middle.fill_middle(docs, rate=0).collect()} == {"plain"}


def test_fill_middle_equals_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = fill_middle.query(spark, sf_dir)
    want = con.sql(f"select {', '.join(got.columns)} from ({fill_middle.ORACLE_SQL})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_prose_is_cut_at_lines(spark):
    docs = frame(spark, [(i, prose(200, i), "en", "s", 0, 7, "z", 1, "h", 0) for i in range(40)])
    for r in fill_middle.fill_middle(docs).collect():
        marks = re.split("<[PSM]>", r.output)
        assert len(marks) == 4 and sum(map(len, marks)) == len(prose(200, r.doc_id)) and r.form in ("psm", "spm")
