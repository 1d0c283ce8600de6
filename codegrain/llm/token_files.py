"""Operator 11, token ids in binary files with Elias-Fano document boundaries.

Documents are range-sorted by id, equal ids by a hash of the text, so that an id
that a third of all rows share is spread too. Each task encodes its range in
order and cuts files of some FILE_IDS ids, never within a document. Spark's own
text writer puts each file's bytes down, one row to a file: lost tasks are
repeated, and only what its commit lists is ever seen, on any store that Spark
writes to.

A file, all numbers little-endian:

    header   magic, bytes of an id, range, number of the file in its range, documents, ids,
             ids before it in its range, documents without an id, least id
    ids      one after the other, in 2 bytes each where the vocabulary allows, else in 4; padded to words
    ends     Elias-Fano: where documents end among the ids
    doc ids  Elias-Fano: document ids less the least one
    a newline, which the text writer adds and readers leave out

A reader gets any document's place by two select() calls. Files know the ids
before them in their range, so that of all others only the ranges' sums are
needed: digests() takes them from what it reads, and the other readers from a
small table of the files that the first of them puts beside these (``_files``).

Defined results: a null text is empty, and has the end id alone; null ids come
first; repeated ids stand beside each other; texts of any length are encoded
whole, and one above FILE_IDS is a file; an empty table gives no files and no
rows; other columns are never looked at.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrain.llm.common import documents, dropped, mapped, pieces, shared_dir, staged
from codegrain.llm.succinct import EliasFano
from codegrain.llm.tokens import KEPT, PartEncoder
from codegrain.sources.records import exists

END = 1
#: Ids of a file, about; 16 MB.
FILE_IDS = 8 << 20
MAGIC = b"CGTOKEN1"
_HEADER = struct.Struct("<8sIIIIQQQQq")


def dump(ids: np.ndarray, ends: np.ndarray, doc_ids: list[int | None], width: int, part: int, seq: int, before: int) -> bytes:
    """A file's bytes, from all ids in a row and where each document ends among them; ``doc_ids`` in order, nulls first."""
    known = [i for i in doc_ids if i is not None]
    least = known[0] if known else 0
    body = ids.astype(f"<u{width}", copy=False)
    named = np.array([i - least for i in known], np.uint64)
    head = _HEADER.pack(MAGIC, width, part, seq, 0, len(doc_ids), len(ids), before, len(doc_ids) - len(known), least)
    return b"".join([head, body, b"\0" * (-body.nbytes % 8), EliasFano.dump(ends), EliasFano.dump(named)])


class TokenFile:
    """A file's documents, from its bytes, without unpacking more than is asked for."""

    def __init__(self, raw: bytes) -> None:
        magic, self.width, self.part, self.seq, _, self.n_docs, self.n_ids, self.before, self.n_null, self.least = _HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        self._ids = np.frombuffer(raw, f"<u{self.width}", self.n_ids, _HEADER.size)
        size = self.n_ids * self.width
        self._ends, at = EliasFano.load(raw, _HEADER.size + size + -size % 8)
        self._named, _ = EliasFano.load(raw, at)

    def ends(self, nth: np.ndarray) -> np.ndarray:
        return self._ends.select(nth).astype(np.int64)

    def bounds(self) -> np.ndarray:
        """Where all documents begin, and the end."""
        return np.concatenate([np.zeros(1, np.int64), self.ends(np.arange(self.n_docs))])

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + [x + self.least for x in self._named.select(np.arange(self.n_docs - self.n_null)).tolist()]

    def id_range(self) -> tuple[int | None, int | None]:
        """The first and the last document id that isn't null."""
        n = self._named.n
        return tuple(x + self.least for x in self._named.select(np.array([0, n - 1])).tolist()) if n else (None, None)

    def ids(self, start: int, end: int) -> np.ndarray:
        return self._ids[start:end].astype("<u4")

    def find(self, doc_id: int) -> list[tuple[int, int]]:
        """Start and end of every document of an id."""
        out, i = [], self._named.first_at_least(max(doc_id - self.least, 0))
        while i < self._named.n and int(self._named.select(np.array([i]))[0]) + self.least == doc_id:
            k = i + self.n_null
            out.append((int(self.ends(np.array([k - 1]))[0]) if k else 0, int(self.ends(np.array([k]))[0])))
            i += 1
        return out


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, file_ids: int = FILE_IDS, kept: int = KEPT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents into files of the new folder ``path``."""

    def run(batches):
        encoder = PartEncoder.of(tokenizer, kept)
        width = 2 if max(encoder.largest, end) < 1 << 16 else 4
        part, seq, before, n = TaskContext.get().partitionId(), 0, 0, 0
        held, named = [], []  # (ids, ends among all of the file) and document ids

        def row():
            ids, ends = (np.concatenate(x) for x in zip(*held))
            held.clear()
            file = dump(ids, ends, named, width, part, seq, before)
            # The column is the file's own bytes, not a copy.
            column = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, len(file)], np.int32)), pa.py_buffer(file)])
            return pa.RecordBatch.from_arrays([column], ["file"])

        for batch in pieces(batches, "text", 2 << 20):
            ids, at = encoder.batch_ids(batch.column("text"))
            ids, at = np.insert(ids.astype(f"<u{width}", copy=False), at[1:], end), at + np.arange(len(at))
            doc_ids, i = batch.column("doc_id").to_pylist(), 0
            while i < len(doc_ids):
                # The documents that fit into the file, one at least if it is empty.
                j = max(i + (not named), int(np.searchsorted(at, at[i] + file_ids - n, side="right")) - 1)
                if j > i:
                    held.append((ids[at[i] : at[j]], at[i + 1 : j + 1] - at[i] + n))
                    named.extend(doc_ids[i:j])
                    n, i = n + int(at[j] - at[i]), j
                if i < len(doc_ids):
                    yield row()
                    seq, before, n = seq + 1, before + n, 0
                    held, named = [], []
        if named:
            yield row()

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("_tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(F.asc_nulls_first("doc_id"), "_tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "_tie").select("doc_id", "text")
    # Small batches, as the executor has every one outside of its heap too, beside the files that come back.
    # A string column is bytes to Spark's text writer, which adds one newline to each row.
    mapped(ordered, run, "file binary", 2 << 20).select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def _contents(spark: SparkSession, path: str) -> DataFrame:
    """path and content of all files that have any."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 1").select("path", "content")


def _with_base(rows: DataFrame, start: str, n: str) -> DataFrame:
    """``rows`` (staged) whose ``start`` counts from the beginning of their range, counted from that of all. Ranges are as many as the partitions that wrote them."""
    sizes = sorted(rows.groupBy("part").agg(F.max(F.col(start) + F.col(n))).collect())
    bases = list(zip([p for p, _ in sizes], accumulate((n for _, n in sizes), initial=0)))
    bases = F.broadcast(rows.sparkSession.createDataFrame(bases, "part long, _base long"))
    return rows.join(bases, "part").withColumn(start, F.col("_base") + F.col(start)).drop("_base")


def files(spark: SparkSession, path: str) -> DataFrame:
    """By file: path, part, seq, n_docs, n_ids, first_doc, last_doc (of those with an id) and start, the ids of all files before it; made by the first reader."""
    if not exists(spark, f"{path}/_files/_SUCCESS"):

        def run(batches):
            for batch in batches:
                out = []
                for at, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                    f = TokenFile(raw.as_buffer())
                    out.append((at, f.part, f.seq, f.n_docs, f.n_ids, f.before, *f.id_range()))
                names = ("path", "part", "seq", "n_docs", "n_ids", "start", "first_doc", "last_doc")
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], pa.schema([("path", pa.string()), *[(c, pa.int64()) for c in names[1:]]]))

        found = staged(mapped(_contents(spark, path), run, "path string, part long, seq long, n_docs long, n_ids long, start long, first_doc long, last_doc long"), "heads")
        _with_base(found, "start", "n_ids").write.mode("overwrite").parquet(f"{path}/_files")
        dropped(found)
    return spark.read.parquet(f"{path}/_files")


def _bases(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each range: a number for each partition that wrote."""
    return {r[0]: r[1] for r in files(spark, path).groupBy("part").agg(F.min("start")).collect()}


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of the ids as 32-bit numbers) of every document; the files are read once."""

    def run(batches):
        for batch in batches:
            for raw in batch.column("content"):
                f = TokenFile(raw.as_buffer())
                at, named = f.bounds(), f.doc_ids()
                for i, j in _steps(at, 1 << 20):
                    ids, first = f.ids(int(at[i]), int(at[j])), int(at[i])
                    crcs = [zlib.crc32(ids[a - first : b - first]) for a, b in zip(at[i:j].tolist(), at[i + 1 : j + 1].tolist())]
                    cols = [pa.array(named[i:j], pa.int64()), pa.array(np.full(j - i, f.part)), pa.array(at[i:j] + f.before), pa.array(np.diff(at[i : j + 1])), pa.array(crcs, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "part", "start", "n_tokens", "ids_crc32"])

    rows = staged(mapped(_contents(spark, path), run, "doc_id long, part long, start long, n_tokens long, ids_crc32 long"), "digests")
    return _with_base(rows, "start", "n_tokens").select("doc_id", "start", "n_tokens", "ids_crc32")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document."""
    bases = _bases(spark, path)

    def run(batches):
        for batch in batches:
            for raw in batch.column("content"):
                f = TokenFile(raw.as_buffer())
                at, named = f.bounds(), f.doc_ids()
                # The documents of a file in batches of bounded bytes.
                for i, j in _steps(at, 1 << 20):
                    ids = pa.ListArray.from_arrays(pa.array(at[i : j + 1] - at[i], pa.int32()), pa.array(f.ids(int(at[i]), int(at[j])).astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(named[i:j], pa.int64()), pa.array(at[i:j] + bases[f.part] + f.before), pa.array(np.diff(at[i : j + 1])), ids], ["doc_id", "start", "n_tokens", "ids"])

    return mapped(_contents(spark, path), run, "doc_id long, start long, n_tokens long, ids array<long>")


def _steps(at: np.ndarray, most: int):
    """Runs of documents that have ``most`` ids together, or a single one."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, j
        i = j


def lookup(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents of a few ids: only files whose range of ids has one of them are opened."""
    held = files(spark, path).where(F.exists(F.array(*[F.lit(w).cast("long") for w in wanted]), lambda w: (w >= F.col("first_doc")) & (w <= F.col("last_doc"))))
    paths, bases = [r[0] for r in held.select("path").collect()], _bases(spark, path)

    def run(batches):
        for batch in batches:
            for raw in batch.column("content"):
                f = TokenFile(raw.as_buffer())
                found = [(w, bases[f.part] + f.before + a, b - a, f.ids(a, b).tolist()) for w in set(wanted) for a, b in f.find(w)]
                cols = list(zip(*found)) or [[], [], [], []]
                types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "start", "n_tokens", "ids"])

    schema = "doc_id long, start long, n_tokens long, ids array<long>"
    if not paths:
        return spark.createDataFrame([], schema)
    return mapped(spark.read.format("binaryFile").load(paths).select("path", "content"), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/codegrain/token-files-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir), path)
    return digests(spark, path)
