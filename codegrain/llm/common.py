"""What the operators of this subpackage share: folders, staging, word hashing.

Nothing here keeps state between calls but the scratch folder of a session that
has no ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character list for trim() and as a regular expression.
WS_CHARS = " \t\n\x0b\f\r"
WS_REGEX = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = tempfile.mkdtemp(prefix="codegrain-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lineage is cut: a lost executor costs a re-read, not a recomputation, and
    a table that several later steps use is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codegrain/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, and let Spark delete the shuffle files of what was computed before."""
    for df in tables:
        spark = df.sparkSession
        for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if "/codegrain/" in path:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if tables:
        gc.collect()
        spark._jvm.System.gc()


#: Bytes of an Arrow batch that a worker gets, about, and where several operators share the executors' memory.
BATCH_BYTES, SMALL_BATCH = 8 << 20, 2 << 20
#: What drops the values that a process keeps from task to task, and the function whose tasks it had last.
KEPT_VALUES: list = []
_LAST = [""]


def release() -> None:
    """Give memory that is free in this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not in every C library
        pass


def taken_over(by: str) -> None:
    """Drop what this process keeps for the tasks of another function than ``by``."""
    if _LAST[0] != by:
        _LAST[0] = by
        for drop in KEPT_VALUES:
            drop()
        release()


def mapped(df: DataFrame, run, schema: str, most: int = BATCH_BYTES) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of ``most`` bytes, about.

    Workers are kept for later tasks, beside an executor whose own memory is
    fixed; so after its last batch a task gives back what it has freed, and what one
    function's tasks keep for each other goes when a task of another function comes. A
    session keeps the smallest ``most`` it was given; only sizes of batches depend on it.
    """
    name = f"{run.__module__}.{run.__qualname__}"

    @functools.wraps(run)
    def lean(batches):
        taken_over(name)
        try:
            yield from run(batches)
        finally:
            release()

    bound = df.sparkSession.conf
    if int(str(bound.get("spark.sql.execution.arrow.maxBytesPerBatch")).rstrip("b")) > most:
        bound.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    return df.mapInArrow(lean, schema)


def limited(df: DataFrame, most: int, size: str = "1") -> DataFrame:
    """``df``, to be broadcast if its rows' sizes (SQL) add up to ``most`` at most. It should be a staged table, as it is read twice."""
    return F.broadcast(df) if (df.agg(F.sum(F.expr(size))).first()[0] or 0) <= most else df


def row_key(id_col, text_col):
    """A 128-bit key for rows: repeated rows share it, rows of one id but other texts don't."""
    id_col, text_col = (F.col(c) if isinstance(c, str) else c for c in (id_col, text_col))
    return F.unhex(F.md5(F.concat(F.coalesce(F.md5(text_col), F.lit("-")), F.to_json(F.struct(id_col.alias("id"))))))


def fold(doc_id: str, n: int):
    """crc32 of the id's digits modulo n; 0 where the id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(0).cast("long"))


# ---------------------------------------------------------------- words in numpy

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []
KEPT_VALUES.append(_POWERS.clear)
#: Bytes that are hashed at once.
_BLOCK = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2**64, n of each at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its rows; a null row is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space separated words, A-Z lower-cased, in order; and each row's bounds among them.

    A hash is a polynomial over random 64-bit codes of the bytes, taken from
    prefix sums, so that no word becomes a Python object.
    """
    n = len(raw)
    rows = len(bounds) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    solid = ~_SPACE[raw]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    firsts = bounds[:-1][np.diff(bounds) > 0]
    starts[firsts] = solid[firsts]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    lasts = firsts[1:] - 1
    ends[lasts] = solid[lasts]
    if len(firsts) and bounds[-1] == n:
        ends[n - 1] = solid[n - 1]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + _BLOCK)))
        lo, hi = begin[i], end[j - 1]
        up, down = _powers(hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[raw[lo:hi]]] * up[: hi - lo], out=total[1:])
        out[i:j] = (total[end[i:j] - lo] - total[begin[i:j] - lo]) * down[begin[i:j] - lo]
        i = j
    return mix(out), np.searchsorted(begin, bounds)


def pieces(batches, text: str, most: int = 2 << 20):
    """Slices of record batches whose texts have ``most`` bytes at most, or a single row."""
    for batch in batches:
        column = batch.column(text)
        _, bounds = utf8(column)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j
