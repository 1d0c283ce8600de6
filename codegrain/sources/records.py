"""JSON records: strict and lenient reading, canonical writing, publishing in one step."""

from __future__ import annotations

import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegrain.functions.json_rules import object_fault
from codegrain.functions.text import json_error


def _lines(spark: SparkSession, path: str, canonical: bool) -> DataFrame:
    """value, fault, file, block, at: lines split at newlines only, read in byte ranges; ``at`` rises with a range's lines."""
    value = F.col("value")
    fault = object_fault(value)
    if canonical:
        fault = F.coalesce(fault, json_error(True)(value))
    own = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    return spark.read.text(path, lineSep="\n").select("value", fault.alias("fault"), *own, F.monotonically_increasing_id().alias("at"))


#: A byte order mark; files whose first bytes are looked at together.
MARK, LOOKS = "\ufeff", 32


def marked(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """The files that begin with a byte order mark, and whether they have nothing else.

    Hadoop's line reader drops a mark at the start of a file, so no line shows
    it. The driver reads four bytes of each file, unpacked.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def look(name: str) -> tuple[str, bytes]:
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        codec, raw = codecs.getCodec(at), at.getFileSystem(conf).open(at)
        try:
            # -1 at the end of a file, which no byte is.
            stream, begun = codec.createInputStream(raw) if codec else raw, []
            while len(begun) < 4 and (byte := stream.read()) >= 0:
                begun.append(byte)
            return name, bytes(begun)
        finally:
            raw.close()

    with ThreadPoolExecutor(LOOKS) as pool:
        firsts = list(pool.map(look, spark.read.text(path).inputFiles()))
    return [(name, len(first) == 3) for name, first in firsts if first.startswith(MARK.encode())]


def read_strict(spark: SparkSession, path: str, schema: str | T.StructType, canonical: bool = False) -> DataFrame:
    """Records of a JSONL file; a line that isn't a strict (or canonical) object of the schema is an error.

    Repeated keys, byte order marks, carriage returns, blank lines, bytes that
    aren't UTF-8 and NaN are rejected, which the built-in reader lets pass. A file
    is read in byte ranges by several tasks, and checked in the JVM; only
    ``canonical`` sends lines through an Arrow UDF besides.
    """
    lines, wrong = _lines(spark, path, canonical), [name for name, _ in marked(spark, path)]
    if wrong:
        raise ValueError(f"{wrong[0]}: byte order mark")
    checked = F.when(F.col("fault").isNotNull(), F.raise_error(F.concat(F.col("file"), F.lit(": "), F.col("fault")))).otherwise(F.col("value"))
    return lines.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_lenient(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def faults(spark: SparkSession, path: str, canonical: bool = False) -> DataFrame:
    """value, fault, file, line: the lines that read_strict() would reject, why, and where (lines from 1).

    A line's number is its place in its byte range plus the lines of the ranges
    before it in the file. Places and sizes are of two passes over one listing of
    files, which Spark cuts alike; were a range read by another task, it is an error.
    A byte order mark that a file begins with is put back to its first line.
    """
    lines, starts = _lines(spark, path, canonical), marked(spark, path)
    ranges = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # Spark writes an empty authority in one place and not in the other.
    plain = F.regexp_replace("file", "^([^:/]+):///", "$1:/")
    opening = plain.isin([re.sub("^([^:/]+):///", r"\1:/", name) for name, _ in starts]) & (F.col("block") == 0)
    found = lines.where(F.col("fault").isNotNull() | opening).join(ranges, ["file", "block"], "left")
    task = lambda c: F.shiftright(c, 33)
    moved = F.col("first").isNull() | (task(F.col("at")) != task(F.col("first")))
    line = F.when(moved, F.raise_error(F.concat(F.col("file"), F.lit(": read in other ranges")))).otherwise(F.col("before") + F.col("at") - F.col("first") + 1)
    begins, whole = opening & (F.col("at") == F.col("first")), F.concat(F.lit(MARK), "value")
    value, fault = F.when(begins, whole).otherwise(F.col("value")), F.when(begins, object_fault(whole)).otherwise(F.col("fault"))
    out = found.select(value.alias("value"), fault.alias("fault"), "file", line.cast("long").alias("line")).where("fault is not null")
    bare = [(MARK, "byte order mark", name, 1) for name, only in starts if only]
    return out.unionByName(spark.createDataFrame(bare, out.schema)) if bare else out


def canonical_lines(df: DataFrame) -> DataFrame:
    """One column, ``value``: each row as canonical JSON."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("value"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def write_canonical(df: DataFrame, path: str, order: list[str]) -> None:
    """A folder of sorted JSONL parts, made beside ``path`` and renamed to it when complete."""
    publish(df.sparkSession, path, lambda at: canonical_lines_sorted(df, order).write.text(at))


def canonical_lines_sorted(df: DataFrame, order: list[str]) -> DataFrame:
    return canonical_lines(df.orderBy(*order))


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def publish(spark: SparkSession, path: str, write, frozen_by: str | None = None) -> None:
    """Write to a staging folder with ``write(folder)``, then rename it to ``path``.

    Nothing is overwritten, and nothing is written once the results in
    ``frozen_by`` exist.
    """
    if frozen_by and exists(spark, frozen_by):
        raise FileExistsError(f"{frozen_by} exists; what it was made from is frozen")
    if exists(spark, path):
        raise FileExistsError(path)
    # A name of its own, so that two writers don't meet; the second can't rename.
    staging = f"{path.rstrip('/')}.{uuid.uuid4().hex}.staging"
    fs, p, jvm = _fs(spark, staging)
    write(staging)
    if exists(spark, path):
        fs.delete(p, True)
        raise FileExistsError(path)
    if not fs.rename(p, jvm.org.apache.hadoop.fs.Path(path)):
        raise OSError(f"{staging} could not be renamed")


def count_folders(spark: SparkSession, path: str) -> int:
    """How many folders, those in the making left out, a folder has; 0 if it isn't there."""
    fs, p, _ = _fs(spark, path)
    return sum(1 for x in fs.listStatus(p) if x.isDirectory() and not x.getPath().getName().endswith(".staging")) if fs.exists(p) else 0


def write_one(df: DataFrame, path: str, order: list[str]) -> None:
    """One file of canonical JSON lines in order, in the place of an older one: sorted in parallel, its parts joined one after the other."""
    spark = df.sparkSession
    fs, final, jvm = _fs(spark, path)
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.parts")
    whole = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.whole")
    canonical_lines_sorted(df, order).write.text(folder.toString())
    out = fs.create(whole)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for part in sorted(str(x.getPath().toString()) for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-")):
        source = fs.open(jvm.org.apache.hadoop.fs.Path(part))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
        source.close()
    out.close()
    fs.delete(folder, True)
    fs.delete(final, False)
    if not fs.rename(whole, final):
        raise OSError(f"{path} could not be written")


def pretty(value) -> str:
    """JSON for people: sorted keys, two blanks, a newline at the end."""
    return json.dumps(value, ensure_ascii=False, allow_nan=False, indent=2, sort_keys=True) + "\n"


def write_pretty(spark: SparkSession, path: str, value) -> None:
    """A small object as pretty JSON, in the place of an older one."""
    fs, final, jvm = _fs(spark, path)
    new = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
    out = fs.create(new)
    out.write(bytearray(pretty(value).encode()))
    out.close()
    fs.delete(final, False)
    if not fs.rename(new, final):
        raise OSError(f"{path} could not be written")


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, such as a prompt, as a whole: UTF-8 without a byte order mark, and not blank."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if text.startswith("\ufeff") or not text.strip():
        raise ValueError(f"{path}: blank, or with a byte order mark")
    return text
