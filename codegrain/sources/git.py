"""Git trees and blobs as Spark sources. Object ids are checked against the bytes."""

from __future__ import annotations

import hashlib
import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_ENTRY = re.compile(rb"(\d{6}) (\w+) ([0-9a-f]{40}) +(-|\d+)\t(.+)", re.S)


class _Tree(DataSourceReader):
    def __init__(self, repository: str, commit: str) -> None:
        self.repository, self.commit = repository, commit

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        raw = subprocess.run(["git", "-C", self.repository, "ls-tree", "-r", "-z", "-l", "--full-tree", self.commit], check=True, capture_output=True).stdout
        seen = set()
        for entry in filter(None, raw.split(b"\0")):
            m = _ENTRY.fullmatch(entry)
            if not m:
                raise ValueError(f"unexpected tree entry {entry[:80]!r}")
            mode, kind, oid, size, path = (g.decode() for g in m.groups())
            if path in seen:
                raise ValueError(f"path {path!r} twice")
            seen.add(path)
            yield path, oid, mode, kind, None if size == "-" else int(size)


class GitTree(DataSource):
    """spark.read.format("git_tree").option("repository", ...).option("commit", ...): a row for each entry of a tree."""

    @classmethod
    def name(cls):
        return "git_tree"

    def schema(self):
        return "path string, git_blob_oid string, mode string, object_type string, size_bytes long"

    def reader(self, schema):
        return _Tree(self.options["repository"], self.options.get("commit", "HEAD"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitTree)


def blob_oid(raw: bytes) -> str:
    return hashlib.sha1(b"blob %d\0" % len(raw) + raw).hexdigest()


class BlobReader:
    """One `git cat-file --batch` process, asked for a blob at a time."""

    def __init__(self, repository: str) -> None:
        self._process = subprocess.Popen(["git", "-C", repository, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def read(self, oid: str, size: int | None = None) -> bytes:
        self._process.stdin.write(oid.encode() + b"\n")
        self._process.stdin.flush()
        head = self._process.stdout.readline().split()
        if len(head) != 3 or head[0].decode() != oid or head[1] != b"blob":
            raise ValueError(f"{oid}: {b' '.join(head)!r}")
        raw = self._process.stdout.read(int(head[2]))
        self._process.stdout.read(1)
        if size is not None and len(raw) != size or blob_oid(raw) != oid:
            raise ValueError(f"{oid}: other bytes than promised")
        return raw

    def close(self) -> None:
        self._process.stdin.close()
        self._process.wait(30)


def with_blobs(tree: DataFrame, repository: str, partitions: int = 8) -> DataFrame:
    """Adds ``raw``; one reading process for each partition. The repository must be reachable from the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = BlobReader(repository)
        try:
            for pdf in batches:
                yield pdf.assign(raw=[reader.read(o, None if pd.isna(s) else int(s)) for o, s in zip(pdf["git_blob_oid"], pdf["size_bytes"])])
        finally:
            reader.close()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tree.schema.fields)
    return tree.where("object_type = 'blob'").repartition(partitions, "git_blob_oid").mapInPandas(run, f"{fields}, raw binary")
