"""Global order: places of rows, ranks, and the last of one kind of row before each of another.

All rest on one step. Rows are range-sorted, and each is written down with the
number of its range and its place in it. What a range needs of those before it
(how many rows they have, which row came last) is then taken from that table, as
one small row for each range, and never from a second run of the sort, whose
ranges would be others.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrain.sources.staging import small_batches, staged


def _hash(df: DataFrame) -> Column:
    """A hash of a row; of maps, which have no order, nothing goes into it."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


#: Rows of a task that groups or joins what was dealt by a key.
DEALT = 500_000


def dealt_by(df: DataFrame, *key: str, n: int | None = None, rows: int | None = None) -> DataFrame:
    """``df`` (of ``n`` rows; counted where that isn't given) dealt by a key, about ``rows`` (DEALT) of them to a task.

    Spark joins small partitions by their compressed bytes, and 64 MB of those
    can be millions of rows. A number that is asked for stays, and a join and a
    grouping by the key take it over.
    """
    n = df.count() if n is None else n
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // (rows or DEALT))), *key)


def source_order(df: DataFrame, *order: str | Column, name: str = "ordinal", stage=staged) -> DataFrame:
    """Adds the place of each row in the order (UTF-8 bytes for texts), from 0 on without a gap.

    Rows that are equal in ``order`` are put in the order of a hash of all their
    columns, so that a long run of one key is spread too; rows that are equal
    throughout are interchangeable, and stay in one range. Nulls come first. An
    empty table gives an empty table.
    """
    dealt = df.withColumn("_tie", _hash(df)).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    # The number of a row within its partition, and of the partition: both of the run that writes them.
    numbered = dealt.withColumn("_p", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows = stage(numbered, "ordered")
    return _placed(rows, name)


def _placed(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (staged, with _p and _n) with their place among all."""
    sizes = sorted(rows.groupBy("_p").agg(F.count("*")).collect())  # a row for each range
    before = list(zip([p for p, _ in sizes], accumulate((n for _, n in sizes), initial=0)))
    start = F.broadcast(rows.sparkSession.createDataFrame(before, "_p int, _before long"))
    # A range that weren't there would be an error, not rows left out.
    place = F.coalesce(F.col("_before"), F.raise_error(F.lit("a range without a size")).cast("long")) + F.col("_n")
    return rows.join(start, "_p", "left").withColumn(name, place).drop("_p", "_n", "_before")


def ranked(df: DataFrame, *order: str | Column, name: str, stage=staged) -> DataFrame:
    """``df`` with a rank from 1 on: row_number() over all rows, without bringing them to one task."""
    return source_order(df, *order, name=name, stage=stage).withColumn(name, F.col(name) + 1)


def last_before(rows: DataFrame, marks: DataFrame, key: str, at: str, mark_at: str, stage=staged) -> DataFrame:
    """Every row with the last mark of its key that isn't behind it, in one sorted pass.

    ``marks`` are key, ``mark_at`` and any other columns, whose names ``rows``
    doesn't have. Rows and marks are united and range-sorted by key and place,
    marks first. A task carries its last mark on from row to row; the rows before
    a range's first mark take the last one of the ranges before it. Nothing is
    copied, whatever a key's marks are or how far they reach. Rows without such
    a mark, and those without key or place, have nulls in the marks' columns.
    """
    fields = [f for f in marks.schema.fields if f.name != key]
    united = rows.withColumns({"_lb_key": F.col(key), "_lb_at": F.col(at).cast("long"), "_lb_mark": F.lit(False)}).unionByName(
        marks.withColumnRenamed(key, "_lb_key").withColumns({"_lb_at": F.col(mark_at).cast("long"), "_lb_mark": F.lit(True)}), allowMissingColumns=True
    )
    order = ("_lb_key", "_lb_at", F.desc("_lb_mark"), "_lb_tie")
    dealt = united.withColumn("_lb_tie", _hash(rows)).repartitionByRange(*order).sortWithinPartitions(*order).drop("_lb_tie", "_lb_at")
    kept = [f.name for f in rows.schema.fields]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*rows.schema.fields, *fields]) + f", _lb_own {marks.schema[key].dataType.simpleString()}, _lb_p int, _lb_open boolean"

    def run(batches):
        part, carried = TaskContext.get().partitionId(), None  # a table of one row: the last mark and its key

        def out(batch, held, is_open):
            n = batch.num_rows
            cols = [batch.column(c) for c in kept] + held
            return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(n, part, np.int32)), pa.array([is_open] * n, pa.bool_())], [*kept, *names, "_lb_own", "_lb_p", "_lb_open"])

        for batch in batches:
            kinds = [batch.column(c).type for c in kept]
            marked = batch.column("_lb_mark").to_numpy(zero_copy_only=False)
            own = [batch.column(c) for c in (*names, "_lb_key")]
            last = np.maximum.accumulate(np.where(marked, np.arange(len(marked)), -1))
            first = int(np.argmax(marked)) if marked.any() else len(marked)
            head, tail = batch.slice(0, first), batch.filter(pa.array(~marked & (last >= 0)))
            if first:
                held = [c.take(pa.array(np.zeros(first, np.int64))) for c in carried] if carried else [pa.nulls(first, c.type) for c in own]
                yield out(head, held, carried is None)
            if tail.num_rows:
                at_mark = pa.array(last[~marked & (last >= 0)])
                yield out(tail, [c.take(at_mark) for c in own], False)
            if first < len(marked):
                carried = [c.slice(int(last[-1]), 1) for c in own]
        if carried:
            # What this range hands on: a row without any of the columns of rows.
            blank = pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in kinds], kept)
            yield out(blank, carried, None)

    found = stage(small_batches(dealt).mapInArrow(run, schema), "last-before")
    ends = found.where("_lb_open is null").select("_lb_p", "_lb_own", *names)
    # One row for each range: what the ranges before it hand on.
    listed = sorted(ends.collect(), key=lambda r: r[0])
    parts = [r[0] for r in found.where("_lb_open").select("_lb_p").distinct().collect()]
    given = []
    for p in parts:
        before = [r for r in listed if r[0] < p]
        if before:
            given.append((p, *before[-1][1:]))
    handed = F.broadcast(rows.sparkSession.createDataFrame(given, ", ".join([f"_lb_q int, `_h_key` {marks.schema[key].dataType.simpleString()}", *[f"`_h_{f.name}` {f.dataType.simpleString()}" for f in fields]])))
    joined = found.where("_lb_open is not null").join(handed, (F.col("_lb_p") == F.col("_lb_q")) & F.col("_lb_open"), "left")
    same = F.coalesce(F.when(F.col("_lb_open"), F.col("_h_key")).otherwise(F.col("_lb_own")) == F.col(key), F.lit(False)) & F.col(at).isNotNull()
    value = lambda c: F.when(same, F.when(F.col("_lb_open"), F.col(f"_h_{c}")).otherwise(F.col(c))).alias(c)
    return joined.select(*[F.col(c) for c in kept], *[value(c) for c in names])
