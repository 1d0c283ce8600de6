"""Chunks and batches: exact partitions, coalescing, and the four packing policies."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codegrain.functions.text import canonical_json, hex_id, line_windows
from codegrain.operators.ordering import source_order
from codegrain.sources.staging import small_batches, staged


def windows(docs: DataFrame, cap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Line windows of every text: id, ordinal, spans in bytes and characters, n_bytes, sha256 of the content, newlines in it, and whether it ends with one."""
    w = small_batches(docs).select(id_col, text_col, F.posexplode(line_windows(cap)(F.col(text_col))).alias("ordinal", "w"))
    part = F.substring(F.col(text_col), (F.col("w.start_char") + 1).cast("int"), (F.col("w.end_char") - F.col("w.start_char")).cast("int"))
    return w.select(id_col, F.col("ordinal").cast("long").alias("ordinal"), "w.*", (F.col("w.end_byte") - F.col("w.start_byte")).alias("n_bytes"), F.sha2(part, 256).alias("sha"), (F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit("")))).cast("long").alias("n_breaks"), part.endswith("\n").alias("ends_line"))


def line_points(spans: DataFrame, key: str) -> DataFrame:
    """``spans`` that follow each other, with start_line, end_line (of the last character) and end_point_line (of the place behind it), from 1."""
    before = F.coalesce(F.sum("n_breaks").over(Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = spans.withColumn("start_line", (before + 1).cast("long"))
    end = F.col("start_line") + F.col("n_breaks")
    return placed.withColumn("end_line", end - F.col("ends_line").cast("long")).withColumn("end_point_line", end)


def partition_faults(spans: DataFrame, sizes: DataFrame, key: str, start: str, end: str, size: str) -> DataFrame:
    """Per key the number of spans, of gaps or overlaps, and whether the last span ends where the whole does."""
    order = Window.partitionBy(key).orderBy(start)
    ran = spans.withColumn("_before", F.coalesce(F.lag(end).over(order), F.lit(0)))
    per = ran.groupBy(key).agg(F.count("*").alias("n_spans"), F.sum((F.col(start) != F.col("_before")).cast("long")).alias("n_faults"), F.max(end).alias("_last"))
    return sizes.join(per, key, "left").select(
        key, F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("n_faults", F.lit(0)).alias("n_faults"), (F.coalesce("_last", F.lit(0)) == F.col(size)).alias("covers")
    )


def identities(chunks: DataFrame, domain: str, prefix: str, key: str, *fields: str) -> DataFrame:
    """Adds ``chunk_id`` from the canonical JSON of the fields."""
    return chunks.withColumn("chunk_id", hex_id(prefix, F.lit(domain), canonical_json(**{f: F.col(f) for f in (key, *fields)})))


def coalesce(spans: list[dict], cap: int) -> list[dict]:
    """Sorted spans (start, end, kind, protected) coalesced by a left fold.

    A span joins its merged predecessor when they touch, fit in ``cap`` together
    and neither is protected; kinds are united in order of appearance.
    """
    out: list[dict] = []
    for s in spans:
        last = out[-1] if out else None
        if last and last["end"] == s["start"] and s["end"] - last["start"] <= cap and not last["protected"] and not s["protected"]:
            last["end"], last["parts"] = s["end"], last["parts"] + 1
            last["kinds"] = list(dict.fromkeys([*last["kinds"], s["kind"]]))
        else:
            out.append({"start": s["start"], "end": s["end"], "kinds": [s["kind"]], "parts": 1, "protected": s["protected"]})
    return out


def coalesce_sizes(cap: int):
    """An Arrow UDF: the sizes of spans that follow each other (b, kind, protected) to coalesced spans with their places."""

    @F.pandas_udf("array<struct<start:long,end:long,kinds:string,parts:long>>")
    def run(rows: pd.Series) -> pd.Series:
        def one(listed):
            at, placed = 0, []
            for x in listed if listed is not None else ():
                placed.append({"start": at, "end": at + x["b"], "kind": x["kind"], "protected": x["protected"]})
                at += x["b"]
            return [{"start": o["start"], "end": o["end"], "kinds": "+".join(o["kinds"]), "parts": o["parts"]} for o in coalesce(placed, cap)]

        return rows.map(one)

    return run


def interval_union(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Per key the length that the half-open intervals cover together."""
    order = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(F.max(end).over(order), F.col(start))))
    return spans.withColumn("_new", fresh).groupBy(key).agg(F.count("*").alias("n_spans"), F.sum("_new").cast("long").alias("covered"))


# ---------------------------------------------------------------- packing


def _jumps(after: np.ndarray, cap: int) -> np.ndarray:
    """For each item, taken as the first of a batch, the first that doesn't fit in any more; ``after`` are the sums before each and of all."""
    return np.searchsorted(after, after[:-1] + cap, side="right") - 1


def _walk(sizes: np.ndarray, cap: int, fill: int) -> tuple[np.ndarray, int]:
    """Batches' offsets of items in next-fit from an open batch that holds ``fill``; and the fill at the end.

    The firsts of batches are found by doubling: what 2, 4, 8 ... jumps lead to.
    """
    n = len(sizes)
    after = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    first = int(np.searchsorted(after, cap - fill, side="right")) - 1
    if first >= n:
        return np.zeros(n, np.int64), fill + int(after[n])
    jump = np.append(_jumps(after, cap), n)
    firsts = np.array([first])
    while firsts[-1] < n:
        firsts = np.concatenate([firsts, jump[firsts]])
        jump = jump[jump]
    firsts = firsts[firsts < n]
    opened = np.zeros(n, np.int64)
    opened[firsts] = 1
    return np.cumsum(opened), int(after[n] - after[firsts[-1]])


class Passage:
    """What a run of items does to any open batch: from a fill of ``least`` on, the ``fill`` at its end and how many batches it ``closed``; ``total`` is added where it closed none.

    Passages of runs that follow each other compose, and composing is
    associative, so that any number of runs can be joined in any grouping.
    """

    SCHEMA = "least array<long>, fill array<long>, closed array<long>, total long"

    def __init__(self, least: np.ndarray, fill: np.ndarray, closed: np.ndarray, total: int) -> None:
        same = np.zeros(len(least), bool)
        same[1:] = (closed[1:] > 0) & (fill[1:] == fill[:-1]) & (closed[1:] == closed[:-1])
        self.least, self.fill, self.closed, self.total = least[~same], fill[~same], closed[~same], int(total)

    @classmethod
    def of(cls, sizes: np.ndarray, cap: int) -> "Passage":
        """Of a run's items. A fill only decides which item opens the first new batch; all walks that open one there are one walk."""
        n = len(sizes)
        after = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        end = np.append(_jumps(after, cap), n)
        closed = (end < n).astype(np.int64)
        end = np.where(end < n, end, np.arange(n + 1))  # a batch that nothing closes stays open
        while True:
            further = end[end]
            if (further == end).all():
                break
            closed, end = closed + closed[end], further
        # The first item that doesn't fit, for each fill at which that is another one.
        least = np.unique(np.clip(np.append(0, cap - after[1:] + 1), 0, cap))
        first = np.searchsorted(after, cap - least, side="right") - 1
        fits = first >= n
        return cls(least, np.where(fits, 0, after[n] - after[end[first]]), np.where(fits, 0, 1 + closed[first]), int(after[n]))

    def after(self, fill: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fills at the end, and batches closed, from these fills."""
        row = np.searchsorted(self.least, fill, side="right") - 1
        return np.where(self.closed[row] > 0, self.fill[row], fill + self.total), self.closed[row]

    def then(self, other: "Passage") -> "Passage":
        """Of this run and the one behind it."""
        most = int(self.least[1]) if len(self.least) > 1 and not self.closed[0] else None
        shifted = other.least - self.total if not self.closed[0] else np.zeros(0, np.int64)
        shifted = shifted[(shifted > 0) & (shifted < most if most is not None else True)]
        least = np.unique(np.concatenate([self.least, shifted]))
        middle, closed = self.after(least)
        fill, more = other.after(middle)
        return Passage(least, fill, closed + more, self.total + other.total)

    def row(self) -> dict:
        return {"least": self.least, "fill": self.fill, "closed": self.closed, "total": self.total}

    @classmethod
    def read(cls, row: dict) -> "Passage":
        return cls(*(np.asarray(row[c], np.int64) for c in ("least", "fill", "closed")), row["total"])


#: Items of a block; blocks that are composed in one step.
BLOCK_ITEMS, FAN = 250_000, 64


def _composed(level: DataFrame) -> DataFrame:
    """The passages of FAN neighbours as one each: one step up."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        one = reduce(Passage.then, map(Passage.read, pdf.sort_values("block").to_dict("records")))
        return pd.DataFrame([{"block": int(key[0]), **one.row()}])

    return level.groupBy(F.floor(F.col("block") / FAN)).applyInPandas(run, f"block long, {Passage.SCHEMA}")


def _begun(level: DataFrame, starts: DataFrame) -> DataFrame:
    """How each of a level's runs begins (block, fill, batch), from how the runs of FAN of them do: one step down."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fill, batch, out = int(pdf["start_fill"].iloc[0]), int(pdf["start_batch"].iloc[0]), []
        for row in pdf.sort_values("block").to_dict("records"):
            out.append((row["block"], fill, batch))
            (fill,), (closed,) = Passage.read(row).after(np.array([fill]))
            batch += int(closed)
        return pd.DataFrame(out, columns=["block", "fill", "batch"])

    above = starts.select(F.col("block").alias("_of"), F.col("fill").alias("start_fill"), F.col("batch").alias("start_batch"))
    return level.join(above, F.floor(F.col("block") / FAN) == F.col("_of")).groupBy("_of").applyInPandas(run, "block long, fill long, batch long")


def next_fit(items: DataFrame, order_col: str, size_col: str, cap: int, block: int = BLOCK_ITEMS, stage=staged) -> DataFrame:
    """Next-fit in the order of a column: ``items`` with ``batch_ordinal``.

    Items get their places and are cut into blocks of ``block`` by them. Of each
    block a task makes its passage, what it does to any batch that is open before
    it. Passages are composed FAN at a time, level by level, until one is left;
    then, level by level down, each block learns how it begins, and all blocks
    are walked at once, in streams. The driver holds no table of blocks. Items
    above ``cap``, below nought, or without a size or an order are an error;
    items of one order are taken by size. An empty table gives an empty table.
    """
    size = F.col(size_col).cast("long")
    bad = (size > cap) | (size < 0) | size.isNull() | F.col(order_col).isNull()
    n, n_bad = items.agg(F.count("*"), F.coalesce(F.sum(bad.cast("long")), F.lit(0))).first()
    if n_bad:
        raise ValueError(f"{n_bad} items are larger than {cap}, below nought, or without a size or an order")
    placed = source_order(items, order_col, size_col, name="_place", stage=stage).withColumn("_block", F.floor(F.col("_place") / block))

    def effect(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"block": int(key[0]), **Passage.of(pdf.sort_values("_place")["_size"].to_numpy(np.int64), cap).row()}])

    levels = [stage(placed.select("_block", "_place", size.alias("_size")).groupBy("_block").applyInPandas(effect, f"block long, {Passage.SCHEMA}"), "passages")]
    runs = -(-n // block)
    while runs > FAN:
        levels.append(stage(_composed(levels[-1]), "passages"))
        runs = -(-runs // FAN)
    starts = items.sparkSession.createDataFrame([(0, 0, 0)], "block long, fill long, batch long")
    for level in reversed(levels):
        starts = _begun(level, starts)

    names = items.columns

    def assign(batches):
        now, fill, batch = None, 0, 0
        for rows in batches:
            blocks, sizes = rows.column("_block").to_numpy(), rows.column("_size").to_numpy()
            out = np.empty(len(blocks), np.int64)
            # Runs of one block within the rows; a block may go on in the next ones.
            edges = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]]) if len(blocks) else [0]
            for i, j in zip(edges[:-1], edges[1:]):
                if blocks[i] != now:
                    now, fill, batch = blocks[i], rows.column("fill")[int(i)].as_py(), rows.column("batch")[int(i)].as_py()
                offsets, fill = _walk(sizes[i:j], cap, fill)
                out[i:j] = batch + offsets
                batch = int(out[j - 1])
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in names], pa.array(out)], [*names, "batch_ordinal"])

    begun = starts.withColumnRenamed("block", "_block")
    # By block and fill, of which a block has one: a repartition by what the join goes by would be taken out as needless, and
    # the join's own exchange may be read by other bounds at run time.
    dealt = placed.withColumn("_size", size).join(begun, "_block").repartition("_block", "fill").sortWithinPartitions("_block", "_place")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", batch_ordinal long"
    return dealt.drop("_place").mapInArrow(assign, schema)


def pack_skip(cap: int, extra: int = 0):
    """An expression over an ordered array of sizes: the positions that are taken when what doesn't fit is passed over. ``extra`` is paid for every item."""

    def positions(sizes):
        start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("took"))

        def step(a, x):
            fits = a["used"] + x + extra <= cap
            return F.struct(F.when(fits, a["used"] + x + extra).otherwise(a["used"]).cast("long").alias("used"), (a["i"] + 1).alias("i"), F.when(fits, F.array_append(a["took"], a["i"])).otherwise(a["took"]).alias("took"))

        return F.aggregate(F.coalesce(sizes, F.array().cast("array<bigint>")), start, step, lambda a: a["took"])

    return positions


def budget_prefix(df: DataFrame, key: str, order: list[str], size: str, cap: int, first: int = 1, extra: int = 1) -> DataFrame:
    """The rows of each key up to the first that goes over: ``first`` plus size and ``extra`` for every row."""
    w = Window.partitionBy(key).orderBy(*order)
    running = df.withColumn("_used", F.sum(F.col(size) + extra).over(w.rowsBetween(Window.unboundedPreceding, 0)) + first)
    # Sizes aren't negative, so the running sum never comes back under the cap.
    return running.where(F.col("_used") <= cap).drop("_used")


def pop_tail(df: DataFrame, key: str, order: list[str], size: str, cap: int) -> DataFrame:
    """What is left of each key when rows are dropped from the end until the sum fits."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_used", F.sum(size).over(w)).where(F.col("_used") <= cap).drop("_used")
