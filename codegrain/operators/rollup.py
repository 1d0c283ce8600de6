"""Roll-ups of runs: telemetry, handoff, statuses, finding ids, hashes of sets."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codegrain.functions.text import collapse_space
from codegrain.operators.ordering import source_order
from codegrain.sources.staging import staged


def telemetry(calls: DataFrame, agent: str, n_bytes: str, order: str) -> DataFrame:
    """By agent: calls, bytes, highest ordinal."""
    return calls.groupBy(agent).agg(F.count("*").alias("calls"), F.sum(n_bytes).cast("long").alias("bytes"), F.max(order).alias("max_turn"))


def handoff(calls: DataFrame, batch: str, ordinal: str, n_bytes: str) -> DataFrame:
    """One row: bytes if every later call resent its batch's first evidence, bytes sent instead, and the reduction in percent."""
    per = calls.groupBy(batch).agg(
        F.sum(F.when(F.col(ordinal) == 0, F.col(n_bytes))).alias("first"), F.count(F.when(F.col(ordinal) > 0, 1)).alias("later"), F.sum(F.when(F.col(ordinal) > 0, F.col(n_bytes))).alias("sent")
    )
    total = per.agg(F.coalesce(F.sum(F.col("first") * F.col("later")), F.lit(0)).alias("baseline_bytes"), F.coalesce(F.sum("sent"), F.lit(0)).alias("proposed_bytes"))
    saved = F.col("baseline_bytes") - F.col("proposed_bytes")
    return total.select("baseline_bytes", "proposed_bytes", saved.alias("avoided_bytes"), F.when(F.col("baseline_bytes") == 0, F.lit(0.0)).otherwise(F.round(100 * saved / F.col("baseline_bytes"), 2)).alias("reduction_percent"))


def batch_status(findings: DataFrame, key: str, verified: Column, inconclusive: Column) -> DataFrame:
    """By key: CLEAR without findings, else whether any is verified, any inconclusive, or none."""
    per = findings.groupBy(key).agg(F.count(verified).alias("n"), F.max(F.coalesce(verified, F.lit(False))).alias("v"), F.max(F.coalesce(inconclusive, F.lit(False))).alias("i"))
    status = F.when(F.col("n") == 0, "CLEAR").when(F.col("v"), "HAS_VERIFIED").when(F.col("i"), "INCONCLUSIVE").otherwise("NO_VERIFIED")
    return per.select(key, F.col("n").alias("n_findings"), status.alias("status"))


def finding_id(batch: Column, ordinal: Column, title: Column) -> Column:
    """20 hex digits from batch, ordinal and the lower-cased, collapsed title."""
    return F.substring(F.sha2(F.concat_ws("\0", batch.cast("string"), ordinal.cast("string"), F.lower(collapse_space(title))), 256), 1, 20)


def prefix_delta(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds ``delta``, the growth of a cumulative counter between ordered stages."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def prefix_faults(df: DataFrame, key: str, order: str, value: str, total: str) -> DataFrame:
    """Keys whose cumulative counter falls somewhere, or doesn't add up to their total."""
    per = prefix_delta(df, key, order, value).groupBy(key).agg(F.min("delta").alias("least"), F.sum("delta").alias("sum"), F.max(total).alias("total"))
    return per.where((F.col("least") < 0) | (F.col("sum") != F.col("total")))


def ordered_hash(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """By key: sha256 of the values in order, joined by NUL, and their number.

    A hash of this kind takes its values one after the other, so a key is one
    task's work; but that streams over them, sorted, and holds a batch of them at
    a time, whatever the key's size. tree_hash() is the digest for sets that one
    task should not read. Null values are left out of the text, and counted.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = df.select(*key, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(value).cast("string").alias("_v"))
    by = [f"_o{i}" for i in range(len(order))]
    # By a hash of the key too: a repartition by the key alone would be taken out where rows already lie by it.
    dealt = rows.repartition(*key, F.xxhash64(*key)).sortWithinPartitions(*key, *by).select(*key, "_v")

    def run(batches):
        now, state, n, some = None, None, 0, False

        def row():
            return pa.RecordBatch.from_arrays([*[pa.array([x], t) for x, t in zip(now, types)], pa.array([state.hexdigest()]), pa.array([n], pa.int64())], [*key, "ordered_hash", "n"])

        for batch in batches:
            columns = [batch.column(c) for c in key]
            types = [c.type for c in columns]
            keys, values = list(zip(*[c.to_pylist() for c in columns])), batch.column("_v").to_pylist()
            for k, v in zip(keys, values):
                if k != now:
                    if now is not None:
                        yield row()
                    now, state, n, some = k, hashlib.sha256(), 0, False
                n += 1
                if v is not None:
                    state.update(b"\0" + v.encode() if some else v.encode())
                    some = True
        if now is not None:
            yield row()

    return dealt.mapInArrow(run, ", ".join(f"`{k}` {fields[k]}" for k in key) + ", ordered_hash string, n long")


def tree_hash(df: DataFrame, key: str, order: list[str], value: str, leaf: int = 4096, stage=staged) -> DataFrame:
    """By key: the sha256 of the hashes, in order and joined by NUL, of each ``leaf`` values in order, joined by NUL; and the values' number.

    Another digest than ordered_hash(), which any number of tasks share: values
    get their places, a leaf is a row of bounded size, and what comes together
    for a key is one hash for each of its leaves. Null values are left out of the
    text, and take a place.
    """
    placed = source_order(df.select(key, *order, F.col(value).cast("string").alias("_v")), key, *order, name="_place", stage=stage)
    first = placed.groupBy(F.col(key).alias("_k")).agg(F.min("_place").alias("_first"))
    nth = placed.join(first, F.col(key).eqNullSafe(F.col("_k"))).withColumn("_nth", F.col("_place") - F.col("_first"))
    listed = lambda by, x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, x))), lambda y: y[x]), "\0")
    leaves = nth.groupBy(key, F.floor(F.col("_nth") / leaf).alias("_leaf")).agg(F.sha2(listed("_nth", "_v"), 256).alias("_h"), F.count("*").alias("_n"))
    return leaves.groupBy(key).agg(F.sha2(listed("_leaf", "_h"), 256).alias("tree_hash"), F.sum("_n").alias("n"))


def bundle_hash(parts: DataFrame, name: str, digest: str, domain: str) -> DataFrame:
    """One row: sha256 of the domain and the canonical JSON of {name: digest}."""
    listed = F.array_sort(F.collect_list(F.struct(name, digest)))
    text = F.concat(F.lit(domain + "\0"), F.lit("{"), F.array_join(F.transform(listed, lambda x: F.concat(F.lit('"'), x[name], F.lit('":"'), x[digest], F.lit('"'))), ","), F.lit("}"))
    return parts.agg(F.sha2(text, 256).alias("bundle_sha256"), F.count("*").alias("n"))
