"""Telemetry as a stream: append-only JSONL files, rolled up as they come, resumable from a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = (
    "agent string, purpose string, batch_id string, batch_ordinal long, finding_id string, prompt_eval_count long, eval_count long, evidence_utf8_bytes long, evidence_chunk_ids array<string>"
)


def read(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).json(folder)


def roll_up(calls: DataFrame) -> DataFrame:
    """By agent and purpose: calls, tokens, evidence bytes."""
    return calls.groupBy("agent", "purpose").agg(
        F.count("*").alias("calls"), F.coalesce(F.sum("prompt_eval_count"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("eval_count"), F.lit(0)).alias("output_tokens"), F.coalesce(F.sum("evidence_utf8_bytes"), F.lit(0)).alias("evidence_bytes")
    )


def start(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's partial roll-up to a folder of its own.

    A batch that is run again after a failure overwrites its own folder, so a
    call is counted once; totals() adds the partial roll-ups.
    """

    def write(batch: DataFrame, number: int) -> None:
        roll_up(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return read(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, out: str) -> DataFrame:
    parts = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    return parts.groupBy("agent", "purpose").agg(*[F.sum(c).alias(c) for c in ("calls", "prompt_tokens", "output_tokens", "evidence_bytes")])


def windowed(events: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: event counts by tumbling window, late rows dropped after the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
