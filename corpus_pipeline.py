"""From raw documents to packed sequences: five stages, each a table of its own.

quality rules -> near duplicates -> benchmark decontamination -> personal data
-> packing. Each stage reads what its predecessor wrote, so a lost executor
repeats a part of one stage at most.

Defined results of every stage: rows with null texts or ids, empty and very long
texts, repeated rows and extra columns of any name are taken as the operator's
module says; an empty table gives an empty table; all columns but the text stay
as they are, so n_chars remains that of the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codegrain.llm import decontaminate, near_dup, packing, pii, quality_rules
from codegrain.llm.common import staged


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, without the lines above the limits of their host. Null texts fail the rules."""
    return quality_rules.keep(spark, docs)


def _near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates, from a similarity of 0.8 on; of equal rows one. Rows without an id stay."""
    return near_dup.keep(spark, docs, percent=80)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that don't hold too much of the benchmark; those without words hold nothing of it."""
    return decontaminate.keep(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null texts stay null."""
    return pii.redact(docs)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, placed in sequences, a null text as an empty one; fewer token parts are kept, as earlier stages share the executors' memory."""
    return packing.pack(docs, kept=40_000)


STAGES = [("quality_rules", _quality), ("near_dup", _near_dup), ("decontaminate", _decontaminate), ("pii", _redact), ("packing", _pack)]

#: The spans of the conditional random field and the ids of the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
