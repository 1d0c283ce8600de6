"""Rules and the capped, explainable priority score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrain.operators import ordering
from codegrain.sources.staging import staged

# Names of C functions that deserve a look, with category and weight.
SENSITIVE = (
    ("strcpy", "memory_string", 12),
    ("strcat", "memory_string", 12),
    ("sprintf", "memory_string", 10),
    ("vsprintf", "memory_string", 10),
    ("gets", "memory_string", 14),
    ("memcpy", "memory_copy", 7),
    ("memmove", "memory_copy", 6),
    ("memset", "memory_copy", 3),
    ("sscanf", "formatted_parse", 7),
    ("scanf", "formatted_parse", 7),
    ("fscanf", "formatted_parse", 6),
    ("read", "external_input", 5),
    ("recv", "external_input", 7),
    ("recvfrom", "external_input", 7),
    ("fread", "external_input", 5),
    ("getline", "external_input", 4),
    ("getenv", "external_input", 4),
    ("open", "file_path", 4),
    ("fopen", "file_path", 4),
    ("stat", "file_path", 3),
    ("lstat", "file_path", 4),
    ("unlink", "file_path", 4),
    ("rename", "file_path", 4),
    ("system", "command_exec", 15),
    ("popen", "command_exec", 14),
    ("execl", "command_exec", 15),
    ("execv", "command_exec", 15),
    ("execve", "command_exec", 15),
    ("execvp", "command_exec", 15),
    ("malloc", "memory_lifetime", 4),
    ("calloc", "memory_lifetime", 4),
    ("realloc", "memory_lifetime", 6),
    ("free", "memory_lifetime", 3),
    ("strlen", "size_handling", 3),
    ("strtol", "numeric_parse", 4),
    ("strtoul", "numeric_parse", 4),
    ("atoi", "numeric_parse", 4),
    ("ioctl", "device_boundary", 7),
)
# Prefixes that count where no name matches, in this order.
SENSITIVE_PREFIXES = (("exec", "command_exec", 13), ("strto", "numeric_parse", 4))
# Caps and factors of the score's components.
CAPS = {"sensitive": (45, 1), "cross_file": (20, 4), "indirect": (15, 5), "ambiguous": (10, 2), "calls": (10, 1)}


def exact_rules() -> dict[str, tuple[str, int]]:
    return {name: (category, w) for name, category, w in SENSITIVE}


def rule(name: Column, exact: dict[str, tuple[str, int]], prefixes=()) -> Column:
    """struct(category, weight) of a name: an exact rule after any ``::``, else the first prefix rule, else null.

    The rules are a literal map in the plan; nothing is joined.
    """
    simple = F.trim(F.substring_index(name, "::", -1))
    one = lambda c, w: F.struct(F.lit(c).alias("category"), F.lit(w).cast("long").alias("weight"))
    table = F.create_map(*[x for n, (c, w) in exact.items() for x in (F.lit(n), one(c, w))]) if exact else None
    found = F.element_at(table, simple) if exact else F.lit(None)
    for p, c, w in prefixes:
        found = F.coalesce(found, F.when(simple.startswith(p), one(c, w)))
    return found


def score(components: dict[str, Column]) -> dict[str, Column]:
    """Each component under its cap, and ``priority_score``, their sum."""
    out = {k: F.least(F.lit(cap), F.lit(factor) * components[k]).cast("long") for k, (cap, factor) in CAPS.items()}
    total = sum(out.values(), F.lit(0).cast("long"))
    return {**out, "priority_score": total}


def priority(calls: DataFrame, batch: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Scores of batches from their calls (weight, target, is_cross, is_indirect, is_ambiguous): one grouped pass."""
    per = calls.groupBy(batch).agg(
        F.sum(F.coalesce("weight", F.lit(0))).alias("sensitive_w"),
        F.countDistinct(F.when(F.col("is_cross"), F.col("target"))).alias("cross_file_target_count"),
        F.sum(F.col("is_indirect").cast("long")).alias("indirect_dynamic_call_count"),
        F.sum(F.col("is_ambiguous").cast("long")).alias("ambiguous_resolution_count"),
        F.count("*").alias("call_count"),
        *[F.expr(e) for e in extra],
    )
    cols = score({"sensitive": F.col("sensitive_w"), "cross_file": F.col("cross_file_target_count"), "indirect": F.col("indirect_dynamic_call_count"), "ambiguous": F.col("ambiguous_resolution_count"), "calls": F.col("call_count")})
    return per.select("*", *[c.alias(f"score_{k}" if k != "priority_score" else k) for k, c in cols.items()])


def ranked(scores: DataFrame, id_col: str, score_col: str = "priority_score", stage=staged) -> DataFrame:
    """Adds ``priority_rank``: by falling score, then id, 1 to N. Rows of one score, however many, are spread like all others."""
    rows = ordering.ranked(scores, F.desc(score_col), id_col, name="priority_rank", stage=stage)
    return rows.withColumn("priority_rank", F.col("priority_rank").cast("long"))


def hash_rank(df: DataFrame, id_col: str, domain: str, seed: str) -> DataFrame:
    """Adds ``rank_hash``, the reproducible order of a sample."""
    return df.withColumn("rank_hash", F.sha2(F.concat_ws("\0", F.lit(domain), F.lit(seed), F.col(id_col).cast("string")), 256))


def hash_sample(df: DataFrame, id_col: str, domain: str, seed: str, n: int) -> DataFrame:
    """The first ``n`` rows by (rank_hash, id); a top-n, no full sort."""
    return hash_rank(df, id_col, domain, seed).orderBy("rank_hash", id_col).limit(n)
