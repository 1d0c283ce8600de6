"""Connected components of links, by alternating large and small stars.

Defined results: an empty table of links gives an empty table; a link of a node
with itself, and links that are repeated or turned round, change nothing; links
with a null end are left out; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrain.llm.common import staged


def _stars(pairs: DataFrame, both: bool) -> DataFrame:
    """Link every neighbour of a node (both: the larger ones only) to the smallest of its neighbours and itself."""
    p = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else pairs
    least = p.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    near = p.join(least, p["u"] == least["w"])
    if both:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) the rows (node, component) of all nodes but the smallest of each component, which gives its name.

    Each round is staged, so a lost executor costs that round at most. Rounds
    end when the links are stars; their number grows with the logarithm of the
    longest path. An empty table of links gives an empty table.
    """
    pairs = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    seen = None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = now
        pairs = staged(_stars(_stars(pairs, True), False), "stars")
