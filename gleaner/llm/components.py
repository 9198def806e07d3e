"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import settle


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: two columns of node numbers. Returns ``node, component``: the smallest node reachable, for all nodes but the smallest.

    Each round points the larger neighbours of every node to its smallest one, then the node itself and its smaller neighbours (large star,
    small star). Links stay links of one component and never grow in number beyond twice; the rounds needed grow with the logarithm
    of the longest path. Each round is written to the shared folder. Minima are aggregated map-side, so a node with many links is no hot task
    there, and the join back is a plain shuffle join. Nulls and loops are dropped; an empty table gives no rows.
    """
    a, b = (F.col(c) for c in links.columns[:2])
    edges = settle(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v and u is not null and v is not null").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
