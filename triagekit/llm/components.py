"""Connected components of a link table, as joins and aggregates (no driver-side graph).

Alternating large and small stars: every node's neighbours are hung below its
smallest neighbour until each component is one star.  Minima are aggregated before
they are joined back, so a node holding a third of all links is no single task's work
(the join is one that adaptive execution can split).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links -> (node, root) for every node that has a link to another one."""
    e = links.where("u <> v").select("u", "v")
    while True:
        e = shared_table(_small(_large(e)), "links")
        # Done when all are stars: every node hangs below one node, which hangs nowhere.
        r = e.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("nodes")).first()
        if r.n == r.nodes and not e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count():
            break
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
