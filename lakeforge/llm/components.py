"""Connected components of a link table, by repeated star contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def smallest_reachable(links: DataFrame, folder: str, name: str) -> DataFrame:
    """``node, component`` for every node of ``links (a, b)``: the smallest node reachable, itself included.

    Each round hangs every node's larger neighbours on its smallest neighbour, then every node on the smallest of its
    smaller neighbours, until nothing changes; a chain of n links takes rounds in proportion to log n. Every round is a
    written table, so a lost executor costs no earlier round. A hub of any degree is a minimum, found with partial
    aggregation, and a join whose small side has one row per node.
    """
    edges = staged(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), folder, f"{name}_0"
    )
    last = None
    for n in range(1, 60):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.filter("a > m").select("a", F.col("m").alias("b"))).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(small.unionByName(small_least.select("a", F.col("m").alias("b"))).distinct(), folder, f"{name}_{n}")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if state == last and state[0] == state[2]:
            break
        last = state
    else:
        raise RuntimeError("components did not settle; the links of the last round are incomplete")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
