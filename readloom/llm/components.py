"""Connected components of an edge table, as alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import cut


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Reattach each node's neighbours to the smallest of them and itself.

    ``larger``: only neighbours above the node move (large star), else those below and the node
    itself (small star).  Minima are partially aggregated before the shuffle; the join that
    carries them back is one that adaptive execution may split on a hub.
    """
    both = edges.union(edges.select("b", "a")) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if larger:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, limit: int = 64) -> DataFrame:
    """(a, root) for each node that has an edge; root is the component's smallest node.

    edges: columns a and b of one orderable type; loops and repeats are allowed, nulls are not
    linked.  Rounds go on until an edge table no longer changes, each cut by a table in the
    shared folder.  Only two sums of an edge table come to the driver.
    """
    now = cut(edges.select("a", "b").dropna().filter("a <> b").distinct())
    before = None
    for _ in range(limit):
        totals = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if totals[0] == 0 or totals == before:
            break
        before = totals
        now = cut(_stars(_stars(now, larger=True), larger=False))
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    roots = now.select("a", F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("a"), F.col("b").alias("root")).distinct())
