"""Connected components by alternating large-star and small-star steps, without any collect.

Defined cases: null ends of an edge take part in none; repeated edges, loops and either direction
change nothing; an empty table gives an empty result; other columns are not returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, discard, materialise


def with_low(rows: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """``rows`` with the smallest neighbour ``m`` of their node ``a``, from the stored (a, m, n).

    Nodes with more than one of ``HOT_KEYS`` parts of ``total`` rows are fewer than twice that at any
    size: their table is broadcast, so a hub's rows are not shuffled. The others are joined.
    """
    hot = low.filter(F.col("n") * HOT_KEYS > total).select("a", F.col("m").alias("hub"))
    marked = rows.join(F.broadcast(hot), "a", "left")
    cold = marked.filter("hub is null").select("a", "b").join(low.select("a", "m"), "a")
    return cold.unionByName(marked.filter("hub is not null").select("a", "b", F.col("hub").alias("m")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of (a, b); the component is its smallest node.

    Every step pre-aggregates the minimum of a node's neighbours and joins it back. Each round is
    stored, which cuts lineage.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialise(e, "edges")
    state = None
    for _ in range(most_rounds):
        total = 2 * e.count()
        lowest = lambda rows: materialise(rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "lowest")
        # large star: neighbours above a node go to the smallest of its neighbourhood
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = lowest(both)
        moved = with_low(both, low, total).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = materialise(moved.distinct(), "edges")
        # small star: neighbours below a node, and itself, go to the smallest of them
        low_below = lowest(large)
        moved = with_low(large, low_below, total).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = materialise(moved.unionByName(low_below.select("a", F.col("m").alias("b"))).distinct(), "edges")
        for stored in (e, low, large, low_below):
            discard(stored)
        e = small
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    low = e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return low.unionByName(low.select(F.col("component").alias("node"), "component").distinct())
