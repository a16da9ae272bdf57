"""Connected components by alternating large and small stars, all state in written tables.

Each round joins every node to the smallest node around it (Kiveris et al., "Connected Components
in MapReduce and Beyond"); rounds needed grow with the logarithm of a component's size. The minimum
of a neighbourhood comes from a partially aggregated groupBy and is joined back, so no neighbourhood
is ever collected. A hub's edges aren't brought together for that: hubs are few, as their number is
bounded by the edges, and their minima are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.operators.joins import split_join
from listwright.sources.shared import removed, written


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Edges (a, b) with m: the smallest neighbour of a."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("rows_")).withColumnRenamed("a", "n_")
    return split_join(edges, "a", written(low, "stars"), "n_", "rows_", total).select("a", "b", "m")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, 2 * total).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return _with_least(down, total).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of ``edges(a, b)`` with the smallest node it reaches."""
    kept = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        # Done when a round gives the same edges: each node hangs on one other, which hangs on none.
        now = kept.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not now["n"] or before == now:
            break
        before = now
        stars = written(_large_star(kept, now["n"]).filter("a <> b").distinct(), "edges")
        last, kept = kept, written(_small_star(stars, now["n"]).filter("a <> b").distinct(), "edges")
        removed(last)
        removed(stars)
    roots = kept.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return kept.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
