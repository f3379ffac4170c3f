"""Connected components by alternating large-star and small-star steps.

Both steps are grouped minima and joins on a node, so a node with very many
neighbours is pre-aggregated before the shuffle and its join may be split by
Spark.  Each round is checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from culprit.llm.common import checkpoint


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    rest = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    turned = rest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return turned.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge; the component is its least node.

    Self-loops and edges with a null end are ignored, repeated edges count once.
    The rounds end when a round changes nothing, however many that takes.
    """
    e = edges.where(f"`{a}` <> `{b}`").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    e = checkpoint(e)
    mark = lambda d: tuple(d.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    last = mark(e)
    while last[0]:
        e = checkpoint(_small_star(_large_star(e)))
        now = mark(e)
        if now == last:
            break
        last = now
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(e.select(F.col("b"), F.col("b")).distinct())
