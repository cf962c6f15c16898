"""Connected components of a large graph, as joins and aggregates on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strongroom.llm._common import checkpoint


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("h"),
    ).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours.

    The least neighbours are checkpointed, so that both sides of the join are plain shuffles and a hub's rows can be split.
    """
    least = checkpoint(edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"))
    return edges.join(least, edges["v"] == least["w"], "left").select("u", F.coalesce("m", "v").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are all linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Map each node of ``edges(a, b)`` to the least node it reaches: columns ``node``, ``root``.

    Alternating large-star and small-star rounds; the star graph they end in has one edge
    from each node to its root.  There are as many rounds as it takes, about the logarithm of the longest path.  Nodes without an edge (and self loops) do not appear; null ends
    are dropped.  Every round is checkpointed, so lineage stays short and nothing but
    a count and a hash reaches the driver.
    """
    u, v = F.greatest("a", "b"), F.least("a", "b")
    star = checkpoint(edges.where("a <> b").select(u.alias("u"), v.alias("v")).distinct())
    before = _fingerprint(star)
    while True:
        star = checkpoint(_small_star(_large_star(star)))
        after = _fingerprint(star)
        if after == before:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
