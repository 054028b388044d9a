"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a join and a pre-aggregated minimum; each round's edges are written to the
shared folder, so neither lineage nor the driver grows with the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.shared import remove, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Large: all greater neighbours of a node get its least neighbour; small: all lesser ones do."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes of links (a, b); component is the least node that links reach.

    Links may repeat and stand in either direction; a link of a node to itself, or with a
    null end, adds nothing. No links: an empty table.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where((F.col("a") != F.col("b"))).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        found = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if not found["n"] or (found["n"], found["s"]) == before:
            break
        before = (found["n"], found["s"])
        following = stored(_star(_star(edges, True), False), "edges")
        remove(edges)
        edges = following
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
