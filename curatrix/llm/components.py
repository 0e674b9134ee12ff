"""Connected components of an edge table, without driver-side links.

Alternating large-star and small-star contraction (Kiveris et al., SoCC 2014) on
edges that point from the larger node to the smaller one.  Each star is an
aggregate that combines map-side, written as a table, and an equi-join with it:
both sides of the join are plain tables, so adaptive execution broadcasts the
smaller one or splits the rows of a hub.  No round holds more rows than edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.session import drop_scratch, materialize


def _least(edges: DataFrame) -> DataFrame:
    """The smallest node that each node points at: ``u, m``."""
    return materialize(edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "least")


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Nodes point at the smallest node that their targets point at, or stay with targets that point at none."""
    return edges.join(least, edges["b"] == least["u"], "left").select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Targets of a node point at its smallest one, and so does the node."""
    rest = edges.join(least, edges["a"] == least["u"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is its smallest node.

    Loops and repeated edges are allowed, null ends are dropped, an empty table
    gives an empty result.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now[0] == 0 or now == seen:
            break
        seen = now
        for star in (_large_star, _small_star):
            least = _least(edges)
            nxt = materialize(star(edges, least), "edges")
            drop_scratch(edges)
            drop_scratch(least)
            edges = nxt
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
