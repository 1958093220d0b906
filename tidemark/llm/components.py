"""Connected components of an edge table, as alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, stored


def _large_star(e: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to its smallest neighbour. A node has
    smaller ones only where it is the larger end of an edge."""
    low = e.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    return e.join(low, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them (v < u)."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    link = [F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in ("u", "v")]
    return e.join(low, "u").select(F.inline(F.array(*link))).where("u != v").distinct()


def _are_stars(e: DataFrame) -> bool:
    """Does every edge lead from a node of no other edge to the smallest of its component?"""
    end = [F.struct(F.col(c).alias("node"), F.lit(c == "u").cast("long").alias("up"), F.lit(c == "v").alias("low")) for c in ("u", "v")]
    nodes = e.select(F.inline(F.array(*end))).groupBy("node").agg(F.sum("up").alias("up"), F.max("low").alias("low"))
    return nodes.where("up > 1 OR up > 0 AND low").count() == 0


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component, for every node that
    has an edge to another. Self-edges and edges with a null do not count.

    Minima are taken by aggregation, so a node with very many neighbours is
    never gathered in one task, and rounds grow with the logarithm of the
    longest path. Only a count of each round reaches the driver.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = stored(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
                 .select(u, v).distinct(), "edges")
    for _ in range(max_rounds):
        before, now = now, stored(_small_star(_large_star(now)), "stars")
        discard(before)
        if _are_stars(now):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
