"""Connected components by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialise, redealt


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)") % 1_000_003).alias("s")).first()
    return tuple(row)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """From links (u, v) of any order: node, component (its least node), for every node with a link.

    Each round joins the edges with the minimum of each node.  That table is dealt
    out anew for the join, so that AQE can split the edges of a node with very many
    links over several tasks; minima and distinct edges are combined before they are
    shuffled.
    """
    edges = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _print(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(redealt("u"), F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "edges")
        discard(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(redealt("u"), "m")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = materialise(small, "edges")
        discard(large)
        now = _print(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components have not settled")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
