"""Connected components as DataFrame jobs.

Alternates the large-star and small-star steps until the edges form stars.
Each round is written to the shared folder, so that a lost executor costs one
round; labels and edges never reach the driver, only a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import salted_join, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (the larger ones, or itself and the smaller ones) tied to its least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    far = salted_join(both, least, ["u"], F.col("v"))
    if large:
        far = far.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        far = far.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return far.where("a <> b").distinct()


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges as a stored table, with their count and a checksum taken while they are written."""
    seen = Observation()
    edges = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")), "edges")
    return edges, (seen.get["n"], seen.get["s"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b) of any ordered type -> (node, label): every node of an edge and the least node it can reach.

    Null ends, self loops and repeated edges have no effect; no edges give no
    rows.
    """
    edges, before = _counted(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        if not before[0]:
            break
        edges, now = _counted(_stars(_stars(edges, True), False))
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    label = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return label.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
