"""Connected components of a link table by alternating large-star and small-star rounds, all as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (u > v). Large: neighbours above a node move to its least neighbour; small: those below.
    Least neighbours are written, so that the join has two plain inputs and a hub's links are split among tasks."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = stage(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "least")
    moved = both.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label (the least node of its component) for every node with a link to another; comparable node type.

    Null ends and self links are ignored; repeated links count once; no links give no rows. Each round is written to
    the shared folder; rounds end when one changes nothing, after a number that is logarithmic in the longest chain.
    """
    edges = links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = stage(edges, "links")
    before = None
    while True:
        edges = stage(star(star(edges, True), False), "star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
