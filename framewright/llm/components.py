"""Connected components of a large graph, in rounds of small joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.batches import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node of its component.

    ``edges`` has columns ``a`` and ``b``, comparable and of one type. Nodes without
    an edge to another don't appear. Large-star and small-star steps alternate until
    nothing changes; each round is written to the shared folder, which cuts lineage.
    A node's smallest neighbour is an aggregate, so a hub leaves each task as one row.
    """
    links = stored(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        now = links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        if now == before:
            break
        before = now
        links = stored(_small_star(_large_star(links)), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select("v", "v").distinct()
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the smallest node around it."""
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), "m")


def _small_star(links: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    links = links.select("u", F.col("m").alias("v")).distinct()
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
