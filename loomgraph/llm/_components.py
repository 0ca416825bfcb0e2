"""Connected components of a link table, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._store import staged


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 64) -> DataFrame:
    """node, root for every node in a link; root is the smallest node that links reach.

    Each round first points every node's larger neighbours at its smallest neighbour, then every
    node and its smaller neighbours at the smallest of these (alternating large and small stars);
    the rounds needed grow with the logarithm of the longest chain. Minima are taken with
    map-side aggregation and joined back, so a node with very many links is split like any
    other skewed join key. Every round is written to the shared folder.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = staged(edges, "links")
    before = None
    for _ in range(most_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = staged(small, "links")
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.sum(F.hash("u", "v").cast("long")).alias("s")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
