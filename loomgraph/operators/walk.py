"""Walks on top of the shortest-hop search: paths, start ids, call chains with interface jumps, inferred edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ids import method_id_variants
from loomgraph.operators.traverse import bfs, transitive_pairs
from loomgraph.store import staged


def with_paths(reached: DataFrame, most_steps: int = 500) -> DataFrame:
    """start_id, node_id, hop, path of the rows of ``bfs``: the ids from the start along the parents.

    A node further than ``most_steps`` has the path [start, node].
    """
    reached = staged(reached.select("start_id", "node_id", "hop", "parent_id"), "reached")
    last = reached.agg(F.max("hop")).first()[0] or 0
    level = reached.filter("hop = 0").select("start_id", "node_id", "hop", F.array("node_id").alias("path"))
    out = [level]
    for hop in range(1, min(last, most_steps) + 1):
        before = level.select("start_id", F.col("node_id").alias("parent_id"), "path")
        step = reached.filter(F.col("hop") == hop).join(before, ["start_id", "parent_id"])
        level = staged(step.select("start_id", "node_id", "hop", F.concat("path", F.array("node_id")).alias("path")), "paths")
        out.append(level)
    far = reached.filter(F.col("hop") > most_steps).select("start_id", "node_id", "hop", F.array("start_id", "node_id").alias("path"))
    for part in out[1:]:
        out[0] = out[0].unionByName(part)
    return out[0].unionByName(far)


def resolve_ids(asked: DataFrame, *backends: DataFrame) -> DataFrame:
    """asked, id: the spelling of each asked id that the first backend (a table with id) knows; what none knows stays as it is."""
    spelled = asked.select("asked", F.posexplode(method_id_variants(F.col("asked"))).alias("at", "id"))
    known = [spelled.join(b.select("id").distinct(), "id", "left_semi").select("asked", F.struct(F.lit(i).alias("backend"), "at", "id").alias("x")) for i, b in enumerate(backends)]
    every = known[0]
    for more in known[1:]:
        every = every.union(more)
    best = every.groupBy("asked").agg(F.min("x").alias("x"))
    return asked.select("asked").distinct().join(best, "asked", "left").select("asked", F.coalesce("x.id", "asked").alias("id"))


def with_inferred(edges: DataFrame, rel_type: str) -> DataFrame:
    """source_id, target_id, rel_type, inferred: the edges, and those that the relation's transitivity adds."""
    own = edges.select("source_id", "target_id", "rel_type", F.lit(False).alias("inferred"))
    added = transitive_pairs(edges.filter(F.lower("rel_type") == rel_type.lower()).select("source_id", "target_id"))
    return own.unionByName(added.select("source_id", "target_id", F.lit(rel_type).alias("rel_type"), F.lit(True).alias("inferred")))
