"""Policies of what a walk may step over and to, and neighbours under them from one or several graphs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WalkPolicy:
    """calls_only: calls and nothing else, whatever they lead to. Otherwise any relation but the excluded ones, to ids without the excluded prefixes."""

    calls_only: bool = False
    excluded_relations: tuple[str, ...] = ()
    excluded_prefixes: tuple[str, ...] = ()


# The policies of walks from methods to tables and back.
CALLS_ONLY = WalkPolicy(calls_only=True)
METHOD_TO_TABLE = TABLE_TO_METHOD = WalkPolicy(excluded_relations=("implements",), excluded_prefixes=("term://", "domain://", "capability://"))


def allowed_edges(edges: DataFrame, policy: WalkPolicy, direction: str = "down") -> DataFrame:
    """source_id, target_id of the edges that a walk may take; backwards, prefixes are those of the source."""
    relation = F.lower("rel_type")
    if policy.calls_only:
        return edges.filter(relation == "calls").select("source_id", "target_id")
    out = edges.filter(~F.coalesce(relation, F.lit("")).isin([r.lower() for r in policy.excluded_relations])) if policy.excluded_relations else edges
    far = F.col("target_id" if direction == "down" else "source_id")
    for prefix in policy.excluded_prefixes:
        out = out.filter(~far.startswith(prefix))
    return out.select("source_id", "target_id")


def policy_neighbours(graphs: list[DataFrame], asked: DataFrame, policy: WalkPolicy, direction: str = "down", tasks: int | None = None) -> DataFrame:
    """id, place, peer: for every asked id its neighbours, each once: those of the first graph, then what the next ones add, each in the order of ids.

    graphs: source_id, target_id, rel_type; asked: id. Null and empty peers are none. tasks: over how many all is dealt by id, else AQE chooses.

    An asked id is a row before its neighbours: a semi join would be pushed below the graphs' unions, and ``asked`` be made anew for each of their parts.
    """
    near, far = ("source_id", "target_id") if direction == "down" else ("target_id", "source_id")
    every = None
    for i, edges in enumerate(graphs):
        own = allowed_edges(edges, policy, direction).select(F.col(near).alias("id"), F.col(far).alias("peer"), F.lit(i).alias("graph"))
        every = own if every is None else every.unionByName(own)
    asked = asked.select("id", F.lit(None).cast("string").alias("peer"), F.lit(-1).alias("graph"))
    every = every.filter("peer <> ''").unionByName(asked).filter("id IS NOT NULL")
    first = (every.repartition(tasks, "id") if tasks else every.repartition("id")).groupBy("id", "peer").agg(F.min("graph").alias("graph"))
    own = W.partitionBy("id").orderBy("graph", "peer")
    placed = first.withColumn("place", F.row_number().over(own) - 1).withColumn("asked", F.first("graph").over(own) < 0)
    return placed.filter("asked AND place > 0").select("id", "place", "peer")
