"""Walks with a budget of nodes for each start: they stop when it is spent, whatever lies beyond.

Every round joins the frontiers with the edges themselves, keeps what still fits into each start's
budget, and writes that; a walk whose budget is spent has no frontier any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.store import staged


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    down = edges.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("next_id"))
    up = edges.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("next_id"))
    return {"down": down, "up": up, "both": down.unionByName(up)}[direction]


def budgeted_walks(edges: DataFrame, starts: DataFrame, budget: int, max_depth: int, direction: str = "both") -> DataFrame:
    """start_id, node_id, hop, place: the first ``budget`` nodes of a queue walk from each start, itself at place 1.

    edges: source_id, target_id; starts: start_id, node_id. The queue takes a node's neighbours in the order of their ids, those of
    nodes that were found earlier first. No round looks further than what is still to be found.
    """
    steps = _steps(edges, direction)
    frontier = staged(starts.select("start_id", "node_id", F.lit(0).alias("hop"), F.lit(1).cast("long").alias("place")).distinct(), "walk")
    rounds, seen = [frontier], frontier
    by_place = W.partitionBy("start_id").orderBy("from_place", "node_id")
    for hop in range(1, max_depth + 1):
        used = seen.groupBy("start_id").agg(F.count("*").alias("used"))
        open_ = frontier.join(used.filter(F.col("used") < budget), "start_id")
        found = open_.join(steps, "node_id").filter("next_id IS NOT NULL").groupBy("start_id", F.col("next_id").alias("node_id")).agg(F.min("place").alias("from_place"), F.max("used").alias("used"))
        fresh = found.join(seen.select("start_id", "node_id"), ["start_id", "node_id"], "left_anti")
        # The limit by a constant lets Spark drop rows before it shuffles them; the start's own follows.
        ranked = fresh.withColumn("rank", F.row_number().over(by_place)).filter(F.col("rank") < budget).filter(F.col("rank") + F.col("used") <= budget)
        frontier = staged(ranked.select("start_id", "node_id", F.lit(hop).alias("hop"), (F.col("rank") + F.col("used")).cast("long").alias("place")), "walk")
        if frontier.isEmpty():
            break
        rounds.append(frontier)
        seen = seen.unionByName(frontier)
    return seen


def call_chains(nodes: DataFrame, calls: DataFrame, implementations: DataFrame, skipped: DataFrame, starts: DataFrame, direction: str = "down", max_depth: int = 6, most_methods: int = 30) -> DataFrame:
    """start_id, node_id, depth, class_name, name: the methods on the chains from (or to) each start, at most ``most_methods`` of a start, nearest first, then by class, name and id.

    nodes: id, entity_type, class_name, name; only methods are walked. starts: start_id; one that is no
    known method has no chain. implementations: interface_id, id. A method with a single implementation gives way to
    it, the start too, unless that was seen before; one with several stays, and they follow at its own
    depth. skipped(id) methods are never stepped to. A start whose chain is full walks no further.
    """
    methods = nodes.filter(F.lower("entity_type") == "method").select("id", F.coalesce("class_name", F.lit("")).alias("class_name"), F.coalesce("name", F.lit("")).alias("name"))
    impl = implementations.select("interface_id", "id").distinct().join(methods.select("id").hint("merge"), "id", "left_semi")
    faces = impl.groupBy(F.col("interface_id").alias("node_id")).agg(F.count("*").alias("n"), F.min("id").alias("only"))
    faces, several = staged(faces, "faces"), impl.select(F.col("interface_id").alias("node_id"), F.col("id").alias("next_id"))
    # What grows with the methods is merged, never broadcast: small as it is when compressed, it would pass the driver at every depth.
    steps = staged(_steps(calls, direction).join(skipped.select(F.col("id").alias("next_id")).hint("merge"), "next_id", "left_anti"), "steps")
    known = lambda df: df.join(methods.select(F.col("id").alias("node_id")).hint("merge"), "node_id", "left_semi")
    reached = known(starts.select("start_id", F.col("start_id").alias("node_id")).distinct())
    seen: DataFrame | None = None
    for depth in range(max_depth + 1):
        fresh = reached.join(seen.hint("merge"), ["start_id", "node_id"], "left_anti") if seen is not None else reached
        turned = fresh.join(faces.hint("merge"), "node_id", "left")
        if seen is not None:
            gone = seen.select("start_id", F.col("node_id").alias("only"), F.lit(True).alias("gone"))
            turned = turned.join(gone.hint("merge"), ["start_id", "only"], "left")
        else:
            turned = turned.withColumn("gone", F.lit(None).cast("boolean"))
        jumps = (F.col("n") == 1) & F.col("gone").isNull()
        shown = turned.select("start_id", F.when(jumps, F.col("only")).otherwise(F.col("node_id")).alias("node_id"))
        branches = turned.filter("n > 1").select("start_id", "node_id").join(several.hint("merge"), "node_id").select("start_id", F.col("next_id").alias("node_id"))
        if seen is not None:
            branches = branches.join(seen.hint("merge"), ["start_id", "node_id"], "left_anti")
        level = staged(shown.unionByName(branches).distinct().select("start_id", "node_id", F.lit(depth).alias("depth")), "chain")
        if level.isEmpty():
            break
        passed = turned.filter(jumps).select("start_id", "node_id")  # interfaces that gave way count as seen
        before = seen
        seen = level.select("start_id", "node_id") if before is None else before.unionByName(level.select("start_id", "node_id"))
        every = level if depth == 0 else every.unionByName(level)
        full = every.groupBy("start_id").count().filter(F.col("count") >= most_methods).select("start_id")
        hidden = staged(passed, "passed")
        seen = seen.unionByName(hidden)
        reached = known(level.join(full.hint("merge"), "start_id", "left_anti").join(steps.hint("merge"), "node_id").select("start_id", F.col("next_id").alias("node_id")).distinct())
    if seen is None:
        return starts.select("start_id", F.col("start_id").alias("node_id"), F.lit(0).alias("depth"), F.lit("").alias("class_name"), F.lit("").alias("name")).limit(0)
    named = every.join(methods.hint("merge"), every.node_id == methods.id).select("start_id", "node_id", "depth", "class_name", "name")
    rank = F.row_number().over(W.partitionBy("start_id").orderBy("depth", "class_name", "name", "node_id"))
    return named.withColumn("rank", rank).filter(F.col("rank") <= most_methods).drop("rank")
