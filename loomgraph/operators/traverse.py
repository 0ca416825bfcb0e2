"""Fixed-point operators: reachability, shortest hops, transitive closure, components, levels.

Each round is one join and one anti-join, written to the shared folder, so that lineage stays
short and a lost executor costs one round. All traversals are batched by start. Components and levels
merge: a written table's small files hide how large its rows are, and a broadcast of them passes the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.store import staged

FEW_HOPS = 3


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bfs(edges: DataFrame, starts: DataFrame, max_hops: int | None = None, direction: str = "down") -> DataFrame:
    """start_id, node_id, hop, parent_id: the least hops to each node reached, the start itself at 0.

    edges: source_id, target_id. starts: start_id, node_id. direction: down, up or both.
    The parent is the smallest id among those one hop nearer. Along both directions, what a
    frontier touches is at most one hop nearer than itself, so that the last two frontiers tell
    what was seen; along one direction all of them do. A walk of few hops joins the edges as they
    are; only longer ones write them once, without repeats.
    """
    down = edges.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("next_id"))
    up = edges.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("next_id"))
    steps = {"down": down, "up": up, "both": down.unionByName(up)}[direction]
    if max_hops is None or max_hops > FEW_HOPS:
        steps = staged(steps.distinct(), "steps")
    frontier = staged(starts.select("start_id", "node_id", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("parent_id")).distinct(), "frontier")
    seen, near = [frontier], 2 if direction == "both" else 0  # 0: all
    while max_hops is None or len(seen) <= max_hops:
        found = frontier.join(steps, "node_id").groupBy("start_id", F.col("next_id").alias("id")).agg(F.min("node_id").alias("parent_id"))
        found = found.withColumnRenamed("id", "node_id").join(_union(seen[-near:]).select("start_id", "node_id"), ["start_id", "node_id"], "left_anti")
        frontier = staged(found.select("start_id", "node_id", F.lit(len(seen)).alias("hop"), "parent_id"), "frontier")
        if frontier.isEmpty():
            break
        seen.append(frontier)
    return _union(seen)


def impact_closure(edges: DataFrame, start_id: str, direction: str = "down", max_hops: int | None = None) -> DataFrame:
    """id, hop of everything reachable; ``both`` is the union of down and up, not their mixture."""
    spark = edges.sparkSession
    start = spark.createDataFrame([(start_id, start_id)], "start_id string, node_id string")
    sides = ["down", "up"] if direction == "both" else [direction]
    return _union([bfs(edges, start, max_hops, side) for side in sides]).groupBy(F.col("node_id").alias("id")).agg(F.min("hop").alias("hop"))


def transitive_pairs(edges: DataFrame) -> DataFrame:
    """source_id, target_id of pairs reachable in two hops or more that aren't edges and aren't loops.

    Lengths double in each round: the pairs at a distance of exactly 2^k are joined with all nearer ones and with
    themselves, so that where one way leads from node to node each pair is made once. The result can have the
    square of the nodes' number; bound the relation before calling it on a large one.
    """
    at = staged(edges.select("source_id", "target_id").filter("source_id <> target_id").distinct(), "pairs")  # at a distance of 2^k
    known, nearer = [at], []
    while True:
        ways = _union([p.select(F.col("source_id").alias("via"), "target_id", F.lit(i).alias("exact")) for i, parts in enumerate((nearer, [at])) for p in parts])
        longer = at.select("source_id", F.col("target_id").alias("via")).hint("merge").join(ways, "via").filter("source_id <> target_id")
        held = _union([p.select("source_id", "target_id", F.lit(-1).alias("exact")) for p in known])
        least = longer.select("source_id", "target_id", "exact").union(held).groupBy("source_id", "target_id").agg(F.min("exact").alias("exact"))
        new = staged(least.filter("exact >= 0"), "pairs", "exact")
        nearer = list(known)
        between, at = (new.filter(F.col("exact") == i).select("source_id", "target_id") for i in (0, 1))
        known += [between, at]
        nearer.append(between)
        if at.isEmpty():
            break
    return _union(known[1:])


def unary_roots(arcs: DataFrame) -> DataFrame:
    """v, root, dist of every node with a single arc: the first node on its way that has none or several, and how far it is.

    arcs: s, t, each once. Pointers double in each round, so that a chain takes the logarithm of its length. Nodes
    whose way runs into a cycle of such nodes have no row.
    """
    single = arcs.groupBy("s").agg(F.count("*").alias("n"), F.min("t").alias("root")).filter("n = 1").select(F.col("s").alias("v"), "root", F.lit(1).cast("long").alias("dist"))
    now, rounds = single, None
    while True:
        ahead = now.select(F.col("v").alias("root"), F.col("root").alias("next"), F.col("dist").alias("more"))
        now = now.join(ahead.hint("merge"), "root", "left")  # next is null once the root has no single arc
        now = staged(now.select("v", "root", "dist", "next", "more"), "pointers")
        held = now.agg(F.count("*").alias("n"), F.count("next").alias("open")).first()
        rounds = held["n"].bit_length() if rounds is None else rounds - 1
        if not held["open"] or rounds < 0:
            return now.filter("next IS NULL").select("v", "root", "dist")
        now = now.select("v", F.coalesce("next", "root").alias("root"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"))


def _without_ends(arcs: DataFrame) -> DataFrame:
    """The arcs on cycles or on ways between cycles: ids that nothing calls, or that call nothing, leave with the chains that lead to them until none is left."""
    n = arcs.count()
    while n:
        for v, w in (("s", "t"), ("t", "s")):
            ends = arcs.select(F.col(w).alias("id")).distinct().join(arcs.select(F.col(v).alias("id")).hint("merge"), "id", "left_anti")
            chains = unary_roots(arcs.select(F.col(v).alias("s"), F.col(w).alias("t"))).select("v", F.col("root").alias("id")).join(ends.hint("merge"), "id", "left_semi")
            gone = ends.union(chains.select("v"))
            arcs = staged(arcs.join(gone.select(F.col("id").alias(w)).hint("merge"), w, "left_anti").select("s", "t"), "arcs")
        now = arcs.count()
        if now == n:
            break
        n = now
    return arcs


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, component of every node: the largest id of its strongly connected component.

    Ids that lie on no cycle and between none are trimmed first, whole chains of both ends in a round.
    Then rounds of forward colouring: every node takes the largest id that reaches it; nodes of a
    colour that reach back to the colour's own node form a component and leave the graph.
    """
    every = staged(nodes.select("id").distinct(), "nodes")
    arcs = edges.select(F.col("source_id").alias("s"), F.col("target_id").alias("t")).filter("s <> t").distinct()
    for end in ("s", "t"):
        arcs = arcs.join(every.select(F.col("id").alias(end)).hint("merge"), end, "left_semi")
    arcs = staged(arcs.select("s", "t"), "arcs")
    done: list[DataFrame] = []
    while True:
        arcs = _without_ends(arcs)
        if arcs.isEmpty():
            break
        left = arcs.select(F.col("s").alias("id")).union(arcs.select("t")).distinct()
        colour = staged(left.select("id", F.col("id").alias("c")), "colour")
        while True:
            pushed = arcs.join(colour.hint("merge"), arcs.s == colour.id).groupBy(F.col("t").alias("id")).agg(F.max("c").alias("p"))
            new = staged(colour.join(pushed.hint("merge"), "id", "left").select("id", "c", F.greatest("c", F.coalesce("p", "c")).alias("n")), "colour")
            moved = not new.filter("n <> c").isEmpty()
            colour = new.select("id", F.col("n").alias("c"))
            if not moved:
                break
        own = arcs.join(colour.select(F.col("id").alias("s"), F.col("c").alias("cs")).hint("merge"), "s").join(colour.select(F.col("id").alias("t"), F.col("c").alias("ct")).hint("merge"), "t").filter("cs = ct").select("s", "t")
        roots = colour.filter("id = c").select(F.col("id").alias("start_id"), F.col("id").alias("node_id"))
        back = bfs(own.select(F.col("s").alias("source_id"), F.col("t").alias("target_id")), roots, direction="up")
        found = staged(back.select(F.col("node_id").alias("id"), F.col("start_id").alias("component")), "components")
        done.append(found)
        for end in ("s", "t"):
            arcs = arcs.join(found.select(F.col("id").alias(end)).hint("merge"), end, "left_anti")
        arcs = staged(arcs.select("s", "t"), "arcs")
    if not done:
        return every.select("id", F.col("id").alias("component"))
    return every.join(_union(done).hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, component, level: components condensed, level = longest path down to one without callees.

    Components with a single callee stand at their distance above the first one with none or
    several, found by pointer doubling. Only the latter are placed round by round, each once, when
    all its callees are.
    """
    parts = staged(strong_components(edges, nodes), "parts")
    arcs = edges.join(parts.select(F.col("id").alias("source_id"), F.col("component").alias("s")).hint("merge"), "source_id").join(parts.select(F.col("id").alias("target_id"), F.col("component").alias("t")).hint("merge"), "target_id")
    arcs = staged(arcs.filter("s <> t").select("s", "t").distinct(), "arcs")
    chained = staged(unary_roots(arcs), "chained")
    out = arcs.groupBy("s").agg(F.count("*").alias("n"))
    several = out.filter("n > 1").select("s")
    jumps = arcs.join(several.hint("merge"), "s", "left_semi").join(chained.select(F.col("v").alias("t"), "root", "dist").hint("merge"), "t", "left")
    jumps = staged(jumps.select("s", F.coalesce("root", "t").alias("t"), (F.coalesce("dist", F.lit(0)) + 1).alias("far")).groupBy("s", "t").agg(F.max("far").alias("far")), "jumps")
    need = staged(jumps.groupBy("s").agg(F.count("*").alias("need")), "need")
    every = parts.select(F.col("component").alias("c")).distinct()
    frontier = staged(every.join(out.select(F.col("s").alias("c")).hint("merge"), "c", "left_anti").select("c", F.lit(0).cast("long").alias("level")), "level")
    rounds, waiting = [frontier], None
    while True:
        reached = jumps.join(frontier.hint("merge"), jumps.t == frontier.c).groupBy("s").agg(F.count("*").alias("got"), F.max(F.col("level") + F.col("far")).alias("level"))
        both = reached if waiting is None else reached.unionByName(waiting)
        met = staged(both.groupBy("s").agg(F.sum("got").alias("got"), F.max("level").alias("level")).join(need.hint("merge"), "s"), "met")
        frontier, waiting = met.filter("got = need").select(F.col("s").alias("c"), "level"), met.filter("got < need").select("s", "got", "level")
        if frontier.isEmpty():
            break
        rounds.append(frontier)
    placed = _union(rounds)
    above = chained.join(placed.select(F.col("c").alias("root"), "level").hint("merge"), "root").select(F.col("v").alias("c"), (F.col("level") + F.col("dist")).alias("level"))
    best = placed.unionByName(above)
    return parts.join(best.hint("merge"), parts.component == best.c).select("id", "component", F.col("level").cast("int").alias("level"))
