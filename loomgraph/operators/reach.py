"""How much every node reaches, without a row for each pair: sets of ids as blocks of bits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.traverse import levels
from loomgraph.store import staged

WORDS = 16


def reach_sizes(edges: DataFrame, nodes: DataFrame, words: int = WORDS) -> DataFrame:
    """id, reached: how many nodes each node reaches, itself included.

    edges: source_id, target_id; nodes: id. Nodes are numbered, and a component's set is held as the
    blocks of ``64 * words`` numbers of which it reaches any, a bit for each. Components are gone through by level: a
    level's sets are the callees' sets and the component's own nodes, merged by bits, and are handed
    to the callers' levels, where they are read once. What is held grows with the nodes times the
    blocks that they reach, an eighth of a byte for each pair at worst.
    """
    placed = staged(levels(edges, nodes).select("id", "component", "level"), "placed")
    numbered = staged(placed.repartitionByRange("level", "component").sortWithinPartitions("level", "component", "id").withColumn("number", F.monotonically_increasing_id()), "numbered")
    columns = [f"w{i}" for i in range(words)]
    size = 64 * words
    at = F.pmod("number", F.lit(size)).cast("int")
    bits = [F.when(F.floor(at / 64) == i, F.call_function("shiftleft", F.lit(1).cast("long"), at % 64)).otherwise(F.lit(0).cast("long")).alias(c) for i, c in enumerate(columns)]
    merged = lambda df: df.groupBy("component", "block").agg(*[F.bit_or(c).alias(c) for c in columns])
    own = merged(numbered.select("component", F.expr(f"number DIV {size}").alias("block"), *bits))
    level_of = placed.select("component", "level").distinct()
    own = staged(own.join(level_of.hint("merge"), "component"), "own", "level")
    ends = edges.join(placed.select(F.col("id").alias("source_id"), F.col("component").alias("caller"), F.col("level").alias("caller_level")).hint("merge"), "source_id").join(placed.select(F.col("id").alias("target_id"), "component", "level").hint("merge"), "target_id")
    arcs = staged(ends.filter("caller <> component").select("caller", "caller_level", "component", "level").distinct(), "arcs", "level")
    last = placed.agg(F.max("level")).first()[0]
    handed: list[DataFrame] = []

    def every(condition=None) -> DataFrame:
        parts = [x.filter(condition) if condition is not None else x for x in [own, *handed]]
        out = parts[0].select("component", "block", *columns)
        for more in parts[1:]:
            out = out.unionByName(more.select("component", "block", *columns))
        return merged(out)

    for level in range(last or 0):
        up = arcs.filter(F.col("level") == level).select("component", "caller", "caller_level")
        given = up.join(every(F.col("level") == level).hint("merge"), "component").select(F.col("caller").alias("component"), F.col("caller_level").alias("level"), "block", *columns)
        handed.append(staged(given.groupBy("component", "level", "block").agg(*[F.bit_or(c).alias(c) for c in columns]), "handed", "level"))
    held = sum((F.bit_count(c) for c in columns[1:]), F.bit_count(columns[0]))
    sizes = every().groupBy("component").agg(F.sum(held).alias("reached"))
    return placed.join(sizes.hint("merge"), "component").select("id", "reached")


def benefit_of_inference(edges: DataFrame, nodes: DataFrame, words: int = WORDS) -> DataFrame:
    """id, explicit, reached, gained: nodes reached by the edges that aren't inferred, by all, and the difference. edges: source_id, target_id, inferred."""
    ends = edges.select("source_id", "target_id")
    own = reach_sizes(edges.filter("NOT inferred").select("source_id", "target_id"), nodes, words).withColumnRenamed("reached", "explicit")
    return own.join(reach_sizes(ends, nodes, words).hint("merge"), "id").select("id", "explicit", "reached", (F.col("reached") - F.col("explicit")).alias("gained"))
