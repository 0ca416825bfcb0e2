"""Neighbourhood, search and listing operators on nodes(id, entity_type, name, ...) and edges(source_id, target_id, rel_type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_phantoms(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, and ids that only edges name, with nulls elsewhere."""
    named = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).distinct()
    return nodes.unionByName(named.join(nodes, "id", "left_anti"), allowMissingColumns=True)


def search_by_name(nodes: DataFrame, text: str, types: list[str] | None = None, mode: str = "name", limit: int = 100) -> DataFrame:
    """Nodes whose name holds the text in any case.

    mode "name": name only, all hits, the empty text hits everything. mode "name_or_id": name or
    id, ordered by name and id, at most ``limit``, none for the empty text.
    """
    found = nodes.filter(F.col("entity_type").isin(types)) if types else nodes
    hit = F.lower(F.coalesce("name", F.lit(""))).contains(text.lower())
    if mode == "name":
        return found.filter(hit)
    if not text:
        return found.filter(F.lit(False))
    return found.filter(hit | F.lower("id").contains(text.lower())).orderBy(F.coalesce("name", "id"), "id").limit(limit)


def letter_bucket(name, other: str = "other"):
    """a to z by the first letter, else ``other``."""
    first = F.lower(F.substring(name, 1, 1))
    return F.when(first.between("a", "z"), first).otherwise(other)


def neighbours(edges: DataFrame, rel_types: list[str] | None = None, excluded: list[str] | None = None, distinct: bool = False) -> DataFrame:
    """source_id, target_id, rel_type of the wanted relations in any case; one row for each edge unless distinct."""
    rel = F.lower("rel_type")
    out = edges.filter(rel.isin([r.lower() for r in rel_types])) if rel_types else edges
    out = out.filter(~rel.isin([r.lower() for r in excluded])) if excluded else out
    return out.distinct() if distinct else out


def direct_peers(nodes: DataFrame, edges: DataFrame, name: str, down: bool = True) -> DataFrame:
    """Distinct (class_name, name) called by, or calling, any node of that name."""
    near, far = ("source_id", "target_id") if down else ("target_id", "source_id")
    own = nodes.filter(F.col("name") == name).select(F.col("id").alias(near))
    hops = neighbours(edges, ["calls"]).join(own, near, "left_semi").select(F.col(far).alias("id")).distinct()
    return nodes.join(hops, "id").select("class_name", "name").distinct()


def relations_of(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """direction, rel_type, peer_id, peer_name, peer_type of both directions."""
    out = edges.filter(F.col("source_id") == node_id).select(F.lit("out").alias("direction"), "rel_type", F.col("target_id").alias("peer_id"))
    both = out.unionByName(edges.filter(F.col("target_id") == node_id).select(F.lit("in").alias("direction"), "rel_type", F.col("source_id").alias("peer_id")))
    peers = nodes.select(F.col("id").alias("peer_id"), F.col("name").alias("peer_name"), F.col("entity_type").alias("peer_type"))
    return both.join(peers, "peer_id", "left").select("direction", "rel_type", "peer_id", "peer_name", "peer_type")


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids(id)."""
    return edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id", "rel_type")


def enriched_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with their ends' names and types, ``unknown`` for ids without a node."""
    end = lambda side: nodes.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), F.col("entity_type").alias(f"{side}_type"))
    out = edges.join(end("source"), "source_id", "left").join(end("target"), "target_id", "left")
    return out.select("source_id", "target_id", "rel_type", *(F.coalesce(c, F.lit("unknown")).alias(c) for c in ("source_name", "source_type", "target_name", "target_type")))


def samples_by_size(rows: DataFrame, group: str, size: str, key: str) -> DataFrame:
    """group, key, size of the smallest, the middle and the largest row of each group, by size, then key; each once.

    Sizes are counted first, and their places found among the counts; only rows of the wanted sizes are put in order.
    """
    counts = rows.groupBy(group, size).agg(F.count("*").alias("_n"))
    upto = W.partitionBy(group).orderBy(size)
    placed = counts.withColumns({"_last": F.sum("_n").over(upto.rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("_n").over(W.partitionBy(group))})
    asked = placed.withColumn("_place", F.explode(F.array_distinct(F.array(F.lit(1).cast("long"), F.expr("_all DIV 2 + 1"), F.col("_all")))))
    wanted = asked.filter("_place <= _last AND _place > _last - _n").groupBy(group, size).agg(F.collect_set(F.col("_place") - F.col("_last") + F.col("_n")).alias("_ranks"))
    same = (F.col(f"r.{group}").eqNullSafe(F.col(f"w.{group}"))) & (F.col(f"r.{size}").eqNullSafe(F.col(f"w.{size}")))
    found = rows.select(group, key, size).alias("r").join(wanted.alias("w"), same).select(f"r.{group}", f"r.{key}", f"r.{size}", "_ranks")
    rank = F.row_number().over(W.partitionBy(group, size).orderBy(key)).cast("long")
    return found.withColumn("_rank", rank).filter(F.array_contains("_ranks", F.col("_rank"))).select(group, key, size)


def graph_of(entities: DataFrame, relations: DataFrame, hidden: tuple[str, ...] = ("code_snippet",)) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of structure facts: attributes without a value and the hidden ones go; relations stay as they are, with ends that no entity has."""
    kept = F.map_filter("attributes", lambda k, v: v.isNotNull() & ~k.isin(*hidden))
    return entities.withColumn("attributes", F.coalesce(kept, F.create_map().cast("map<string, string>"))), relations


def peers(edges: DataFrame, asked: DataFrame, direction: str = "down", rel_types: list[str] | None = None) -> DataFrame:
    """id, peer, rel_type: the successors, or predecessors, of the asked ids (id), each once."""
    near, far = ("source_id", "target_id") if direction == "down" else ("target_id", "source_id")
    own = neighbours(edges, rel_types).select(F.col(near).alias("id"), F.col(far).alias("peer"), "rel_type").distinct()
    return own.join(asked.select("id").distinct(), "id", "left_semi")


def access_groups(details: DataFrame) -> DataFrame:
    """table, op, min_hop, max_hop, items (hop, statement, source, in that order) of table accesses: table, op, hop, statement, source; each once."""
    items = F.sort_array(F.collect_set(F.struct("hop", "statement", "source")))
    return details.groupBy("table", "op").agg(F.min("hop").alias("min_hop"), F.max("hop").alias("max_hop"), items.alias("items"))


def best_patterns(patterns: DataFrame, most: int, by: list[str] = ()) -> DataFrame:
    """The ``most`` patterns of the greatest confidence, of each group of ``by`` if there is any; ties by name."""
    order = [F.desc("confidence"), F.col("pattern_name")]
    if not by:
        return patterns.orderBy(*order).limit(most)
    return patterns.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= most).drop("_rank")
