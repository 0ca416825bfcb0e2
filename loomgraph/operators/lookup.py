"""Lookups over one or two stores: by either spelling, by free text, by hits, with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ids import method_id
from loomgraph.functions.predicates import is_method_node
from loomgraph.operators.graph import neighbours, search_by_name
from loomgraph.operators.retrieval import search_text
from loomgraph.operators.traverse import bfs, impact_closure
from loomgraph.operators.walk import with_inferred


def names_with_fallback(asked: DataFrame, nodes: DataFrame, store: DataFrame) -> DataFrame:
    """id, name: the node's name, else the store's (id, name), else the id."""
    own = nodes.select("id", F.nullif(F.trim("name"), F.lit("")).alias("own"))
    other = store.select("id", F.nullif(F.trim("name"), F.lit("")).alias("other"))
    return asked.select("id").distinct().join(own, "id", "left").join(other, "id", "left").select("id", F.coalesce("own", "other", "id").alias("name"))


def texts_or(asked: DataFrame, texts: DataFrame, placeholder: str) -> DataFrame:
    """id, text: the stored text (id, text), the placeholder where it is missing or empty."""
    return asked.select("id").join(texts.select("id", "text"), "id", "left").select("id", F.coalesce(F.nullif("text", F.lit("")), F.lit(placeholder)).alias("text"))


def resolve_method(nodes: DataFrame, text: str, module: str | None = None) -> DataFrame:
    """id of the method that a free text means, or no row: an id as it is, unless it lies in another module; else the first hit by name or id."""
    asked = text.strip()
    if asked.startswith("method://"):
        given = nodes.sparkSession.createDataFrame([(asked,)], "id string")
        if not module:
            return given
        elsewhere = nodes.filter((F.col("id") == asked) & (F.col("module_id") != "") & ~F.col("module_id").contains(module))
        return given.join(elsewhere.select("id"), "id", "left_anti")
    hits = search_by_name(nodes, asked, ["method"], "name_or_id", 30)
    hits = hits.filter(F.col("module_id") == module.strip()) if module else hits
    return hits.orderBy(F.coalesce("name", "id"), "id").select("id").limit(1)


def among_hits(candidates: DataFrame, hits: DataFrame, most: int) -> DataFrame:
    """id: the candidates that are hits (id, score), best first; the first candidates if none is a hit."""
    wanted = candidates.select("id").distinct()
    scored = wanted.join(hits.groupBy("id").agg(F.max("score").alias("score")), "id", "left")
    any_hit = scored.agg(F.coalesce(F.bool_or(F.col("score").isNotNull()), F.lit(False)).alias("any_hit"))
    kept = scored.crossJoin(F.broadcast(any_hit)).filter("score IS NOT NULL OR NOT any_hit")  # one row
    return kept.orderBy(F.desc_nulls_last("score"), "id").select("id").limit(most)


def term_landing(nodes: DataFrame, edges: DataFrame, term_id: str, hits: DataFrame, most: int = 20, rel_type: str = "related_to") -> DataFrame:
    """id: the code entities that a term is related to, in the order of their hits."""
    linked = neighbours(edges, [rel_type]).filter(F.col("source_id") == term_id).select(F.col("target_id").alias("id"))
    code = nodes.filter(F.lower("entity_type").isin("method", "class", "interface")).join(linked, "id", "left_semi")
    return among_hits(code, hits, most)


def bounded_neighbours(edges: DataFrame, start: str, rel_types: list[str] | None = None, direction: str = "both", max_depth: int = 3, most: int = 80) -> DataFrame:
    """node_id, hop of what a start reaches over the wanted relations; the nearest ``most``, ties by id."""
    begin = edges.sparkSession.createDataFrame([(start, start)], "start_id string, node_id string")
    found = bfs(neighbours(edges, rel_types, distinct=True).select("source_id", "target_id").distinct(), begin, max_depth, direction)
    return found.select("node_id", "hop").orderBy("hop", "node_id").limit(most)


def implementations(wanted: DataFrame, methods: DataFrame) -> DataFrame:
    """interface, name, id: methods of that name in classes named after the interface; of several, the first with code if one has any.

    wanted: interface, name; methods: id, class_name, name, code.
    """
    fits = (F.col("class_name") == F.concat("interface", F.lit("Impl"))) | (F.col("class_name").endswith("Impl") & F.col("class_name").contains(F.col("interface")))
    found = wanted.join(methods, "name").filter(fits).select("interface", "name", "id", (F.coalesce(F.length("code"), F.lit(0)) > 0).alias("coded"))
    best = found.groupBy("interface", "name").agg(F.count("*").alias("n"), F.min(F.when(F.col("coded"), F.col("id"))).alias("first"))
    return found.join(best, ["interface", "name"]).filter((F.col("n") == 1) | F.col("first").isNull() | (F.col("id") == F.col("first"))).select("interface", "name", "id")


def call_index(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """source_id, target_id of distinct calls between known methods, no method calling itself."""
    ids = methods.select("id").distinct()
    end = lambda side: ids.select(F.col("id").alias(side))
    called = neighbours(edges, ["calls"]).filter("source_id <> target_id").select("source_id", "target_id").distinct()
    return called.join(end("source_id"), "source_id", "left_semi").join(end("target_id"), "target_id", "left_semi")


def lineage_diagnostics(edges: DataFrame, mapped: DataFrame, starts: DataFrame, max_hops: int) -> DataFrame:
    """start_id, reachable, direct, mapped_hits: what a walk from each start (start_id, node_id) sees, and how much of it is mapped(id)."""
    seen = bfs(edges, starts, max_hops).select("start_id", F.col("node_id").alias("id"), "hop")
    known = mapped.select("id", F.lit(1).alias("known")).distinct()
    return seen.join(known, "id", "left").groupBy("start_id").agg((F.count("*") - 1).alias("reachable"), F.count_if(F.col("hop") == 1).alias("direct"), F.count("known").alias("mapped_hits"))


def vocabulary(names: DataFrame, synonyms: DataFrame) -> DataFrame:
    """term: distinct trimmed names(term) of two characters or more, and synonyms(term) that may also be one letter or digit."""
    clean = lambda df: df.select(F.trim("term").alias("term"))
    long = F.length("term") >= 2
    return clean(names).filter(long).union(clean(synonyms).filter(long | F.col("term").rlike(r"^[\p{L}\p{N}]$"))).distinct()


def listed(rows: DataFrame, condition: Column, key: str, most: int) -> DataFrame:
    """The first ``most`` rows, by key, that meet a condition: what a listing by level or scope shows."""
    return rows.filter(condition).orderBy(key).limit(most)


def search(nodes: DataFrame, texts: DataFrame | None, text: str, types: list[str] | None = None, mode: str = "name", k: int = 20) -> DataFrame:
    """id, score of at most ``k`` hits: semantic over texts (id, text) if asked for and there are any, else by name (no score, by name and id)."""
    if mode == "semantic" and texts is not None and not texts.isEmpty():
        return search_text(texts, text, k)
    found = search_by_name(nodes, text, types).orderBy(F.coalesce("name", "id"), "id").limit(k)
    return found.select("id", F.lit(None).cast("double").alias("score"))


def impact_by_kind(edges: DataFrame, rel_type: str, start: str, max_hops: int | None = None) -> DataFrame:
    """id, kind of what a start reaches: ``explicit`` by the edges alone, ``inferred`` only with those that the relation's transitivity adds."""
    own = impact_closure(edges, start, max_hops=max_hops).select("id")
    every = impact_closure(with_inferred(edges, rel_type), start, max_hops=max_hops).select("id")
    return own.select("id", F.lit("explicit").alias("kind")).union(every.join(own, "id", "left_anti").select("id", F.lit("inferred").alias("kind")))


def impact_rows(closure: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """id, entity_type, label of a closure's first ``most`` nodes by (type, label); a node without a name is labelled by its id."""
    named = closure.select("id").distinct().join(nodes.select("id", "entity_type", "name"), "id", "left")
    out = named.select("id", F.coalesce("entity_type", F.lit("")).alias("entity_type"), F.coalesce(F.nullif(F.trim("name"), F.lit("")), "id").alias("label"))
    return out.orderBy("entity_type", "label", "id").limit(most)


def with_intents(hits: DataFrame, technical: DataFrame, business: DataFrame) -> DataFrame:
    """id, score, technical, business of hits (id, score): the stored texts (id, text) of methods, whose ids are spelled one way; null for other entities."""
    key = F.when(is_method_node(F.col("id"), F.lit(None).cast("string")), method_id(F.col("id")))
    keyed = hits.withColumn("key", key)
    stored = lambda df, name: df.select(method_id(F.col("id")).alias("key"), F.col("text").alias(name))
    return keyed.join(stored(technical, "technical"), "key", "left").join(stored(business, "business"), "key", "left").select("id", "score", "technical", "business")
