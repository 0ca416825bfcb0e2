"""What screens and reports show of the graph and its texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import summary_of
from loomgraph.operators.batch_search import search_many
from loomgraph.operators.containment import keyword_scores
from loomgraph.operators.context import counts_of_types, excerpts
from loomgraph.operators.graph import induced_edges, search_by_name

DEPENDENCIES = ("calls", "depends_on", "extends", "implements")


def domain_list(nodes: DataFrame) -> DataFrame:
    """node_id, id, name of the business domains, by name; one without a name is named by its id."""
    own = nodes.filter(F.lower("entity_type") == "businessdomain")
    return own.select(F.col("id").alias("node_id"), F.regexp_replace("id", "^domain://", "").alias("id"), F.coalesce(F.nullif("name", F.lit("")), F.col("id")).alias("name")).orderBy("name", "node_id")


def module_evidence(nodes: DataFrame, edges: DataFrame, module_id: str, keywords: list[str], most_edges: int = 10, most_paths: int = 12, most_hints: int = 10) -> DataFrame:
    """section, place, line of a module's report: counts of its classes, interfaces and methods; its dependencies to and from other modules, the most frequent first; the
    paths of its methods; its classes whose names hold most keywords, all of its classes at a score of one if only the module's own name holds one; and excerpts of their methods.

    nodes: id, entity_type, name, module_id, class_name, code, path. A module without entities has no row.
    """
    own = nodes.filter(F.col("module_id") == module_id)
    counts = counts_of_types(own.withColumn("entity_type", F.lower("entity_type")), ["class", "interface", "method"]).select(F.lit("counts").alias("section"), F.col("entity_type").alias("order"), F.concat("entity_type", F.lit("="), "n").alias("line"))
    placed = nodes.filter("module_id <> ''").select("id", "module_id")
    end = lambda side: placed.select(F.col("id").alias(f"{side}_id"), F.col("module_id").alias(side))
    across = edges.filter(F.lower("rel_type").isin(*DEPENDENCIES)).join(end("source"), "source_id").join(end("target"), "target_id").filter((F.col("source") != F.col("target")) & ((F.col("source") == module_id) | (F.col("target") == module_id)))
    rank = lambda n: F.lpad((F.lit(10**12) - F.col(n)).cast("string"), 13, "0")  # noqa: E731  the greatest first
    links = across.groupBy("source", "target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source", "target").limit(most_edges)
    links = links.select(F.lit("dependencies"), F.concat(rank("n"), "source", F.lit(" "), "target"), F.concat(F.lit("- "), "source", F.lit(" -> "), "target", F.lit(" ("), "n", F.lit(")")))
    paths = own.filter((F.lower("entity_type") == "method") & (F.trim(F.coalesce("path", F.lit(""))) != "")).groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(most_paths)
    paths = paths.select(F.lit("paths"), F.concat(rank("n"), "path"), F.concat(F.lit("- "), "path"))
    classes = own.filter(F.lower("entity_type").isin("class", "interface"))
    in_module = any(k.lower() in module_id.lower() for k in keywords)
    scored = classes.select("id", "name").join(keyword_scores(classes, keywords).select("id", "score"), "id", "left").withColumn("score", F.coalesce("score", F.lit(1 if in_module else 0))).filter("score > 0")
    hints = scored.orderBy(F.desc("score"), "id").limit(most_hints)
    shown = hints.select(F.lit("hints"), F.concat(rank("score"), "id"), F.concat(F.lit("- "), "id", F.lit(" | "), F.coalesce("name", F.lit(""))))
    methods = own.filter(F.lower("entity_type") == "method")
    cut = excerpts(methods, hints.select(F.col("name").alias("class_name")).distinct())
    cut = cut.select(F.lit("excerpts"), F.concat("class_name", F.lit(" "), "id"), F.concat(F.lit("- "), "class_name", F.lit(" "), "id", F.lit("\n"), "excerpt"))
    return counts.union(links).union(paths).union(shown).union(cut).select("section", "order", "line")


def analysis_tables(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(methods: id, name, class_name, module_id, signature, is_getter, is_setter, has_code, code_len; calls between them, one for each relation; fields: class_name, field, comment).

    nodes: as the facts have them, with a map of attributes.
    """
    text = lambda k: F.coalesce(F.col("attributes")[k], F.lit(""))
    flag = lambda k: F.lower(text(k)) == "true"
    kind = F.lower("entity_type")
    methods = nodes.filter(kind == "method").select("id", "name", text("class_name").alias("class_name"), F.coalesce("module_id", F.lit("")).alias("module_id"), text("signature").alias("signature"), flag("is_getter").alias("is_getter"), flag("is_setter").alias("is_setter"), (text("code_snippet") != "").alias("has_code"), F.length(text("code_snippet")).alias("code_len"))
    ids = methods.select("id")
    calls = edges.filter(F.lower("rel_type") == "calls").select("source_id", "target_id").join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    fields = nodes.filter(kind == "field").select(text("class_name").alias("class_name"), F.col("name").alias("field"), text("comment").alias("comment"))
    return methods, calls.select("source_id", "target_id"), fields


def search_with_subgraph(nodes: DataFrame, edges: DataFrame, text: str, chosen: str, shown: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits: the first ``shown`` nodes whose name or id holds a text; the nodes of the chosen one's module; the edges among them)."""
    hits = search_by_name(nodes, text, mode="name_or_id", limit=shown)
    module = nodes.filter((F.col("id") == chosen) & (F.coalesce("module_id", F.lit("")) != "")).select("module_id").distinct()
    members = nodes.join(F.broadcast(module), "module_id", "left_semi")  # one row
    return hits, members, induced_edges(edges, members.select("id"))


def with_encoded_evidence(patterns: DataFrame) -> DataFrame:
    """Patterns as rows of a store: their evidence (any column) and related ids as JSON texts, an empty list for none."""
    related = F.coalesce(F.to_json(F.col("related_entity_ids")), F.lit("[]"))
    return patterns.withColumns({"evidence_json": F.coalesce(F.to_json("evidence"), F.lit("")), "related_entity_ids_json": related}).drop("evidence", "related_entity_ids")


def code_of(asked: DataFrame, snippets: DataFrame) -> DataFrame:
    """id, code of the asked entities that have a snippet. snippets: id, code; blank ones are none, of several the first by text counts."""
    kept = snippets.filter(F.trim("code") != "").groupBy("id").agg(F.min("code").alias("code"))
    return asked.select("id").distinct().join(kept, "id")


def interpretation_hits(texts: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """item, id, score of the k nearest interpreted methods of each question. texts: id, vector; questions: item, vector."""
    return search_many(texts.filter(F.trim("id") != ""), questions, k)


def search_report(texts: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """item, place, line: for each question its k best hits as "[score] class.name → summary", the summary cut to forty characters.

    texts: id, vector, class_name, name, text.
    """
    from pyspark.sql import Window as W

    label = F.concat(F.when(F.coalesce("class_name", F.lit("")) != "", F.concat("class_name", F.lit("."))).otherwise(""), F.coalesce(F.nullif("name", F.lit("")), "id"))
    told = texts.groupBy("id").agg(F.min(F.struct(label.alias("label"), F.substring(summary_of(F.coalesce("text", F.lit(""))), 1, 40).alias("summary"))).alias("x"))
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "id"))
    hits = search_many(texts, questions, k).withColumn("place", place)
    return hits.join(told, "id").select("item", "place", F.concat(F.lit("["), F.format_string("%.4f", "score"), F.lit("] "), "x.label", F.lit(" → "), "x.summary").alias("line"))
