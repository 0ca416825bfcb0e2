"""Business vocabulary: term lookup, terms in names and texts, capabilities by path pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.predicates import is_controller_like


def term_lookup(terms: DataFrame) -> DataFrame:
    """term, term_id: lower-cased names and synonyms of terms(id, name, synonyms, ordinal); the later term wins, its name before its synonyms."""
    spelled = terms.select(F.explode(F.concat(F.array(F.struct(F.lit(0).alias("at"), F.col("name").alias("term"))), F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), lambda s, i: F.struct((i + 1).alias("at"), s.alias("term"))))).alias("x"), "id", "ordinal")
    spelled = spelled.select(F.lower("x.term").alias("term"), "x.at", "id", "ordinal").filter("term <> ''")
    return spelled.groupBy("term").agg(F.max_by("id", F.struct("ordinal", "at", "id")).alias("term_id"))


def camel_tokens(token: Column) -> Column:
    """Lower-cased parts of a camel-case or underscored word."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(token, "_", " "), F.lit(r"([A-Za-z][a-z0-9]*|[A-Z])"), F.lit(1)), lambda t: F.lower(t))


def term_matches(texts: DataFrame, lookup: DataFrame) -> DataFrame:
    """id, term_ids: terms in the order in which a text's whole words name them, then its words' parts; each once.

    texts: id, text. lookup: term, term_id.
    """
    whole = F.regexp_extract_all("text", F.lit(r"([A-Za-z][a-zA-Z0-9]*)"), F.lit(1))
    tokens = F.concat(F.transform(whole, lambda t: F.lower(t)), F.flatten(F.transform(whole, camel_tokens)))
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # texts are short before they are exploded: dealt by number, not by size
    placed = texts.select("id", "text").repartition(tasks, "id").select("id", F.posexplode(tokens).alias("at", "term"))  # repeats go at the end, so that nothing is grouped by word
    ordered = F.sort_array(F.collect_list(F.struct("at", "term_id")))
    return placed.join(lookup, "term").groupBy("id").agg(F.array_distinct(F.transform(ordered, lambda x: x["term_id"])).alias("term_ids"))


def capability_links(methods: DataFrame, capabilities: list[tuple[str, str]]) -> DataFrame:
    """id, capability, evidence, confidence: a link for every capability whose pattern ('**' for anything) is found in a path, 0.9;
    without any, the first capability for methods of classes that take requests, 0.5.

    methods: id, path, class_name. capabilities: (name, pattern) in their order; an empty pattern matches nothing.
    """
    hits = [F.when(F.col("path").rlike(pattern.replace("**", ".*")), name) for name, pattern in capabilities if pattern]
    found = methods.select("id", "class_name", (F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")).alias("found"))
    matched = found.select("id", F.explode("found").alias("capability"), F.lit("path_match").alias("evidence"), F.lit(0.9).alias("confidence"))
    named = [n for n, _ in capabilities if n]
    rest = found.filter((F.size("found") == 0) & is_controller_like(F.col("class_name"))).select("id", F.lit(named[0] if named else None).cast("string").alias("capability"), F.lit("class_naming").alias("evidence"), F.lit(0.5).alias("confidence"))
    return matched.unionByName(rest.filter("capability IS NOT NULL"))
