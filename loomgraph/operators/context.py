"""Assembly of contexts, cards and reports from nodes, relations and stored texts.

Lists that a text shows are capped per group by row numbers, which Spark limits before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.code import bean_calls
from loomgraph.functions.lexical import identifier_words
from loomgraph.operators.graph import neighbours


def _blank_as_null(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_of_each(rows: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """key, values: the first ``most`` distinct values of each key, in order."""
    rn = F.row_number().over(W.partitionBy(key).orderBy(value))
    kept = rows.select(key, value).distinct().withColumn("rn", rn).filter(F.col("rn") <= most)
    return kept.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("values"))


def method_contexts(nodes: DataFrame, edges: DataFrame, most_callers: int = 5, most_callees: int = 8) -> DataFrame:
    """id, class_name, signature, module_id, callers, callees of every method; peers as class.name, ``-`` for none."""
    methods = nodes.filter("entity_type = 'method'")
    shown = methods.select(F.col("id").alias("peer"), F.concat_ws(".", _blank_as_null("class_name"), "name").alias("shown"))
    called = neighbours(edges, ["calls"])

    def side(near: str, far: str, most: int) -> DataFrame:
        peers = called.select(F.col(near).alias("id"), F.col(far).alias("peer")).join(shown, "peer", "left").select("id", F.coalesce("shown", F.substring("peer", 1, 20)).alias("shown"))
        return first_of_each(peers, "id", "shown", most).select("id", F.array_join("values", ", ").alias(far))

    out = methods.join(side("target_id", "source_id", most_callers), "id", "left").join(side("source_id", "target_id", most_callees), "id", "left")
    none = lambda c: F.coalesce(c, F.lit("-"))
    return out.select("id", F.coalesce("class_name", F.lit("")).alias("class_name"), F.coalesce("signature", "name").alias("signature"), F.coalesce("module_id", F.lit("")).alias("module_id"), none("source_id").alias("callers"), none("target_id").alias("callees"))


def related_ids(methods: DataFrame, edges: DataFrame, most: int = 24) -> DataFrame:
    """id, related: the method itself, then its callers, callees and containers, ``most`` in all."""
    called, held = neighbours(edges, ["calls"]), neighbours(edges, ["contains"])
    peers = called.select(F.col("source_id").alias("id"), F.col("target_id").alias("peer")).union(called.select("target_id", "source_id")).union(held.select("target_id", "source_id"))
    peers = peers.filter("id <> peer").join(methods.select("id"), "id", "left_semi")
    kept = first_of_each(peers, "id", "peer", most - 1)
    return methods.select("id").join(kept, "id", "left").select("id", F.concat(F.array("id"), F.coalesce("values", F.array().cast("array<string>"))).alias("related"))


def bean_contexts(codes: DataFrame, comments: DataFrame, most_chars: int = 1500) -> DataFrame:
    """id, context: a line ``Class.field: comment`` for each commented property that a code touches, until the budget is used up.

    codes: id, code; comments: class_name, field, comment.
    """
    tasks = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # all that follows goes by id and finds it dealt
    uses = codes.select("id", "code").repartition(tasks, "id").select("id", F.posexplode(bean_calls(F.col("code"))).alias("pos", "use")).select("id", "pos", "use.class_name", "use.field")
    once = uses.groupBy("id", "class_name", "field").agg(F.min("pos").alias("pos"))
    lines = once.join(comments.filter("comment <> ''"), ["class_name", "field"]).select("id", "pos", F.concat("class_name", F.lit("."), "field", F.lit(": "), "comment").alias("line"))
    total = F.sum(F.length("line")).over(W.partitionBy("id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    kept = lines.withColumn("total", total).filter(F.col("total") <= most_chars)
    return kept.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("context"))


def text_blobs(methods: DataFrame, interpretations: DataFrame, summaries: DataFrame) -> DataFrame:
    """id, blob: what the words of a question are looked for in. interpretations: id, text; summaries: id, text."""
    out = methods.join(interpretations.select("id", F.coalesce("text", F.lit("")).alias("told")), "id", "left")
    out = out.join(summaries.select("id", F.coalesce("text", F.lit("")).alias("summary")), "id", "left")
    words = lambda c: F.nullif(identifier_words(F.col(c)), F.lit(""))
    given = lambda c: F.coalesce(c, F.lit(""))
    return out.select("id", F.concat_ws("\n", given("name"), given("signature"), words("name"), words("signature"), "told", "summary").alias("blob"))


def excerpts(methods: DataFrame, classes: DataFrame, most: int = 3, chars: int = 900) -> DataFrame:
    """class_name, id, excerpt: the first ``most`` methods with code of each wanted class, cut to what a report shows."""
    found = methods.filter("trim(code) <> ''").join(classes.select("class_name").distinct(), "class_name", "left_semi")
    kept = found.withColumn("rn", F.row_number().over(W.partitionBy("class_name").orderBy("id"))).filter(F.col("rn") <= most)
    cut = F.concat(F.replace(F.substring("code", 1, chars), F.lit("\n"), F.lit(" ")), F.when(F.length("code") > chars, "…").otherwise(""))
    return kept.select("class_name", "id", cut.alias("excerpt"))


def cards(asked: DataFrame, nodes: DataFrame, listing: DataFrame) -> DataFrame:
    """id, entity_type, name, signature, class_name, module_id of asked ids, for display.

    A method's listing (id, title, signature, class_name) goes before its node's signature and class; a name falls back to the title, then the id.
    """
    listed = listing.select("id", F.col("title").alias("l_title"), F.col("signature").alias("l_signature"), F.col("class_name").alias("l_class"))
    out = asked.select("id").distinct().join(nodes, "id", "left").join(listed, "id", "left")
    method = F.coalesce(F.col("entity_type") == "method", F.lit(False))
    first = lambda own, theirs: F.coalesce(F.when(method, _blank_as_null(theirs)), _blank_as_null(own), F.lit(""))
    name = F.coalesce(_blank_as_null("name"), F.when(method, _blank_as_null("l_title")), F.col("id"))
    return out.select("id", F.coalesce("entity_type", F.lit("")).alias("entity_type"), name.alias("name"), first("signature", "l_signature").alias("signature"), first("class_name", "l_class").alias("class_name"), "module_id")


def cited(sections: Column) -> Column:
    """Distinct entity ids in order of an array of sections with references (arrays of structs with entity_id)."""
    none = F.array().cast("array<string>")
    every = F.flatten(F.transform(sections, lambda s: F.coalesce(F.transform(s["references"], lambda r: r["entity_id"]), none)))
    return F.array_distinct(F.filter(every, lambda i: i.isNotNull() & (i != "")))


def domain_background(domains: Column, capabilities: Column, most_domains: int = 10, most_capabilities: int = 15) -> Column:
    """A text of the first domains (id, name, capability_ids) and capabilities (id, name, path_pattern) of a configuration."""
    # The two headings.
    heads = ("业务域：", "业务能力：")
    line = lambda x, rest: F.concat(F.lit("- "), F.coalesce(F.nullif(x["name"], F.lit("")), x["id"], F.lit("")), F.lit(": "), rest)
    own = F.transform(F.slice(domains, 1, most_domains), lambda x: line(x, F.coalesce(F.array_join(x["capability_ids"], ", "), F.lit(""))))
    able = F.transform(F.slice(capabilities, 1, most_capabilities), lambda x: line(x, F.coalesce(x["path_pattern"], F.lit(""))))
    none = F.array().cast("array<string>")
    return F.array_join(F.concat(F.when(F.size(own) > 0, F.concat(F.array(F.lit(heads[0])), own)).otherwise(none), F.when(F.size(able) > 0, F.concat(F.array(F.lit(""), F.lit(heads[1])), able)).otherwise(none)), "\n")


def service_docs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """service_id, name, n_nodes, n_edges of every service: its module's entities, and the relations between them."""
    services = nodes.filter("entity_type = 'service'").select(F.col("id").alias("service_id"), "name")
    owned = nodes.filter("module_id IS NOT NULL").select("id", "module_id")
    end = lambda side: owned.select(F.col("id").alias(f"{side}_id"), F.col("module_id").alias(f"{side}_module"))
    within = edges.join(end("source"), "source_id").join(end("target"), "target_id").filter("source_module = target_module")
    counts = owned.groupBy(F.col("module_id").alias("name")).agg(F.count("*").alias("n_nodes"))
    links = within.groupBy(F.col("source_module").alias("name")).agg(F.count("*").alias("n_edges"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return services.join(counts, "name", "left").join(links, "name", "left").select("service_id", "name", zero("n_nodes"), zero("n_edges"))


def domain_docs(edges: DataFrame) -> DataFrame:
    """domain_id, n_capabilities, n_entities, n_services of every domain that a relation names."""
    rel = F.lower("rel_type")
    roles = edges.select(F.when(rel == "contains_capability", F.col("source_id")).when(rel.isin("in_domain", "belongs_to_domain"), F.col("target_id")).alias("domain_id"), rel.alias("rel"), "source_id")
    service = (F.col("rel") == "belongs_to_domain") & F.col("source_id").startswith("service://")
    return roles.filter("domain_id IS NOT NULL").groupBy("domain_id").agg(F.count_if(F.col("rel") == "contains_capability").alias("n_capabilities"), F.count_if(F.col("rel") == "in_domain").alias("n_entities"), F.count_if(service).alias("n_services"))


def counts_of_types(nodes: DataFrame, types: list[str]) -> DataFrame:
    """entity_type, n of the wanted types that occur."""
    return nodes.filter(F.col("entity_type").isin(types)).groupBy("entity_type").agg(F.count("*").alias("n"))


def system_evidence(nodes: DataFrame, edges: DataFrame, types: list[str], most_modules: int = 12, most_edges: int = 10) -> DataFrame:
    """section, line of a report: the first modules, counts of the wanted types, and the most frequent relations between modules."""
    modules = nodes.filter("module_id <> ''").select("module_id").distinct().orderBy("module_id").limit(most_modules)
    counts = counts_of_types(nodes, types).select(F.lit("counts"), F.concat("entity_type", F.lit("="), "n"))
    owned = nodes.filter("module_id <> ''").select("id", "module_id")
    end = lambda side: owned.select(F.col("id").alias(f"{side}_id"), F.col("module_id").alias(f"{side}_module"))
    across = edges.join(end("source"), "source_id").join(end("target"), "target_id").filter("source_module <> target_module")
    top = across.groupBy("source_module", "target_module", "rel_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_module", "target_module", "rel_type").limit(most_edges)
    links = top.select(F.lit("dependencies"), F.concat("source_module", F.lit(" -> "), "target_module", F.lit(" "), "rel_type", F.lit(" x"), "n"))
    return modules.select(F.lit("modules").alias("section"), F.col("module_id").alias("line")).union(counts).union(links)
