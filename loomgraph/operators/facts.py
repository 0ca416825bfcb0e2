"""Rules over structure facts: interface methods, semantic links, templates, services, entry paths, tables of methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.ids import method_id
from loomgraph.functions.predicates import is_method_node
from loomgraph.operators.graph import neighbours
from loomgraph.operators.policy import TABLE_TO_METHOD, WalkPolicy, allowed_edges
from loomgraph.operators.traverse import bfs
from loomgraph.store import staged


def _text(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def meaningful_methods(methods: DataFrame) -> DataFrame:
    """Methods with code that are neither getter nor setter. methods: id, code, is_getter, is_setter and others."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return methods.filter((F.coalesce("code", F.lit("")) != "") & ~flag("is_getter") & ~flag("is_setter"))


def declared_on_interfaces(methods: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The methods (id) that belong, under either spelling of their id, to a node that is an interface."""
    faces = nodes.filter(F.lower("entity_type") == "interface").select(F.col("id").alias("target_id"))
    owned = neighbours(edges, ["belongs_to"]).join(faces, "target_id", "left_semi").select(method_id(F.col("source_id")).alias("_key")).distinct()
    return methods.withColumn("_key", method_id(F.col("id"))).join(owned, "_key", "left_semi").drop("_key")


def not_declared_on_interfaces(methods: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The other methods."""
    own = declared_on_interfaces(methods.select("id").distinct(), nodes, edges)
    return methods.join(own, "id", "left_anti")


def concept_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """source_id, target_id, rel_type, confidence, source of business links: from a capability that implements an entity, else from the term of that id, else from the domain.

    links: concept_id, entity_id, link_type, confidence, source. A link whose concept, or for terms and domains
    whose entity, is no node gives no edge.
    """
    known = nodes.select("id").distinct()
    spelled = lambda scheme: F.concat(F.lit(f"{scheme}://"), "concept_id")
    has = lambda name: known.select(F.col("id").alias(f"{name}_id"), F.lit(True).alias(name))
    l = links.withColumns({"capability_id": spelled("capability"), "term_id": spelled("term"), "domain_id": spelled("domain")})  # noqa: E741
    for name in ("capability", "term", "domain"):
        l = l.join(has(name), f"{name}_id", "left")  # noqa: E741
    l = l.join(known.select(F.col("id").alias("entity_id"), F.lit(True).alias("entity")), "entity_id", "left")  # noqa: E741
    made = F.col("link_type") == "implemented_by"
    start = F.when(made, F.when(F.col("capability"), F.col("capability_id"))).when(F.col("entity"), F.when(F.col("term"), F.col("term_id")).when(F.col("domain"), F.col("domain_id")))
    out = l.select(start.alias("source_id"), F.col("entity_id").alias("target_id"), F.when(made, "IMPLEMENTED_BY").otherwise("RELATED_TO").alias("rel_type"), "confidence", F.when(made, F.col("source")).alias("source"))
    return out.filter("source_id IS NOT NULL")


def templates_of_methods(templates: DataFrame, methods: DataFrame, pairs_a_task: int = 2_000_000) -> DataFrame:
    """id, template_id, each once: the templates stored under a method's id in either spelling, or under the simple name of its class and its own name, in any case.

    templates: template_id, method_id, class_name, method_name. methods: id, class_name, name, signature, location. A method without
    a name is named by its signature, one without a class by the mapper file that it lies in.
    """
    by_id = templates.select("template_id", method_id(F.col("method_id")).alias("_key")).filter("_key <> ''")
    direct = methods.select("id", method_id(F.col("id")).alias("_key")).join(by_id, "_key").select("id", "template_id")
    simple = lambda c: F.lower(F.trim(F.substring_index(_text(c), ".", -1)))
    head = F.substring_index(F.trim(F.substring_index(_text("signature"), "(", 1)), " ", -1)
    named = F.when(_text("name") != "", F.lower(_text("name"))).when(F.instr("signature", "(") > 0, F.lower(F.substring_index(head, ".", -1))).otherwise("")
    file_class = F.lower(F.regexp_extract(F.translate(_text("location"), "\\", "/"), r"(?i)(\w+Mapper)\.java", 1))
    own = methods.select("id", F.when(simple("class_name") != "", simple("class_name")).otherwise(file_class).alias("_class"), named.alias("_name")).filter("_class <> '' AND _name <> ''").distinct()
    own = staged(own, "named")
    pairs = templates.select("template_id", simple("class_name").alias("_class"), F.lower(_text("method_name")).alias("_name")).filter("_class <> '' AND _name <> ''").distinct()
    pairs = staged(pairs, "pairs")
    # Only ids of several names can meet a template twice by name; and what was stored under an id is found by name too if the template has the id's name.
    several = staged(own.groupBy("id").agg(F.count("*").alias("_n")).filter("_n > 1").select("id"), "several")
    twice = direct.distinct().join(own, "id").join(pairs, ["template_id", "_class", "_name"], "left_semi").select("id", "template_id")
    rest = direct.distinct().join(twice.distinct(), ["id", "template_id"], "left_anti")
    by_name = _met(own.join(several, "id", "left_anti"), pairs, pairs_a_task)
    if not several.isEmpty():
        by_name = by_name.union(_met(own.join(several, "id", "left_semi"), pairs, pairs_a_task).distinct())
    return rest.union(by_name)


def _met(own: DataFrame, pairs: DataFrame, pairs_a_task: int) -> DataFrame:
    """id, template_id of one class and name; a name that very many share on both sides is dealt over several tasks by what it gives."""
    by = ["_class", "_name"]
    deals = own.groupBy(by).agg(F.count("*").alias("_own")).join(pairs.groupBy(by).agg(F.count("*").alias("_pairs")), by)
    deals = deals.select(*by, F.ceil(F.least(F.col("_own").cast("double") * F.col("_pairs") / pairs_a_task, F.col("_pairs").cast("double"))).cast("int").alias("_deals"))
    dealt = pairs.join(deals, by).select(*by, "template_id", F.pmod(F.xxhash64("template_id"), F.col("_deals").cast("long")).cast("int").alias("_deal"))
    blocks = own.join(deals, by).select(*by, "id", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1)).alias("_deal"))
    tasks = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many as that, not fewer: the output is much larger than the input
    spread = lambda df: df.repartition(tasks, *by, "_deal")
    return spread(dealt).hint("merge").join(spread(blocks), [*by, "_deal"]).select("id", "template_id")


def service_facts(entities: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, entity_type, name; edges: source_id, target_id, rel_type) that services add to the facts, each once.

    entities: id, entity_type, module_id, path, feign_target. modules: id. Every module is a service; classes and the like belong to
    their module's; a method with a path is an endpoint that the service exposes; a class with a feign target
    binds to that service, which is made if there is none, and its own service calls it, unless they are the same.
    """
    service = lambda c: F.concat(F.lit("service://"), c)
    own = modules.select("id").filter("id <> ''").distinct()
    configured = own.select(F.col("id").alias("module_id"), F.lit(True).alias("configured"))
    kind = F.lower("entity_type")
    placed = entities.join(configured, "module_id", "left")
    typed = placed.filter(kind.isin("class", "interface", "enum", "annotation_type") & F.col("configured")).select(F.col("id").alias("source_id"), service("module_id").alias("target_id"), F.lit("belongs_to").alias("rel_type"))
    routed = placed.filter((kind == "method") & (F.coalesce("path", F.lit("")) != ""))
    endpoint = F.concat(F.lit("api_endpoint://"), "id")
    exposed = routed.filter("configured").select(service("module_id").alias("source_id"), endpoint.alias("target_id"), F.lit("service_exposes").alias("rel_type"))
    bound = placed.filter(kind.isin("class", "interface") & (F.coalesce("feign_target", F.lit("")) != ""))
    binds = bound.select(F.col("id").alias("source_id"), service("feign_target").alias("target_id"), F.lit("binds_to_service").alias("rel_type"))
    known = own.select(F.col("id").alias("name")).union(bound.select("feign_target")).distinct()  # targets become services
    calls = bound.join(known.select(F.col("name").alias("module_id")), "module_id", "left_semi").filter("module_id <> feign_target").select(service("module_id").alias("source_id"), service("feign_target").alias("target_id"), F.lit("service_calls").alias("rel_type"))
    nodes = known.select(service("name").alias("id"), F.lit("service").alias("entity_type"), "name").union(routed.select(endpoint, F.lit("api_endpoint"), "path")).distinct()
    return nodes, typed.union(exposed).union(binds).union(calls).distinct()


def entry_paths(methods: DataFrame, most: int = 12) -> DataFrame:
    """entry, n: the paths of methods, with their module in brackets, that most methods have; ties by text."""
    path, module = F.coalesce("path", F.lit("")), F.coalesce("module_id", F.lit(""))
    entry = F.when(module != "", F.concat(path, F.lit("（"), module, F.lit("）"))).otherwise(path)
    return methods.filter(F.trim(path) != "").groupBy(entry.alias("entry")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entry").limit(most)


def ranked_modules(nodes: DataFrame) -> DataFrame:
    """module_id, n: modules by how many classes, interfaces and methods they have; ties by id."""
    kept = nodes.filter(F.lower("entity_type").isin("class", "interface", "method") & (F.coalesce("module_id", F.lit("")) != ""))
    return kept.groupBy("module_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "module_id")


def methods_named(methods: DataFrame, asked: DataFrame) -> DataFrame:
    """class_name, name, ids: all methods of a class and name, overloads included, in the order of ids. asked: class_name, name."""
    found = methods.join(asked.select("class_name", "name").distinct(), ["class_name", "name"])
    return found.groupBy("class_name", "name").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def methods_for_tables(accesses: DataFrame, edges: DataFrame, nodes: DataFrame, op_filter: str | None = None, max_hops: int = 8, policy: WalkPolicy = TABLE_TO_METHOD) -> DataFrame:
    """table, method_id, op, hop, source_id: the methods that access a table, and those that reach one of them, each through the first such access.

    accesses: table, method_id, op, ordinal; those of what is no method node don't count. op_filter: read for selects, write for all else. A method that accesses a table
    itself is told at hop 0 once for each access; another one with the op and hops of the first access, by ordinal, that it leads to.
    """
    methods = nodes.filter(is_method_node(F.col("id"), F.col("entity_type"))).select("id").distinct()
    own = accesses.join(methods.select(F.col("id").alias("method_id")), "method_id", "left_semi")
    reads = F.lower("op") == "select"
    own = own.filter(reads) if op_filter == "read" else own.filter(~reads) if op_filter == "write" else own
    direct = own.select("table", "method_id", "op", F.lit(0).alias("hop"), F.col("method_id").alias("source_id"))
    walk = allowed_edges(edges, policy, "up")
    reached = bfs(walk, own.select(F.col("method_id").alias("start_id"), F.col("method_id").alias("node_id")).distinct(), max_hops, "up").filter("hop > 0")
    reached = reached.join(methods.select(F.col("id").alias("node_id")), "node_id", "left_semi").select(F.col("start_id").alias("source_id"), F.col("node_id").alias("method_id"), "hop")
    first = own.groupBy("table", F.col("method_id").alias("source_id")).agg(F.min(F.struct("ordinal", "op")).alias("x")).select("table", "source_id", "x.ordinal", "x.op")
    led = first.join(reached, "source_id").join(own.select("table", "method_id").distinct(), ["table", "method_id"], "left_anti")
    best = led.groupBy("table", "method_id").agg(F.min(F.struct("ordinal", "source_id", "op", "hop")).alias("x"))
    return direct.unionByName(best.select("table", "method_id", "x.op", "x.hop", "x.source_id"))


def code_with_sql(methods: DataFrame, statements: DataFrame, tables: DataFrame, ddl: DataFrame) -> DataFrame:
    """id, text: a method's code; if it has a statement, that and the definitions of its tables below.

    methods: id, code. statements: id, sql. tables: id, ordinal, table. ddl: table, definition.
    """
    defined = tables.join(ddl.filter("definition <> ''"), "table").select("id", F.struct("ordinal", F.concat(F.lit("-- [表结构 "), "table", F.lit("]\n"), "definition").alias("text")).alias("x"))
    shown = defined.groupBy("id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["text"]).alias("defined"))
    out = methods.select("id", F.coalesce("code", F.lit("")).alias("code")).join(statements.filter("sql <> ''").select("id", "sql"), "id", "left").join(shown, "id", "left")
    parts = F.concat(F.array_compact(F.array(F.nullif("code", F.lit("")), F.concat(F.lit("-- [MyBatis SQL]\n"), "sql"))), F.coalesce("defined", F.array().cast("array<string>")))
    return out.select("id", F.when(F.col("sql").isNull(), F.col("code")).otherwise(F.array_join(parts, "\n\n")).alias("text"))


def modules_of_domain(modules: DataFrame, domain: str | None, text: str | None) -> DataFrame:
    """The modules of a domain, all if none is named, whose id holds a text in any case. modules: id, business_domain and others."""
    out = modules.filter(_text("business_domain") == domain) if domain else modules
    return out.filter(F.lower(F.coalesce("id", F.lit(""))).contains(text.lower())) if text else out


def valid_patterns(patterns: DataFrame, allowed: dict[str, list[str]], most_ids: int = 32) -> DataFrame:
    """scope, pattern_type, pattern_name, confidence, summary, entity_ids, notes of the answers that count: of an allowed name for their type, with a summary; confidences between 0 and 1.

    patterns: scope, pattern_type, pattern_name, confidence (text or number), summary, entity_ids, notes. allowed: type to names.
    """
    kind, name = F.lower(_text("pattern_type")), _text("pattern_name")
    known = F.lit(False)
    for k, names in allowed.items():
        known = known | ((kind == k) & name.isin(names))
    sure = F.coalesce(F.expr("try_cast(confidence AS double)"), F.lit(0.0))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(sure), 0.0).otherwise(sure)))
    ids = F.slice(F.filter(F.coalesce("entity_ids", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != ""), 1, most_ids)
    return patterns.filter(known & (_text("summary") != "")).select("scope", kind.alias("pattern_type"), name.alias("pattern_name"), clamped.alias("confidence"), F.substring(_text("summary"), 1, 5000).alias("summary"), ids.alias("entity_ids"), F.substring(_text("notes"), 1, 2000).alias("notes"))


def session_detail(sessions: DataFrame, messages: DataFrame, session_id: object, user_id: object) -> DataFrame:
    """The messages of a session in order; none if it isn't the user's. sessions: session_id, user_id; messages: session_id, created_at and others."""
    own = sessions.filter((F.col("session_id") == session_id) & (F.col("user_id") == user_id)).select("session_id").distinct()
    return messages.join(own, "session_id", "left_semi").orderBy("created_at")


def retrieved_contexts(hits: DataFrame, edges: DataFrame, expanded: int = 3, most_peers: int = 5) -> DataFrame:
    """id, score, callees, callers, tables of hits (id, score): the first ``expanded`` with at most ``most_peers`` of each side, any relation, and the tables that they access; nulls for the others."""
    rank = F.row_number().over(W.orderBy(F.desc("score"), "id"))  # over the hits of one question
    ranked = hits.select("id", "score", rank.alias("rank"))
    wanted = ranked.filter(F.col("rank") <= expanded).select("id")
    none = F.array().cast("array<string>")

    def peers(near: str, far: str, rows: DataFrame, most: int | None, name: str) -> DataFrame:
        own = rows.select(F.col(near).alias("id"), F.col(far).alias("peer")).join(F.broadcast(wanted), "id").distinct()  # ``expanded`` ids
        if most:
            own = own.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("peer"))).filter(F.col("n") <= most)
        return wanted.join(own.groupBy("id").agg(F.sort_array(F.collect_list("peer")).alias(name)), "id", "left").select("id", F.coalesce(name, none).alias(name))

    out = ranked.join(peers("source_id", "target_id", edges, most_peers, "callees"), "id", "left").join(peers("target_id", "source_id", edges, most_peers, "callers"), "id", "left")
    return out.join(peers("source_id", "target_id", neighbours(edges, ["accesses_table"]), None, "tables"), "id", "left").select("id", "score", "callees", "callers", "tables")
