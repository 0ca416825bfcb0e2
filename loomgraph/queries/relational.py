"""Filters, joins, aggregations, windows, top-k and set operations over the graph tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import predicates as P
from loomgraph.functions import text as X
from loomgraph.operators import graph as G
from loomgraph.operators.traverse import levels
from loomgraph.queries._registry import query
from loomgraph.session import table
from loomgraph.sources.tables import EDGES_SQL, METHODS_SQL, NODES_SQL, calls, code_methods, edges, nodes

NODES, EDGES, BOTH = f"WITH {NODES_SQL}", f"WITH {EDGES_SQL}", f"WITH {NODES_SQL}, {EDGES_SQL}"


@query("f1_node_by_id", f"{NODES} SELECT id, entity_type, name FROM nodes WHERE id = 'method://p7'")
def f1(spark, d):
    return nodes(spark, d).filter(F.col("id") == "method://p7").select("id", "entity_type", "name")


@query("f2_relations_from", f"{EDGES} SELECT target_id, rel_type FROM edges WHERE source_id = 'order//7' AND rel_type = 'uses'")
def f2(spark, d):
    return edges(spark, d).filter("source_id = 'order//7' AND rel_type = 'uses'").select("target_id", "rel_type")


@query("f3_by_types", f"{NODES} SELECT entity_type, count(*) AS n, min(id) AS first_id FROM nodes WHERE entity_type IN ('service', 'package', 'class') GROUP BY entity_type")
def f3(spark, d):
    return nodes(spark, d).filter(F.col("entity_type").isin("service", "package", "class")).groupBy("entity_type").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("f4_search_by_name", f"{NODES} SELECT id, name FROM nodes WHERE entity_type = 'method' AND contains(lower(coalesce(name, '')), 'blue')")
def f4(spark, d):
    return G.search_by_name(nodes(spark, d), "BLUE", ["method"]).select("id", "name")


@query("f5_search_name_or_id", f"{NODES} SELECT id, name FROM nodes WHERE contains(lower(coalesce(name, '')), 'p19') OR contains(lower(id), 'p19') ORDER BY coalesce(name, id), id LIMIT 100")
def f5(spark, d):
    return G.search_by_name(nodes(spark, d), "p19", mode="name_or_id").select("id", "name")


@query("f6_list_page", f"{NODES} SELECT id, name FROM nodes WHERE entity_type = 'class' ORDER BY coalesce(name, id), id LIMIT 50 OFFSET 100")
def f6(spark, d):
    return nodes(spark, d).filter("entity_type = 'class'").orderBy(F.coalesce("name", "id"), "id").offset(100).limit(50).select("id", "name")


@query("f7_letter_buckets", f"""{NODES} SELECT CASE WHEN lower(substr(coalesce(name, id), 1, 1)) BETWEEN 'a' AND 'z' THEN lower(substr(coalesce(name, id), 1, 1)) ELSE 'other' END AS bucket,
  entity_type, count(*) AS n FROM nodes GROUP BY ALL""")
def f7(spark, d):
    return nodes(spark, d).groupBy(G.letter_bucket(F.coalesce("name", "id")).alias("bucket"), "entity_type").agg(F.count("*").alias("n"))


@query("f8_declared_by_type", f"""{BOTH} SELECT n.id FROM nodes n WHERE n.entity_type = 'method' AND n.id IN
  (SELECT source_id FROM edges JOIN nodes o ON o.id = target_id WHERE rel_type = 'depends_on' AND o.module_id = 'ASIA')""")
def f8(spark, d):
    n = nodes(spark, d)
    owners = n.filter("module_id = 'ASIA'").select(F.col("id").alias("target_id"))
    declared = edges(spark, d).filter("rel_type = 'depends_on'").join(owners, "target_id", "left_semi").select(F.col("source_id").alias("id"))
    return n.filter("entity_type = 'method'").join(declared, "id", "left_semi").select("id")


@query("f9_meaningful", "SELECT doc_id, n_chars FROM documents WHERE length(coalesce(text, '')) > 0 AND NOT regexp_matches(text, '^(Get|Set|Is)')")
def f9(spark, d):
    return table(spark, d, "documents").filter((F.length(F.coalesce("text", F.lit(""))) > 0) & ~F.col("text").rlike("^(Get|Set|Is)")).select("doc_id", "n_chars")


@query("f12_exclude_prefixes", f"{NODES} SELECT id FROM nodes WHERE NOT (starts_with(id, 'order//') OR starts_with(id, 'class//c'))")
def f12(spark, d):
    return nodes(spark, d).filter(~(F.col("id").startswith("order//") | F.col("id").startswith("class//c"))).select("id")


@query("f13_class_roles", f"""WITH {METHODS_SQL} SELECT CASE WHEN class_name LIKE '%Controller' THEN 'Controller' WHEN regexp_matches(class_name, '(Service|Facade|Manager)$') THEN 'Service'
  WHEN class_name LIKE '%Mapper' THEN 'Repository' ELSE 'Other' END AS role, count(*) AS n FROM methods GROUP BY 1""")
def f13(spark, d):
    return code_methods(spark, d).groupBy(X.class_role(F.col("class_name")).alias("role")).agg(F.count("*").alias("n"))


@query("f16_code_types", f"{NODES} SELECT entity_type IN ('class', 'method', 'package', 'service', 'api_endpoint') AS is_code, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT false, count(*) FROM events")
def f16(spark, d):
    types = nodes(spark, d).select("entity_type").union(table(spark, d, "events").select("event_type"))
    return types.groupBy(P.is_code_type(F.col("entity_type")).alias("is_code")).agg(F.count("*").alias("n"))


@query("f19_labels", f"{NODES} SELECT id, coalesce(class_name || '.', '') || coalesce(name, id) || coalesce(' : ' || signature, '') AS label FROM nodes WHERE entity_type IN ('method', 'package')")
def f19(spark, d):
    n = nodes(spark, d).filter(F.col("entity_type").isin("method", "package"))
    part = lambda before, c, after: F.coalesce(F.concat(F.lit(before), c, F.lit(after)), F.lit(""))
    return n.select("id", F.concat(part("", "class_name", "."), F.coalesce("name", "id"), part(" : ", "signature", "")).alias("label"))


@query("j1_first_owner", f"""{BOTH} SELECT e.source_id AS id, min(e.target_id) AS owner_id FROM edges e JOIN nodes n ON n.id = e.target_id
  WHERE e.rel_type = 'belongs_to' AND n.entity_type = 'class' GROUP BY 1""")
def j1(spark, d):
    owners = nodes(spark, d).filter("entity_type = 'class'").select(F.col("id").alias("target_id"))
    return edges(spark, d).filter("rel_type = 'belongs_to'").join(owners, "target_id", "left_semi").groupBy(F.col("source_id").alias("id")).agg(F.min("target_id").alias("owner_id"))


def _peers_sql(near: str, far: str) -> str:
    return f"{BOTH} SELECT DISTINCT p.class_name, p.name FROM nodes n JOIN edges e ON n.id = e.{near} AND e.rel_type = 'calls' JOIN nodes p ON p.id = e.{far} WHERE n.name = (SELECT min(p_name) FROM part)"


def _some_name(spark, d):
    return table(spark, d, "part").agg(F.min("p_name")).first()[0]


@query("j2_direct_callees", _peers_sql("source_id", "target_id"))
def j2(spark, d):
    return G.direct_peers(nodes(spark, d), edges(spark, d), _some_name(spark, d))


@query("j3_direct_callers", _peers_sql("target_id", "source_id"))
def j3(spark, d):
    return G.direct_peers(nodes(spark, d), edges(spark, d), _some_name(spark, d), down=False)


@query("j4_relations_with_peers", f"""{BOTH}, r AS (SELECT 'out' AS direction, rel_type, target_id AS peer_id FROM edges WHERE source_id = 'method://p5'
  UNION ALL SELECT 'in', rel_type, source_id FROM edges WHERE target_id = 'method://p5') SELECT direction, rel_type, peer_id, name AS peer_name, entity_type AS peer_type FROM r LEFT JOIN nodes ON id = peer_id""")
def j4(spark, d):
    return G.relations_of(nodes(spark, d), edges(spark, d), "method://p5")


@query("j5_degrees", f"{EDGES} SELECT source_id AS id, rel_type, count(*) AS successors FROM edges GROUP BY ALL")
def j5(spark, d):
    return edges(spark, d).groupBy(F.col("source_id").alias("id"), "rel_type").agg(F.count("*").alias("successors"))


@query("j6_excluding_relations", f"{EDGES} SELECT source_id, target_id FROM edges WHERE lower(rel_type) NOT IN ('uses', 'belongs_to')")
def j6(spark, d):
    return G.neighbours(edges(spark, d), excluded=["USES", "belongs_to"]).select("source_id", "target_id")


@query("j7_not_declared_abstract", f"""{BOTH} SELECT id FROM nodes WHERE entity_type = 'method' AND NOT EXISTS
  (SELECT 1 FROM edges JOIN nodes o ON o.id = target_id WHERE source_id = nodes.id AND rel_type = 'depends_on' AND o.module_id = 'EUROPE')""")
def j7(spark, d):
    n = nodes(spark, d)
    banned = edges(spark, d).filter("rel_type = 'depends_on'").join(n.filter("module_id = 'EUROPE'").select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return n.filter("entity_type = 'method'").join(banned.select(F.col("source_id").alias("id")), "id", "left_anti").select("id")


@query("j9_first_of_two_links", """SELECT o_orderkey, coalesce('term//' || t.doc_id, 'domain//' || n_nationkey, 'none') AS concept FROM orders
  LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) t ON t.doc_id = o_orderkey LEFT JOIN nation ON n_nationkey = o_orderkey""")
def j9(spark, d):
    terms = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("o_orderkey"), F.concat(F.lit("term//"), "doc_id").alias("t"))
    domains = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("o_orderkey"), F.concat(F.lit("domain//"), "n_nationkey").alias("n"))
    return table(spark, d, "orders").join(terms, "o_orderkey", "left").join(domains, "o_orderkey", "left").select("o_orderkey", F.coalesce("t", "n", F.lit("none")).alias("concept"))


@query("j10_induced_subgraph", f"""{BOTH}, s AS (SELECT id FROM nodes WHERE module_id = 'ASIA' OR id = 'service://ASIA')
  SELECT source_id, target_id, rel_type FROM edges WHERE source_id IN (SELECT id FROM s) AND target_id IN (SELECT id FROM s)""")
def j10(spark, d):
    return G.induced_edges(edges(spark, d), nodes(spark, d).filter("module_id = 'ASIA' OR id = 'service://ASIA'"))


@query("j12_by_id_or_name", """SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey OR (l_suppkey = p_partkey AND l_returnflag = 'R')""")
def j12(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    by_id = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    by_name = lines.filter("l_returnflag = 'R'").join(part, F.col("l_suppkey") == F.col("p_partkey"))
    return by_id.union(by_name).select("l_orderkey", "l_partkey", "l_suppkey", "p_name").distinct()


@query("j16_enriched_edges", f"""{BOTH} SELECT source_id, target_id, rel_type, coalesce(s.name, 'unknown') AS source_name, coalesce(s.entity_type, 'unknown') AS source_type,
  coalesce(t.name, 'unknown') AS target_name, coalesce(t.entity_type, 'unknown') AS target_type FROM edges LEFT JOIN nodes s ON s.id = source_id LEFT JOIN nodes t ON t.id = target_id""")
def j16(spark, d):
    return G.enriched_edges(nodes(spark, d), edges(spark, d))


@query("j19_module_domains", "SELECT r_name AS module_id, string_agg(n_name, ', ' ORDER BY n_name) AS domains FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def j19(spark, d):
    joined = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # the five regions
    return joined.groupBy(F.col("r_name").alias("module_id")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("domains"))


@query("j21_cross_module_pairs", f"""{BOTH} SELECT s.module_id AS source_module, t.module_id AS target_module, rel_type, count(*) AS n FROM edges
  JOIN nodes s ON s.id = source_id JOIN nodes t ON t.id = target_id WHERE s.module_id <> t.module_id GROUP BY ALL""")
def j21(spark, d):
    n = nodes(spark, d)
    joined = edges(spark, d).join(n.select(F.col("id").alias("source_id"), F.col("module_id").alias("source_module")), "source_id").join(n.select(F.col("id").alias("target_id"), F.col("module_id").alias("target_module")), "target_id")
    return joined.filter("source_module <> target_module").groupBy("source_module", "target_module", "rel_type").agg(F.count("*").alias("n"))


@query("j22_either_key", "SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000007' OR c_custkey = 8")
def j22(spark, d):
    return table(spark, d, "customer").filter((F.col("c_name") == "Customer#000000007") | (F.col("c_custkey") == 8)).select("c_custkey", "c_name")


@query("a1_counts", f"{BOTH} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def a1(spark, d):
    return nodes(spark, d).agg(F.count("*").alias("nodes")).crossJoin(edges(spark, d).agg(F.count("*").alias("edges")))


@query("a3_histogram_top", f"{NODES} SELECT entity_type, count(*) AS n FROM nodes GROUP BY 1 ORDER BY n DESC, entity_type LIMIT 3")
def a3(spark, d):
    return nodes(spark, d).groupBy("entity_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_type").limit(3)


@query("a5_entry_paths", f"{NODES} SELECT name || '@' || coalesce(module_id, '?') AS entry, count(*) AS n FROM nodes WHERE entity_type = 'api_endpoint' GROUP BY 1 ORDER BY n DESC, entry LIMIT 12")
def a5(spark, d):
    entry = F.concat("name", F.lit("@"), F.coalesce("module_id", F.lit("?"))).alias("entry")
    return nodes(spark, d).filter("entity_type = 'api_endpoint'").groupBy(entry).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entry").limit(12)


@query("a6_cross_module_top", f"""{BOTH} SELECT s.module_id || ' -> ' || t.module_id AS pair, count(*) AS n FROM edges JOIN nodes s ON s.id = source_id JOIN nodes t ON t.id = target_id
  WHERE s.module_id <> t.module_id GROUP BY 1 ORDER BY n DESC, pair LIMIT 10""")
def a6(spark, d):
    pairs = j21(spark, d).groupBy(F.concat_ws(" -> ", "source_module", "target_module").alias("pair")).agg(F.sum("n").alias("n"))
    return pairs.orderBy(F.desc("n"), "pair").limit(10)


@query("a7_modules", f"{NODES} SELECT DISTINCT module_id FROM nodes WHERE module_id IS NOT NULL ORDER BY 1 LIMIT 200")
def a7(spark, d):
    return nodes(spark, d).filter("module_id IS NOT NULL").select("module_id").distinct().orderBy("module_id").limit(200)


@query("a8_merge_max", """SELECT id, greatest(max(score), 0.0) AS score FROM (SELECT o_custkey AS id, o_totalprice AS score FROM orders UNION ALL SELECT c_custkey, c_acctbal FROM customer)
  GROUP BY id ORDER BY score DESC, id LIMIT 160""")
def a8(spark, d):
    both = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("score")).union(table(spark, d, "customer").select("c_custkey", "c_acctbal"))
    return both.groupBy("id").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "id").limit(160)


def _part_levels(spark, d):
    """p_partkey, p_brand, level of every part: its method's level in the call graph."""
    part = table(spark, d, "part").select("p_partkey", "p_brand", F.concat(F.lit("method://p"), "p_partkey").alias("id"))
    return part.join(levels(calls(spark, d), part.select("id")).select("id", "level").hint("merge"), "id").select("p_partkey", "p_brand", "level")


@query("a12_module_level_pivot", """SELECT p_brand AS module_id, count(*) FILTER (level = 0) AS l0, count(*) FILTER (level BETWEEN 1 AND 5) AS low, count(*) FILTER (level > 5) AS high FROM
  (SELECT p_brand, CASE WHEN p_partkey < 2 THEN 0 ELSE CAST(floor(log2(p_partkey)) AS INT) END AS level FROM part) GROUP BY 1""")
def a12(spark, d):
    level = F.col("level")
    band = F.when(level == 0, "l0").when(level <= 5, "low").otherwise("high")
    out = _part_levels(spark, d).withColumn("band", band).groupBy(F.col("p_brand").alias("module_id")).pivot("band", ["l0", "low", "high"]).count()
    return out.na.fill(0, ["l0", "low", "high"])


@query("a13_degree_statistics", f"""{BOTH} SELECT count(*) FILTER (o IS NULL AND i IS NOT NULL) AS leaf, count(*) FILTER (i IS NULL AND o IS NOT NULL) AS root, count(*) FILTER (o IS NULL AND i IS NULL) AS isolated
  FROM nodes LEFT JOIN (SELECT source_id, count(*) AS o FROM calls GROUP BY 1) ON source_id = id LEFT JOIN (SELECT target_id, count(*) AS i FROM calls GROUP BY 1) ON target_id = id WHERE entity_type = 'method'""")
def a13(spark, d):
    call = edges(spark, d).filter("rel_type = 'calls'")
    degree = lambda c, name: call.groupBy(F.col(c).alias("id")).agg(F.count("*").alias(name))
    n = nodes(spark, d).filter("entity_type = 'method'").join(degree("source_id", "o"), "id", "left").join(degree("target_id", "i"), "id", "left")
    return n.agg(F.count_if(F.col("o").isNull() & F.col("i").isNotNull()).alias("leaf"), F.count_if(F.col("i").isNull() & F.col("o").isNotNull()).alias("root"), F.count_if(F.col("o").isNull() & F.col("i").isNull()).alias("isolated"))


@query("a14_size_samples", """SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)
  WHERE rn = 1 OR rn = n // 2 + 1 OR rn = n""")
def a14(spark, d):
    return G.samples_by_size(table(spark, d, "documents"), "lang", "n_chars", "doc_id")


@query("a15_cost_estimate", "SELECT source, round(avg(n_chars), 6) AS avg_chars, CAST(sum(least(n_chars // 100, 10) * 300) AS BIGINT) AS context_chars FROM documents GROUP BY 1")
def a15(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.round(F.avg("n_chars"), 6).alias("avg_chars"), F.sum(F.least(F.expr("n_chars div 100"), F.lit(10)) * 300).alias("context_chars"))


@query("a18_progress", "SELECT count(*) AS total, count(l.doc_id) AS done, least(100, 100 * count(l.doc_id) // count(*)) AS percent FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def a18(spark, d):
    done = table(spark, d, "labels").select("doc_id").distinct().withColumn("done", F.lit(1))
    out = table(spark, d, "documents").join(done, "doc_id", "left").agg(F.count("*").alias("total"), F.count("done").alias("done"))
    return out.withColumn("percent", F.least(F.lit(100), F.expr("100 * done div total")))


@query("a20_keyword_scores", """SELECT doc_id, CAST(contains(lower(text), 'factory') AS INT) * 3 + CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'ion') AS INT) * 2 AS score
  FROM documents ORDER BY score DESC, doc_id LIMIT 10""")
def a20(spark, d):
    has = lambda w, n: F.lower("text").contains(w).cast("int") * n
    return table(spark, d, "documents").select("doc_id", (has("factory", 3) + has("the", 1) + has("ion", 2)).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query("a23_token_estimate", "SELECT doc_id, greatest(1, CAST(floor(length(text) / 1.5) AS INT)) AS tokens FROM documents")
def a23(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("w1_cumulative_share", """SELECT level, n, round(100.0 * n / sum(n) OVER (), 6) AS pct, round(100.0 * sum(n) OVER (ORDER BY level) / sum(n) OVER (), 6) AS cum_pct FROM
  (SELECT p_size AS level, count(*) AS n FROM part GROUP BY 1)""")
def w1(spark, d):
    level = table(spark, d, "part").groupBy(F.col("p_size").alias("level")).agg(F.count("*").alias("n"))
    whole, upto = W.partitionBy(F.lit(1)), W.partitionBy(F.lit(1)).orderBy("level").rowsBetween(W.unboundedPreceding, 0)  # one row for each level
    return level.select("level", "n", F.round(100.0 * F.col("n") / F.sum("n").over(whole), 6).alias("pct"), F.round(100.0 * F.sum("n").over(upto) / F.sum("n").over(whole), 6).alias("cum_pct"))


@query("w2_first_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def w2(spark, d):
    # min_by combines on the map side; a window would bring every user's events to one task.
    first = table(spark, d, "events").groupBy("user_id").agg(F.min_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e"))
    return first.select("user_id", "e.event_id", "e.event_type")


@query("w3_cap_per_group", f"{EDGES} SELECT source_id, target_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY target_id) AS rn FROM edges WHERE rel_type = 'depends_on') WHERE rn <= 5")
def w3(spark, d):
    w = W.partitionBy("source_id").orderBy("target_id")
    return edges(spark, d).filter("rel_type = 'depends_on'").withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("source_id", "target_id")


@query("w5_char_budget", "SELECT conv_id, turn FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 2000")
def w5(spark, d):
    used = F.sum(F.length("text")).over(W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, 0))
    return table(spark, d, "conversations").withColumn("used", used).filter("used <= 2000").select("conv_id", "turn")


@query("w7_ordered_distinct", "SELECT user_id, string_agg(event_type, ',' ORDER BY first_at, event_type) AS kinds FROM (SELECT user_id, event_type, min(ts) AS first_at FROM events GROUP BY ALL) GROUP BY 1")
def w7(spark, d):
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_at"))
    kinds = F.array_sort(F.collect_list(F.struct("first_at", "event_type")))
    return first.groupBy("user_id").agg(F.array_join(F.transform(kinds, lambda x: x["event_type"]), ",").alias("kinds"))


@query("u3_todo_done_orphans", """SELECT 'todo' AS state, count(*) AS n FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT 'done', count(*) FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id IN (SELECT doc_id FROM labels)
  UNION ALL SELECT 'orphan', count(*) FROM (SELECT DISTINCT item_id + 990 AS doc_id FROM benchmark) WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def u3(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id").distinct(), table(spark, d, "labels").select("doc_id")
    stored = table(spark, d, "benchmark").select((F.col("item_id") + 990).alias("doc_id")).distinct()
    state = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("state"), "n")
    return state(docs.join(labels, "doc_id", "left_anti"), "todo").union(state(docs.join(labels, "doc_id", "left_semi"), "done")).union(state(stored.join(docs, "doc_id", "left_anti"), "orphan"))


@query("u4_roots_by_difference", f"{EDGES} SELECT source_id AS id FROM calls EXCEPT SELECT target_id FROM calls")
def u4(spark, d):
    call = edges(spark, d).filter("rel_type = 'calls'")
    return call.select(F.col("source_id").alias("id")).distinct().join(call.select(F.col("target_id").alias("id")), "id", "left_anti")


@query("l7_deepest", "SELECT p_partkey, CAST(floor(log2(p_partkey)) AS INT) AS level FROM part WHERE p_partkey >= 1 ORDER BY level DESC, p_partkey LIMIT 15")
def l7(spark, d):
    return _part_levels(spark, d).filter("p_partkey >= 1").select("p_partkey", "level").orderBy(F.desc("level"), "p_partkey").limit(15)
