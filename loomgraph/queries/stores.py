"""Keyed merges, snapshots, annotated statements, texts written bottom-up, searches of many questions, domains and policies."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph.operators import domains as D
from loomgraph.operators.batch_search import business_hits, search_many
from loomgraph.operators.policy import WalkPolicy, allowed_edges, policy_neighbours
from loomgraph.operators.propagate import write_bottom_up
from loomgraph.operators.traverse import bfs, levels
from loomgraph.queries._registry import query
from loomgraph.session import table, tasks_of
from loomgraph.sources.dynamic_sql import annotated_statements
from loomgraph.sources.merge import merge_batch, read_merged
from loomgraph.sources.node_link import read_elements, write_node_link
from loomgraph.sources.tables import CALLS_SQL, EDGES_SQL, METHODS_SQL, NODES_SQL, calls, code_methods, edge_sources, edges, nodes
from loomgraph.store import shared_dir


@query("k5_merged_events", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def k5(spark, d):
    root, events = f"{shared_dir(spark)}/merged-{uuid.uuid4().hex}", table(spark, d, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("arrival"))
    high = F.coalesce(F.col("event_type") > "e", F.lit(True))
    for number, part in enumerate((events.filter(high), events.filter(~high), events.filter(high))):  # the last brings nothing new
        merge_batch(spark, root, part, ["user_id"], number, "arrival", buckets=16)
    return read_merged(spark, root, events.schema).select("user_id", "event_id", "event_type")


@query("s14_node_link", f"WITH {NODES_SQL}, {EDGES_SQL} SELECT 'node' AS kind, id, coalesce(name, '') AS label FROM nodes UNION ALL SELECT 'link', source_id || '>' || target_id, rel_type FROM edges")
def s14(spark, d):
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    write_node_link(nodes(spark, d), edges(spark, d), path, parts=4, compression="gzip")
    e, is_link = read_elements(spark, path, "id string, name string, source string, target string, rel_type string"), F.col("is_link")
    either = lambda link, node: F.when(is_link, link).otherwise(node)
    return e.select(either(F.lit("link"), F.lit("node")).alias("kind"), either(F.concat_ws(">", "source", "target"), F.col("id")).alias("id"), either(F.col("rel_type"), F.coalesce("name", F.lit(""))).alias("label"))


@query("x22_annotated_sql", """SELECT 'com.' || replace(p_brand, '#', '') AS namespace, 'q' || p_partkey AS statement_id, 'select' AS op,
  concat_ws(chr(10), 'SELECT', '-- [引用 SQL 片段] c' || p_partkey, '  ' || p_name, '  -- [引用 SQL 片段] base.all', '    ' || 'id', 'FROM t', 'WHERE', '  -- [条件] 当 size == ' || p_size || ' 时:', '    type = ' || p_type) AS sql FROM part""")
def x22(spark, d):
    """A mapper for each part; its fragment includes one of another file."""
    k = F.col("p_partkey").cast("string")
    xml = F.concat(
        F.lit('<mapper namespace="com.'), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit('"><sql id="c'), k, F.lit('">'), F.col("p_name"), F.lit('<include refid="base.all"/></sql><select id="q'), k, F.lit('">SELECT <include refid="c'), k,
        F.lit('"/> FROM t <where><if test="size == '), F.col("p_size").cast("string"), F.lit('">type = '), F.col("p_type"), F.lit("</if></where></select></mapper>"),
    )
    shared = table(spark, d, "region").select(F.lit('<mapper namespace="base"><sql id="all">id</sql></mapper>').alias("text")).distinct()
    return annotated_statements(table(spark, d, "part").select(xml.alias("text")).union(shared)).drop("missing")


@query("b5_bottom_up_texts", f"""WITH RECURSIVE {METHODS_SQL}, r AS (SELECT p_partkey AS k, id, name, words || '<>' AS text, 0 AS level FROM methods WHERE p_partkey < 2
  UNION ALL SELECT m.p_partkey, m.id, m.name, m.words || '<' || substr('- ' || r.name || ': ' || r.text, 1, 40) || '>', level + 1 FROM r JOIN methods m ON m.p_partkey >= 2 AND m.p_partkey // 2 = r.k) SELECT id, name, text, level FROM r""")
def b5(spark, d):
    methods = code_methods(spark, d).select("id", "name", F.col("words").alias("code"))
    text = lambda code, callees: F.concat(code, F.lit("<"), F.substring(callees, 1, 40), F.lit(">"))
    return write_bottom_up(methods, calls(spark, d), text, f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}")


_SCORE = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 4)"
_TEXTS = "texts AS (SELECT 'method://m' || vec_id // 3 AS id, CASE WHEN label % 2 = 0 THEN 'api' ELSE 'class' END AS level, embedding, vec_id FROM embeddings)"


@query("v10_business_hits", f"""WITH {_TEXTS}, s AS (SELECT b.vec_id::VARCHAR AS item, a.id, max({_SCORE}) AS score FROM texts a JOIN embeddings b ON b.vec_id % 20 = 0 WHERE level = 'api' GROUP BY ALL)
  SELECT item, id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, id) AS rn FROM s) WHERE rn <= 5""")
def v10(spark, d):
    e = table(spark, d, "embeddings")
    spelled = F.concat(F.when(F.col("vec_id") % 2 == 0, "method//m").otherwise("method://m"), F.expr("vec_id DIV 3"))  # both spellings of a method
    texts = e.select(spelled.alias("id"), F.when(F.col("label") % 2 == 0, "API").otherwise("class").alias("level"), F.col("embedding").alias("vector"))
    return business_hits(texts, e.filter("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("item"), F.col("embedding").alias("vector")), 5)


@query("a16_requirement_entries", f"""WITH s AS (SELECT b.vec_id AS item, a.vec_id AS k, {_SCORE} AS score FROM embeddings a JOIN embeddings b ON b.vec_id % 20 = 0),
  h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, 'method://p' || k) AS rn FROM s) WHERE rn <= 5),
  f AS (SELECT k, count(DISTINCT item) AS coverage, round(sum(score), 4) AS total, CASE WHEN k < 2 OR k > (SELECT max(p_partkey) FROM part) THEN 0 ELSE floor(log2(k))::INT END AS level FROM h GROUP BY k)
  SELECT 'method://p' || k AS id, level, coverage, total, round(10 * level + 5 * coverage + 2 * total, 4) AS score FROM f ORDER BY score DESC, id LIMIT 10""")
def a16(spark, d):
    e, method = table(spark, d, "embeddings"), lambda c: F.concat(F.lit("method://p"), c)
    hits = search_many(e.select(method("vec_id").alias("id"), F.col("embedding").alias("vector")), e.filter("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("item"), F.col("embedding").alias("vector")), 5)
    placed = levels(calls(spark, d), table(spark, d, "part").select(method("p_partkey").alias("id")))
    return D.requirement_entries(hits, placed)


@query("n29_policy_neighbours", f"""WITH {EDGES_SQL}, own AS (SELECT source_id AS id, target_id AS peer, 0 AS g FROM edges WHERE rel_type <> 'uses' AND NOT starts_with(target_id, 'service://') UNION ALL SELECT source_id, target_id, 1 FROM calls),
  f AS (SELECT id, peer, min(g) AS g FROM own GROUP BY ALL) SELECT id, row_number() OVER (PARTITION BY id ORDER BY g, peer) AS place, peer FROM f""")
def n29(spark, d):
    every = edges(spark, d, repeats=True)
    first = every.filter("rel_type <> 'calls' OR source_id > 'method://p5'").unionByName(every.filter("rel_type = 'calls' AND source_id <= 'method://p5'"))
    policy = WalkPolicy(excluded_relations=("USES",), excluded_prefixes=("service://",))
    return policy_neighbours([first, calls(spark, d).withColumn("rel_type", F.lit("CALLS"))], edge_sources(spark, d), policy, tasks=tasks_of(table(spark, d, "lineitem")))


@query("g5_policy_walk", f"""WITH RECURSIVE {EDGES_SQL}, ok AS (SELECT source_id, target_id FROM edges WHERE rel_type <> 'depends_on' AND NOT starts_with(target_id, 'service://') AND NOT starts_with(target_id, 'package//')),
  r AS (SELECT 'order//' || o_orderkey AS start_id, 'order//' || o_orderkey AS node_id, 0 AS hop FROM orders WHERE o_totalprice > 400000 UNION SELECT start_id, target_id, hop + 1 FROM r JOIN ok ON source_id = node_id WHERE hop < 3)
  SELECT start_id, node_id, min(hop) AS hop FROM r GROUP BY ALL""")
def g5(spark, d):
    walk = allowed_edges(edges(spark, d), WalkPolicy(excluded_relations=("depends_on",), excluded_prefixes=("service://", "package//")))
    starts = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.concat(F.lit("order//"), "o_orderkey").alias("start_id"))
    return bfs(walk, starts.select("start_id", F.col("start_id").alias("node_id")), 3).select("start_id", "node_id", "hop")


@query("g23_rings_with_fallback", f"""WITH {NODES_SQL}, code AS (SELECT * FROM nodes WHERE entity_type IN ('class', 'method')),
  inside AS (SELECT 'domain://' || module_id AS domain, id, name, entity_type, false AS derived FROM code WHERE id LIKE 'class//s%' AND module_id <> 'ASIA'),
  every AS (SELECT * FROM inside UNION ALL SELECT 'domain://' || module_id, id, name, entity_type, true FROM code WHERE module_id IN (SELECT r_name FROM region) AND 'domain://' || module_id NOT IN (SELECT domain FROM inside)),
  caps AS (SELECT DISTINCT 'domain://' || r_name AS domain, 'package//' || n_nationkey AS id, n_name AS name FROM place)
  SELECT domain, 1 AS ring, 'package' AS entity_type, id, name, false AS derived FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY id) AS rn FROM caps) WHERE rn <= 3
  UNION ALL SELECT domain, 2, entity_type, id, name, derived FROM (SELECT *, row_number() OVER (PARTITION BY domain, entity_type ORDER BY id) AS rn FROM every) WHERE rn <= 30""")
def g23(spark, d):
    """Suppliers lie in their region's domain but for one; there the region's service leads to the code."""
    domain = lambda c: F.concat(F.lit("domain://"), c)
    rows = lambda df, source, target, kind: df.select(source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("rel_type"))
    n = nodes(spark, d)
    place = n.filter("entity_type = 'package'")
    inside = rows(n.filter("id LIKE 'class//s%' AND module_id <> 'ASIA'"), F.col("id"), domain("module_id"), "IN_DOMAIN")
    every = inside.unionByName(rows(place, domain("module_id"), F.col("id"), "CONTAINS_CAPABILITY")).unionByName(rows(table(spark, d, "region"), F.concat(F.lit("service://"), "r_name"), domain("r_name"), "BELONGS_TO_DOMAIN"))
    return D.domain_rings(n, every, table(spark, d, "region").select(domain("r_name").alias("id")), 3, 30)


@query("x34_class_contexts", f"""WITH {METHODS_SQL}, c AS (SELECT class_name, min(module_id) AS module_id FROM methods GROUP BY 1), m AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY id) AS rn FROM methods),
  t AS (SELECT class_name, string_agg('- ' || signature || '  路由: /' || words, chr(10) ORDER BY id) AS lines FROM m WHERE rn <= 40 GROUP BY 1),
  w AS (SELECT *, CASE WHEN regexp_matches(class_name, 'Controller$') THEN 'Controller' WHEN regexp_matches(class_name, '(Service|Facade)$') THEN 'Service' WHEN regexp_matches(class_name, 'Mapper$') THEN 'Repository' ELSE 'Other' END AS role,
    coalesce((SELECT string_agg(r_name, ', ' ORDER BY r_name) FROM region WHERE c.module_id = 'Brand#' || r_regionkey), '') AS domains FROM c JOIN t USING (class_name))
  SELECT class_name AS id, domains, '' AS capabilities, role, concat_ws(chr(10), '类名: ' || class_name, '角色: ' || role, '模块: ' || module_id, '推测包名/路径: ', '关联业务域: ' || CASE domains WHEN '' THEN '未知' ELSE domains END, '', '主要方法（含路由信息，节选）:', lines) AS context FROM w""")
def x34(spark, d):
    methods = code_methods(spark, d)
    classes = methods.groupBy(F.col("class_name").alias("id")).agg(F.min("module_id").alias("module_id")).select("id", F.col("id").alias("name"), "module_id", F.lit(None).cast("string").alias("package"))
    regions = table(spark, d, "region").select(F.concat(F.lit("Brand#"), "r_regionkey").alias("module_id"), F.col("r_name").alias("domain"))
    return D.class_contexts(classes, methods.withColumn("path", F.concat(F.lit("/"), "words")), regions)


@query("o1_newest_first", "SELECT o_custkey AS project, max(o_orderdate) AS updated, count(*) AS sessions FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def o1(spark, d):
    """Projects by their last session, the newest first: a listing of fifty."""
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("project")).agg(F.max("o_orderdate").alias("updated"), F.count("*").alias("sessions")).orderBy(F.desc("updated"), "project").limit(50)
