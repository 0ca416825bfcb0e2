"""Vocabulary and predicates, lexical terms, call chains, inferred edges, hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import lexical as L
from loomgraph.functions import predicates as P
from loomgraph.functions import text as X
from loomgraph.operators import retrieval as R
from loomgraph.operators import semantic as S
from loomgraph.operators import walk
from loomgraph.operators.budget import call_chains
from loomgraph.operators.traverse import bfs, impact_closure
from loomgraph.queries._registry import query
from loomgraph.session import table
from loomgraph.sources.tables import CALLS_SQL, METHODS_SQL, NODES_SQL, calls, code_methods, nodes


_FOLDERS = ["src/main", "target/generated-sources/x", "build/generated/classes", "target", "targets", "target/apt/y", "build/apt/site", "target/generated/dependency/z", "build/tmp/generated-sources", "a/target/surefire-reports/generated"]


@query("s2_source_paths", f"""SELECT page_id, kept, generated FROM (SELECT page_id, CAST(round(length(html) + 7 * length(url)) AS BIGINT) % {len(_FOLDERS)} AS k FROM pages) JOIN
  (VALUES (0, true, false), (1, true, true), (2, false, true), (3, false, false), (4, true, false), (5, true, true), (6, false, true), (7, false, true), (8, true, true), (9, false, true)) v(k, kept, generated) USING (k)""")
def s2(spark, d):
    k = (F.length("html") + 7 * F.length("url")) % len(_FOLDERS)
    path = F.concat(F.lit("m/"), F.element_at(F.array(*map(F.lit, _FOLDERS)), (k + 1).cast("int")), F.lit("/A.java"))
    return table(spark, d, "pages").filter("html IS NOT NULL AND url IS NOT NULL").select("page_id", P.is_source_path(path).alias("kept"), P.is_generated(path).alias("generated"))


@query("f10_trivial_accessors", """SELECT p_partkey, p_partkey % 6 IN (0, 2, 5) AS trivial FROM part""")
def f10(spark, d):
    k = F.col("p_partkey") % 6
    name = F.when(k < 2, "getPrice").when(k < 4, "setPrice").otherwise("load")
    signature = F.when(k == 0, "getPrice()").when(k == 1, "getPrice(int a)").when(k == 2, "setPrice(long p)").when(k == 3, "setPrice(int a, int b)").when(k == 4, "load()")
    return table(spark, d, "part").select("p_partkey", P.is_trivial_accessor(name, signature, k == 5).alias("trivial"))


@query("f14_controller_like", f"WITH {METHODS_SQL}, e AS (SELECT 'event//' || event_id AS id, 'Api' || event_type AS class_name FROM events WHERE value > 50) SELECT id FROM methods WHERE contains(class_name, 'Controller') UNION ALL SELECT id FROM e")
def f14(spark, d):
    named = code_methods(spark, d).select("id", "class_name").union(table(spark, d, "events").select(F.concat(F.lit("event//"), "event_id"), F.when(F.col("value") > 50, F.concat(F.lit("Api"), "event_type")).otherwise(F.col("event_type"))))
    return named.filter(P.is_controller_like(F.col("class_name"))).select("id")


@query("f15_modules_of_domain", "SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND contains(lower(n_name), 'i')")
def f15(spark, d):
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.filter((F.col("r_name") == "ASIA") & F.lower("n_name").contains("i")).select("n_name")


@query("f17_by_either_spelling", "SELECT p_partkey, 'method://p' || p_partkey AS id FROM part")
def f17(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 2 == 0, "method//p").otherwise("method://p"), "p_partkey").alias("asked"))
    return part.join(walk.resolve_ids(part, nodes(spark, d).filter("entity_type = 'method'")), "asked").select("p_partkey", "id")


@query("n28_method_nodes", f"WITH {NODES_SQL} SELECT count(*) FILTER (entity_type = 'method') AS methods, count(*) FILTER (entity_type <> 'method') AS others FROM nodes")
def n28(spark, d):
    method = P.is_method_node(F.col("id"), F.col("entity_type"))
    return nodes(spark, d).agg(F.count_if(method).alias("methods"), F.count_if(~method).alias("others"))


@query("n34_methods_by_name", f"WITH {NODES_SQL} SELECT class_name, name, count(*) AS overloads, min(id) AS first_id FROM nodes WHERE entity_type = 'method' GROUP BY ALL")
def n34(spark, d):
    return nodes(spark, d).filter("entity_type = 'method'").groupBy("class_name", "name").agg(F.count("*").alias("overloads"), F.min("id").alias("first_id"))


@query("n15_ranked_modules", f"WITH {NODES_SQL} SELECT module_id, count(*) AS n FROM nodes WHERE entity_type IN ('class', 'interface', 'method') AND module_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, module_id LIMIT 10")
def n15(spark, d):
    code = nodes(spark, d).filter(F.col("entity_type").isin("class", "interface", "method") & F.col("module_id").isNotNull())
    return code.groupBy("module_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "module_id").limit(10)


@query("x3_term_lookup", """SELECT term, arg_max(id, (ordinal, pos, id)) AS term_id FROM (SELECT lower(p_type) AS term, 'term//' || p_partkey AS id, p_partkey AS ordinal, 0 AS pos FROM part
  UNION ALL SELECT lower(p_brand), 'term//' || p_partkey, p_partkey, 1 FROM part) GROUP BY 1""")
def x3(spark, d):
    return S.term_lookup(table(spark, d, "part").select(F.concat(F.lit("term//"), "p_partkey").alias("id"), F.col("p_type").alias("name"), F.array("p_brand").alias("synonyms"), F.col("p_partkey").alias("ordinal")))


@query("x2_terms_of_names", """SELECT id, array_to_string(list_transform(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: 'term//' || x), ',') AS terms FROM
  (SELECT p_partkey AS id, [split_part(p_name, ' ', 2), lower(p_type), split_part(p_name, ' ', 1)] AS l FROM part)""")
def x2(spark, d):
    """Whole words first, here the name's last one and the type; then the parts of the camel-case name."""
    part = table(spark, d, "part")
    words = part.select(F.explode(F.concat(F.split("p_name", " "), F.array(F.lower("p_type")))).alias("name")).distinct()
    lookup = S.term_lookup(words.select(F.concat(F.lit("term//"), F.lower("name")).alias("id"), "name", F.array().cast("array<string>").alias("synonyms"), F.lit(0).alias("ordinal")))
    named = part.select(F.col("p_partkey").alias("id"), F.concat(F.substring_index("p_name", " ", -1), F.lit(" get_"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.lit(" "), "p_type").alias("text"))
    return S.term_matches(named, lookup).select("id", F.array_join("term_ids", ",").alias("terms"))


@query("x8_identifier_words", "SELECT p_partkey, 'get ' || lower(p_type) || ' http method' AS words FROM part WHERE regexp_matches(p_type, '^[A-Z]{2,}$')")
def x8(spark, d):
    name = F.concat(F.lit("get"), F.initcap(F.lower("p_type")), F.lit("HTTPMethod_x"))
    return table(spark, d, "part").filter(F.col("p_type").rlike("^[A-Z]{2,}$")).select("p_partkey", L.identifier_words(name).alias("words"))


@query("x13_phrase_ends", "SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN '订单,取消' ELSE '订单' END AS pairs FROM region")
def x13(spark, d):
    phrase = F.when(F.col("r_regionkey") % 2 == 0, "订单超时取消").otherwise("订单超时流程")
    return table(spark, d, "region").select("r_regionkey", F.array_join(L.phrase_ends(phrase), ",").alias("pairs"))


@query("x15_lexical_terms", """SELECT item_id, array_to_string(list_filter(list_filter(m, lambda x, i: list_position(m, x) = i), lambda x: x <> 'get' OR contains(' ' || regexp_replace(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g') || ' ', ' get ')), ' ') AS terms FROM
  (SELECT item_id, text, list_concat(base, ['get', 'zebra'], CASE WHEN list_contains(base, '订单超时取消') THEN ['订单', '取消'] ELSE [] END) AS m FROM (SELECT item_id, text, list_filter(l, lambda x, i: list_position(l, x) = i)[1:60] AS base FROM
  (SELECT item_id, text, list_concat(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]{2,}'), lambda x: lower(x)), ['订单超时取消']) AS l FROM benchmark)))""")
def x15(spark, d):
    question = F.concat("text", F.lit(" 订单超时取消"))
    return table(spark, d, "benchmark").select("item_id", F.array_join(L.lexical_terms(question, F.array(F.lit("get"), F.lit("zebra")), ["get", "set"]), " ").alias("terms"))


@query("x20_sql_columns", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'o_' || o_orderstatus || ',total,x,y' WHEN 1 THEN 'a,b' WHEN 2 THEN 'id,' || o_orderstatus ELSE '' END AS columns FROM orders""")
def x20(spark, d):
    k = F.col("o_orderkey") % 4
    sql = F.when(k == 0, F.concat(F.lit("select distinct o_"), "o_orderstatus", F.lit(",\n `total`, x AS y from t"))).when(k == 1, "UPDATE t SET a = 1, `b`= 2 where c = 3").when(k == 2, F.concat(F.lit("insert into t (id, `"), "o_orderstatus", F.lit("`) values (1, 2)"))).otherwise("select count(*) from t")
    op = F.when(k == 1, "UPDATE").when(k == 2, "insert").otherwise("select")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(X.sql_columns(sql, op), ",").alias("columns"))


@query("x30_json_of_answers", """SELECT conv_id, turn, CASE role WHEN 'assistant' THEN '{"n": ' || length(text) || '}' WHEN 'system' THEN '[' || length(text) || ', {"a": null}]' END AS found FROM conversations""")
def x30(spark, d):
    n = F.length("text").cast("string")
    object_ = F.concat(F.lit("{\"n\": "), n, F.lit("}"))
    fenced = F.concat(F.lit("Here:\n```json\n"), object_, F.lit("\n```\n"))
    answer = F.when(F.col("role") == "assistant", fenced).when(F.col("role") == "system", F.concat(F.lit("["), n, F.lit(", {\"a\": null}]"))).otherwise(F.concat(object_, F.lit(" then "), object_))
    return table(spark, d, "conversations").select("conv_id", "turn", X.json_of(answer).alias("found"))


@query("j13_statements_of_classes", """SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey""")
def j13(spark, d):
    dao = table(spark, d, "supplier").select("s_suppkey", X.dao_key(F.concat(F.lit("com.x.Order"), "s_suppkey", F.lit("Of"), "s_nationkey", F.lit("Dao"))).alias("key"))
    mapper = table(spark, d, "customer").select("c_custkey", X.dao_key(F.concat(F.lit("org.y.Order"), "c_custkey", F.lit("Of"), "c_nationkey", F.lit("Mapper"))).alias("key"))
    return dao.join(mapper, "key").select("s_suppkey", "c_custkey")


@query("n5_code_with_sql", """SELECT p_partkey, p_name || chr(10) || coalesce(s || chr(10), '') || p_type AS context FROM part LEFT JOIN (SELECT l_partkey, string_agg(DISTINCT l_returnflag, '; ' ORDER BY l_returnflag) AS s FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def n5(spark, d):
    statements = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), "; ").alias("s"))
    return table(spark, d, "part").join(statements, "p_partkey", "left").select("p_partkey", F.concat_ws("\n", "p_name", "s", "p_type").alias("context"))


@query("g6_paths", f"""WITH RECURSIVE {CALLS_SQL}, r AS (SELECT 'method://p' || max(p_partkey) AS node_id, 0 AS hop, 'method://p' || max(p_partkey) AS path FROM part
  UNION ALL SELECT target_id, hop + 1, path || '>' || target_id FROM r JOIN calls ON source_id = node_id) SELECT node_id, hop, path FROM r""")
def g6(spark, d):
    start = table(spark, d, "part").agg(F.concat(F.lit("method://p"), F.max("p_partkey")).alias("start_id")).select("start_id", F.col("start_id").alias("node_id"))
    return walk.with_paths(bfs(calls(spark, d), start)).select("node_id", "hop", F.array_join("path", ">").alias("path"))


@query("g12_call_chain", f"""WITH RECURSIVE {CALLS_SQL}, skipped AS (SELECT 'method://p' || p_partkey AS id FROM part WHERE p_partkey % 7 = 0),
  impl AS (SELECT 'method://p' || p_partkey AS interface_id, 'method://p' || (p_partkey - 1) AS id FROM part WHERE p_partkey % 10 = 0),
  r AS (SELECT 'method://p3' AS node_id, 0 AS depth UNION SELECT coalesce(i.id, source_id), depth + 1 FROM r JOIN calls ON target_id = node_id LEFT JOIN impl i ON i.interface_id = source_id WHERE depth < 6 AND source_id NOT IN (SELECT id FROM skipped))
  SELECT node_id, min(depth) AS depth FROM r JOIN part ON node_id = 'method://p' || p_partkey GROUP BY node_id, p_brand, p_name ORDER BY 2, p_brand, p_name, 1 LIMIT 30""")
def g12(spark, d):
    part, name = table(spark, d, "part"), lambda k: F.concat(F.lit("method://p"), k)
    impl = part.filter("p_partkey % 10 = 0").select(name(F.col("p_partkey")).alias("interface_id"), name(F.col("p_partkey") - 1).alias("id"))
    skipped, start = part.filter("p_partkey % 7 = 0").select(name(F.col("p_partkey")).alias("id")), part.filter("p_partkey = 3").select(name(F.col("p_partkey")).alias("start_id"))
    return call_chains(nodes(spark, d), calls(spark, d), impl, skipped, start, "up").select("node_id", "depth")


_CLOSED = f"""WITH RECURSIVE {CALLS_SQL}, r AS (SELECT source_id, target_id FROM calls UNION SELECT r.source_id, c.target_id FROM r JOIN calls c ON c.source_id = r.target_id),
  more AS (SELECT source_id, target_id FROM r WHERE source_id <> target_id EXCEPT SELECT source_id, target_id FROM calls)"""


@query("g16_inferred_edges", f"{_CLOSED} SELECT source_id, target_id, true AS inferred FROM more UNION ALL SELECT source_id, target_id, false FROM calls")
def g16(spark, d):
    return walk.with_inferred(calls(spark, d).withColumn("rel_type", F.lit("calls")), "calls").select("source_id", "target_id", "inferred")


@query("u2_reach_by_inference", f"{_CLOSED} SELECT target_id AS id FROM more WHERE source_id = 'method://p100' EXCEPT SELECT target_id FROM calls WHERE source_id = 'method://p100'")
def u2(spark, d):
    own = calls(spark, d).withColumn("rel_type", F.lit("calls"))
    one_hop = lambda e: impact_closure(e, "method://p100", max_hops=1).select("id").filter("id <> 'method://p100'")
    return one_hop(walk.with_inferred(own, "calls")).join(own.filter("source_id = 'method://p100'").select(F.col("target_id").alias("id")), "id", "left_anti")


@query("u5_all_hits", "SELECT o_custkey AS id, o_totalprice AS score FROM orders UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def u5(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("score")).union(table(spark, d, "customer").select("c_custkey", "c_acctbal"))


@query("a9_best_per_id", "SELECT l_partkey AS id, greatest(max(l_discount), 0.0) AS score FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def a9(spark, d):
    return R.merge_best(table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"), F.col("l_discount").alias("score")))


@query("a17_mean_hit_rate", "SELECT lang, round(avg((contains(lower(text), 'the')::INT + contains(lower(text), 'que')::INT) / 2.0), 6) AS rate FROM documents GROUP BY 1")
def a17(spark, d):
    has = lambda w: F.lower("text").contains(w).cast("int")
    return table(spark, d, "documents").groupBy("lang").agg(F.round(F.avg((has("the") + has("que")) / 2.0), 6).alias("rate"))


@query("l8_by_confidence", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events WHERE value IS NOT NULL) WHERE rn <= 2")
def l8(spark, d):
    from pyspark.sql import Window as W

    rn = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return table(spark, d, "events").filter("value IS NOT NULL").withColumn("rn", rn).filter("rn <= 2").select("user_id", "event_id", "value")


@query("v13_hybrid_search", """WITH hits AS (SELECT doc_id AS id, (n_chars % 100) / 100.0 AS score FROM documents UNION ALL SELECT doc_id, quality * 0.5 FROM labels), m AS (SELECT id, greatest(max(score), 0.0) AS score FROM hits GROUP BY 1 ORDER BY score DESC, id LIMIT 90)
  SELECT id, round(m.score + 0.42 * contains(' ' || regexp_replace(lower(regexp_replace(coalesce(text, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g') || ' ', ' the ')::INT + 0.28 * contains(' ' || regexp_replace(lower(coalesce(source, '')), '[^a-z0-9]+', ' ', 'g') || ' ', ' the ')::INT, 6) AS score
  FROM m LEFT JOIN documents ON doc_id = id ORDER BY 2 DESC, 1 LIMIT 10""")
def v13(spark, d):
    docs = table(spark, d, "documents")
    first = docs.select(F.col("doc_id").alias("id"), ((F.col("n_chars") % 100) / 100.0).alias("score"))
    second = table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") * 0.5).alias("score"))
    return R.hybrid_search([first, second], docs.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("ident")), ["the"], 10)


@query("v3_search_by_text", """WITH h AS (SELECT item_id AS id, sha256(text) AS h FROM benchmark UNION ALL SELECT -1, sha256('cancel the order')), x AS (SELECT id, unnest(range(64)) AS i, h FROM h),
  y AS (SELECT id, i, CASE WHEN (2 * i + 4) % 64 + 4 > (2 * i) % 64 THEN substr(h, (2 * i) % 64 + 1, (2 * i + 4) % 64 + 4 - (2 * i) % 64) ELSE '0' END AS s FROM x),
  z AS (SELECT id, i, (('0x' || s)::BIGINT % 10000) / 5000.0 - 1 AS v FROM y), n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM z GROUP BY 1)
  SELECT a.id, round(sum(a.v * q.v) / (any_value(n.norm) * any_value(m.norm)), 4) AS score FROM z a JOIN z q ON q.id = -1 AND q.i = a.i JOIN n ON n.id = a.id JOIN n m ON m.id = -1 WHERE a.id >= 0 GROUP BY a.id ORDER BY score DESC, a.id LIMIT 10""")
def v3(spark, d):
    return R.search_text(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), "cancel the order", 10)
