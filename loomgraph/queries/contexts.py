"""Contexts, cards, reports and lookups; functions on source text."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import code as C
from loomgraph.functions import lexical as L
from loomgraph.operators import context as X
from loomgraph.operators import lookup as K
from loomgraph.queries._registry import query
from loomgraph.session import table
from loomgraph.sources.tables import CALLS_SQL, EDGES_SQL, NODES_SQL, calls, edges, nodes


def _method(k):
    return F.concat(F.lit("method://p"), k)


@query("f11_accessor_kinds", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'getter' WHEN 1 THEN 'setter' ELSE 'none' END AS kind FROM part")
def f11(spark, d):
    k = F.col("p_partkey") % 5
    name = F.when(k.isin(0, 2), "getPrice").when(k.isin(1, 4), "setPrice").otherwise("isOpen")
    body = F.when(k == 0, F.concat(F.lit("return "), "p_brand")).when(k == 1, "this.price = p;\n return this").when(k == 2, "log();\n return price").when(k == 3, "return open").otherwise("if (a != b) x = 1")
    code = F.concat(F.lit("public Object "), name, F.lit("() {\n "), body, F.lit(";\n}"))
    return table(spark, d, "part").select("p_partkey", C.accessor_kind(name, code, F.array(F.lit("price"))).alias("kind"))


@query("x23_mapper_and_method", """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'order' || s_suppkey || 'mapper' WHEN 1 THEN 'itemmapper' ELSE '' END AS mapper,
  CASE s_suppkey % 3 WHEN 0 THEN 'find' || s_suppkey WHEN 1 THEN 'load' ELSE '' END AS method FROM supplier""")
def x23(spark, d):
    k = F.col("s_suppkey") % 3
    place = F.when(k == 0, F.concat(F.lit("src\\x\\Order"), "s_suppkey", F.lit("Mapper.java:12"))).when(k == 1, "ItemMapper.java").otherwise("src/Order.java:3")
    name = F.when(k == 0, F.concat(F.lit(" Find"), "s_suppkey")).when(k == 1, " ")
    signature = F.when(k == 1, "@Nullable com.x.Item com.x.Items.Load (long id)").otherwise("no parenthesis")
    return table(spark, d, "supplier").select("s_suppkey", C.mapper_class(place).alias("mapper"), C.method_name(name, signature).alias("method"))


@query("x27_bean_contexts", """SELECT p_partkey AS id, 'OmsOrder.price: ' || a.n_name || chr(10) || 'Item.PWD: ' || b.n_name AS context FROM part, nation a, nation b WHERE a.n_nationkey = 0 AND b.n_nationkey = 1""")
def x27(spark, d):
    code = F.concat(F.lit("Base order = new OmsOrder();\nItem<T> item = find(1); order.setPrice("), "p_partkey", F.lit("); item.getPWD(); order.getPrice(); ghost.getPrice(); item.setOther(2);"))
    named = table(spark, d, "nation").filter("n_nationkey < 2")
    comments = named.select(F.when(F.col("n_nationkey") == 0, "OmsOrder").otherwise("Item").alias("class_name"), F.when(F.col("n_nationkey") == 0, "price").otherwise("PWD").alias("field"), F.col("n_name").alias("comment"))
    return X.bean_contexts(table(spark, d, "part").select(F.col("p_partkey").alias("id"), code.alias("code")), comments)


@query("s16_create_tables", """SELECT n_nationkey, 't' || n_nationkey AS name, length('CREATE TABLE `t' || n_nationkey || '` ( id int, n varchar(10) ) ENGINE') AS size FROM nation
  UNION ALL SELECT n_nationkey, 'u', length('CREATE TABLE `u`(a int) ENGINE') FROM nation""")
def s16(spark, d):
    text = F.concat(F.lit("CREATE TABLE `t"), "n_nationkey", F.lit("` (\nid int,\nn varchar(10)\n) ENGINE=x;\nCREATE TABLE b (id int);\nCREATE TABLE `u`(a int) ENGINE=y;"))
    found = table(spark, d, "nation").select("n_nationkey", F.inline(C.create_tables(text)))
    return found.select("n_nationkey", "name", F.length("ddl").alias("size"))


@query("x5_embed_texts", f"WITH {NODES_SQL} SELECT id, concat_ws(' ', class_name, name, entity_type, nullif(signature, '')) AS text FROM nodes")
def x5(spark, d):
    return nodes(spark, d).select("id", C.embed_text(F.col("name"), F.col("entity_type"), F.col("class_name"), F.col("signature")).alias("text"))


@query("v11_vector_texts", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand || ' ' || p_name || ' method' END AS text FROM part")
def v11(spark, d):
    snippet = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("")
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.nullif(snippet, F.lit("")), C.embed_text(F.col("p_name"), F.lit("method"), F.col("p_brand"))).alias("text"))


@query("x16_text_blobs", """SELECT p_partkey AS id, 'getItem' || chr(10) || p_brand || chr(10) || 'get item' || chr(10) || lower(p_brand) || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || p_type ELSE '' END
  || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || p_name ELSE '' END AS blob FROM part""")
def x16(spark, d):
    part = table(spark, d, "part").withColumn("id", F.col("p_partkey"))
    told, summary = part.filter("p_partkey % 2 = 0").select("id", F.col("p_type").alias("text")), part.filter("p_partkey % 3 = 0").select("id", F.col("p_name").alias("text"))
    return X.text_blobs(part.select("id", F.lit("getItem").alias("name"), F.col("p_brand").alias("signature")), told, summary)


@query("x33_cited", """SELECT l_orderkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS ids FROM
  (SELECT l_orderkey, list('p' || l_partkey ORDER BY l_linenumber, l_partkey) AS l FROM lineitem GROUP BY 1)""")
def x33(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    references = F.transform("x", lambda x: F.struct(F.concat(F.lit("p"), x["l_partkey"]).alias("entity_id")))
    return lines.select("l_orderkey", F.array_join(X.cited(F.array(F.struct(references.alias("references")))), ",").alias("ids"))


@query("x35_domain_backgrounds", """SELECT r_name, '业务域：' || chr(10) || string_agg('- ' || n_name || ': c' || n_nationkey || ', d', chr(10) ORDER BY n_nationkey) || chr(10) || chr(10) || '业务能力：' || chr(10) || '- ' || r_name || ': /x/**' AS background
  FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""")
def x35(spark, d):
    own = F.struct("n_nationkey", F.col("n_name").alias("id"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("c"), "n_nationkey"), F.lit("d")).alias("capability_ids"))
    held = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.sort_array(F.collect_list(own)).alias("domains"))
    able = F.array(F.struct(F.col("r_name").alias("id"), F.lit("").alias("name"), F.lit("/x/**").alias("path_pattern")))
    return held.select("r_name", X.domain_background(F.col("domains"), able).alias("background"))


_SHOWN = "SELECT 'method://p' || p_partkey AS id, p_brand || '.' || p_name AS shown FROM part"


@query("x36_method_contexts", f"""WITH {NODES_SQL}, {CALLS_SQL}, s AS ({_SHOWN}), up AS (SELECT target_id AS id, string_agg(DISTINCT shown, ', ' ORDER BY shown) AS x FROM calls JOIN s ON s.id = source_id GROUP BY 1),
  down AS (SELECT source_id AS id, string_agg(DISTINCT coalesce(shown, left(target_id, 20)), ', ' ORDER BY coalesce(shown, left(target_id, 20))) AS x FROM calls LEFT JOIN s ON s.id = target_id GROUP BY 1)
  SELECT n.id, coalesce(class_name, '') AS class_name, coalesce(signature, name) AS signature, coalesce(module_id, '') AS module_id, coalesce(up.x, '-') AS callers, coalesce(down.x, '-') AS callees
  FROM nodes n LEFT JOIN up ON up.id = n.id LEFT JOIN down ON down.id = n.id WHERE entity_type = 'method'""")
def x36(spark, d):
    return X.method_contexts(nodes(spark, d), calls(spark, d).withColumn("rel_type", F.lit("calls")))


@query("x36_related_ids", f"""WITH {CALLS_SQL}, p AS (SELECT source_id AS id, target_id AS peer FROM calls UNION SELECT target_id, source_id FROM calls)
  SELECT 'method://p' || p_partkey AS id, array_to_string(list_concat(['method://p' || p_partkey], coalesce(l, [])), ',') AS related FROM part LEFT JOIN (SELECT id, list(peer ORDER BY peer) AS l FROM p GROUP BY 1) ON id = 'method://p' || p_partkey""")
def x36_related(spark, d):
    methods = table(spark, d, "part").select(_method(F.col("p_partkey")).alias("id"))
    return X.related_ids(methods, calls(spark, d).withColumn("rel_type", F.lit("calls"))).select("id", F.array_join("related", ",").alias("related"))


@query("n14_excerpts", """SELECT class_name, id, CASE WHEN length(p_name) > 9 THEN left(p_name, 9) || '…' ELSE p_name END AS excerpt FROM
  (SELECT p_brand AS class_name, p_partkey AS id, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_partkey % 7 = 0)) WHERE rn <= 3""")
def n14(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("class_name"), F.col("p_partkey").alias("id"), F.col("p_name").alias("code"))
    return X.excerpts(part, part.filter("id % 7 = 0"), 3, 9)


@query("n18_cards", f"""WITH {NODES_SQL} SELECT id, entity_type, coalesce(nullif(trim(name), ''), id) AS name, coalesce(CASE WHEN entity_type = 'method' AND p_partkey % 2 = 0 THEN 'listed ' || p_partkey END, nullif(trim(signature), ''), '') AS signature,
  coalesce(nullif(trim(class_name), ''), '') AS class_name, module_id FROM nodes LEFT JOIN part ON id = 'method://p' || p_partkey""")
def n18(spark, d):
    listing = table(spark, d, "part").filter("p_partkey % 2 = 0").select(_method(F.col("p_partkey")).alias("id"), F.lit("t").alias("title"), F.concat(F.lit("listed "), "p_partkey").alias("signature"), F.lit(" ").alias("class_name"))
    found = nodes(spark, d)
    return X.cards(found.select("id"), found, listing)


@query("a22_service_docs", f"""WITH {NODES_SQL}, {EDGES_SQL}, m AS (SELECT id, module_id FROM nodes WHERE module_id IS NOT NULL)
  SELECT id AS service_id, name, coalesce(n, 0) AS n_nodes, coalesce(e, 0) AS n_edges FROM nodes LEFT JOIN (SELECT module_id AS name, count(*) AS n FROM m GROUP BY 1) USING (name)
  LEFT JOIN (SELECT a.module_id AS name, count(*) AS e FROM edges JOIN m a ON a.id = source_id JOIN m b ON b.id = target_id WHERE a.module_id = b.module_id GROUP BY 1) USING (name) WHERE entity_type = 'service'""")
def a22(spark, d):
    return X.service_docs(nodes(spark, d), edges(spark, d))


@query("a22_domain_docs", """SELECT 'domain://' || n_nationkey AS domain_id, (SELECT count(DISTINCT c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey) AS n_capabilities,
  (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_entities, 1 AS n_services FROM nation""")
def a22_domains(spark, d):
    domain = lambda c: F.concat(F.lit("domain://"), c)
    row = lambda df, source, target, rel: df.select(source.alias("source_id"), target.alias("target_id"), F.lit(rel).alias("rel_type"))
    customers = table(spark, d, "customer")
    links = row(customers.select("c_nationkey", "c_mktsegment").distinct(), domain("c_nationkey"), F.col("c_mktsegment"), "CONTAINS_CAPABILITY")
    links = links.union(row(customers, F.concat(F.lit("class//c"), "c_custkey"), domain("c_nationkey"), "IN_DOMAIN"))
    return X.domain_docs(links.union(row(table(spark, d, "nation"), F.concat(F.lit("service://"), "n_regionkey"), domain("n_nationkey"), "BELONGS_TO_DOMAIN")))


@query("n24_names", f"""WITH {CALLS_SQL} SELECT DISTINCT target_id AS id, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN p_partkey % 3 = 0 THEN p_type END, target_id) AS name
  FROM calls LEFT JOIN part ON target_id = 'method://p' || p_partkey""")
def n24(spark, d):
    part = table(spark, d, "part").withColumn("id", _method(F.col("p_partkey")))
    own = part.select("id", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(" ").alias("name"))
    return K.names_with_fallback(calls(spark, d).select(F.col("target_id").alias("id")), own, part.filter("p_partkey % 3 = 0").select("id", F.col("p_type").alias("name")))


@query("n25_texts_or_placeholder", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '(none)' END AS text FROM part")
def n25(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return K.texts_or(part, part.filter("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, F.col("p_name")).otherwise("").alias("text")), "(none)")


@query("n23_resolved_method", f"WITH {NODES_SQL} SELECT id FROM nodes WHERE entity_type = 'method' AND (contains(lower(name), 'p1') OR contains(lower(id), 'p1')) ORDER BY coalesce(name, id), id LIMIT 1")
def n23(spark, d):
    return K.resolve_method(nodes(spark, d), " P1 ")


@query("j18_among_hits", """SELECT id FROM (SELECT c_custkey AS id, max(o_totalprice) AS score FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 3 = 0 GROUP BY 1) ORDER BY score DESC, id LIMIT 20""")
def j18(spark, d):
    wanted = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"))
    return K.among_hits(wanted, table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("score")), 20)


@query("g25_term_landing", """SELECT 'class//c' || c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' ORDER BY c_acctbal DESC, id LIMIT 20""")
def g25(spark, d):
    named = table(spark, d, "customer").withColumn("id", F.concat(F.lit("class//c"), "c_custkey"))
    of_region = nodes(spark, d).filter("entity_type = 'class' AND id LIKE 'class//c%'")
    related = of_region.select(F.concat(F.lit("term//"), "module_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("RELATED_TO").alias("rel_type"))
    return K.term_landing(nodes(spark, d), related, "term//ASIA", named.select("id", F.col("c_acctbal").alias("score")))


@query("g8_bounded_neighbours", """WITH p AS (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') SELECT * FROM (SELECT 'service://ASIA' AS node_id, 0 AS hop
  UNION ALL SELECT 'package//' || n_nationkey, 1 FROM p UNION ALL SELECT 'class//c' || c_custkey, 2 FROM customer JOIN p ON c_nationkey = n_nationkey UNION ALL SELECT 'class//s' || s_suppkey, 2 FROM supplier JOIN p ON s_nationkey = n_nationkey)
  ORDER BY hop, node_id LIMIT 80""")
def g8(spark, d):
    return K.bounded_neighbours(edges(spark, d), "service://ASIA", ["BELONGS_TO"], "both", 2, 80)


_IMPL_SQL = """m AS (SELECT s_suppkey, s_nationkey, s_suppkey % 2 = 0 AS coded FROM supplier WHERE s_suppkey % 3 < 2), b AS (SELECT s_nationkey, count(*) AS n, min(CASE WHEN coded THEN 'm' || lpad(s_suppkey::VARCHAR, 9, '0') END) AS first FROM m GROUP BY 1)"""


@query("n10_implementations", f"""WITH {_IMPL_SQL} SELECT 'Order' || s_nationkey AS interface, 'save' || s_nationkey AS name, 'm' || lpad(s_suppkey::VARCHAR, 9, '0') AS id FROM m JOIN b USING (s_nationkey)
  WHERE n = 1 OR first IS NULL OR first = 'm' || lpad(s_suppkey::VARCHAR, 9, '0')""")
def n10(spark, d):
    k, owner = F.col("s_suppkey") % 3, F.concat(F.lit("Order"), "s_nationkey")
    kind = F.when(k == 0, F.concat(owner, F.lit("Impl"))).when(k == 1, F.concat(F.lit("Fast"), owner, F.lit("CachedImpl"))).otherwise(owner)
    code = F.when(F.col("s_suppkey") % 2 == 0, "return 1;")
    methods = table(spark, d, "supplier").select(F.concat(F.lit("m"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("id"), kind.alias("class_name"), F.concat(F.lit("save"), "s_nationkey").alias("name"), code.alias("code"))
    return K.implementations(table(spark, d, "nation").select(F.concat(F.lit("Order"), "n_nationkey").alias("interface"), F.concat(F.lit("save"), "n_nationkey").alias("name")), methods)


@query("n4_call_index", f"WITH {CALLS_SQL}, known AS (SELECT 'method://p' || p_partkey AS id FROM part WHERE p_partkey % 5 <> 0) SELECT source_id, target_id FROM calls WHERE source_id IN (FROM known) AND target_id IN (FROM known)")
def n4(spark, d):
    called = calls(spark, d).withColumn("rel_type", F.lit("CALLS"))
    loops = called.select("source_id", F.col("source_id").alias("target_id"), "rel_type")
    return K.call_index(called.union(loops).union(called), table(spark, d, "part").filter("p_partkey % 5 <> 0").select(_method(F.col("p_partkey")).alias("id")))


@query("n27_lineage_diagnostics", f"""WITH RECURSIVE {CALLS_SQL}, r AS (SELECT 'method://p' || p_partkey AS start_id, 'method://p' || p_partkey AS node_id, p_partkey AS k, 0 AS hop FROM part
  UNION ALL SELECT start_id, target_id, k // 2, hop + 1 FROM r JOIN calls ON source_id = node_id WHERE hop < 3)
  SELECT start_id, count(*) - 1 AS reachable, count(*) FILTER (hop = 1) AS direct, count(*) FILTER (k % 5 = 0) AS mapped_hits FROM r GROUP BY 1""")
def n27(spark, d):
    ids = table(spark, d, "part").select("p_partkey", _method(F.col("p_partkey")).alias("id"))
    return K.lineage_diagnostics(calls(spark, d), ids.filter("p_partkey % 5 = 0"), ids.select(F.col("id").alias("start_id"), F.col("id").alias("node_id")), 3)


@query("x11_vocabulary", "SELECT DISTINCT p_type AS term FROM part WHERE length(p_type) >= 2 UNION SELECT lower(left(p_name, 1)) FROM part WHERE regexp_matches(left(p_name, 1), '[A-Za-z0-9]') UNION SELECT p_brand FROM part")
def x11(spark, d):
    part = table(spark, d, "part")
    names = part.select(F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("term")).union(part.select(F.lower(F.substring("p_name", 1, 1))))
    return K.vocabulary(names, part.select(F.lower(F.substring("p_name", 1, 1)).alias("term")).union(part.select("p_brand")).union(part.select(F.lit("#"))))


@query("f18_by_level", "SELECT doc_id, lang FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 100")
def f18(spark, d):
    return K.listed(table(spark, d, "documents").select("doc_id", "lang"), F.col("lang") == "en", "doc_id", 100)


@query("n21_owners", """SELECT o_orderkey, 'R' || o_orderkey AS module, CASE o_orderkey % 3 WHEN 0 THEN 'method://a' || o_orderkey WHEN 1 THEN 'method://p' || o_orderkey END AS method FROM orders""")
def n21(spark, d):
    k = F.col("o_orderkey") % 3
    attribute = F.when(k == 0, F.concat(F.lit("method://a"), "o_orderkey")).when(k == 1, " ")
    endpoint = F.concat(_method(F.col("o_orderkey")), F.when(k < 2, "#api").otherwise("#"))
    return table(spark, d, "orders").select("o_orderkey", C.service_module(F.concat(F.when(k == 0, " service://").otherwise(""), F.lit("R"), "o_orderkey")).alias("module"), C.endpoint_method(endpoint, attribute).alias("method"))


@query("x12_expanded_terms", """SELECT p_partkey, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), '|') AS terms FROM (SELECT p_partkey, list_concat(base, held, flatten(list_transform(base, lambda t:
  list_filter(['BRA', 'BRASS', 'NICKEL ORE', 'STEEL'], lambda p: contains(t, p) OR contains(p, t)) )), CASE WHEN len(list_filter(base, lambda t: contains('NICKEL', t) OR contains(t, 'NICKEL'))) > 0 THEN ['ni', '镍'] ELSE [] END) AS m FROM
  (SELECT p_partkey, string_split(p_type, ' ') AS base, list_filter(['BRA', 'BRASS', 'NICKEL ORE', 'STEEL'], lambda p: contains(p_type, p)) AS held FROM part))""")
def x12(spark, d):
    terms = L.expand_terms(F.col("p_type"), F.split("p_type", " "), ["STEEL", " BRASS", "BRA", "NICKEL ORE", "x"], [("NICKEL", ["Ni", "镍", "n"])])
    return table(spark, d, "part").select("p_partkey", F.array_join(terms, "|").alias("terms"))


@query("a4_counts_of_types", f"WITH {NODES_SQL} SELECT entity_type, count(*) AS n FROM nodes WHERE entity_type IN ('class', 'method', 'interface') GROUP BY 1")
def a4(spark, d):
    return X.counts_of_types(nodes(spark, d), ["class", "method", "interface"])


@query("n13_system_evidence", f"""WITH {NODES_SQL}, {EDGES_SQL}, m AS (SELECT id, module_id FROM nodes WHERE module_id <> '') SELECT 'modules' AS section, module_id AS line FROM (SELECT DISTINCT module_id FROM m ORDER BY 1 LIMIT 12)
  UNION ALL SELECT 'counts', entity_type || '=' || count(*) FROM nodes WHERE entity_type IN ('class', 'method') GROUP BY entity_type
  UNION ALL SELECT 'dependencies', a || ' -> ' || b || ' ' || rel_type || ' x' || n FROM (SELECT s.module_id AS a, t.module_id AS b, rel_type, count(*) AS n FROM edges JOIN m s ON s.id = source_id JOIN m t ON t.id = target_id
    WHERE s.module_id <> t.module_id GROUP BY ALL ORDER BY n DESC, a, b, rel_type LIMIT 10)""")
def n13(spark, d):
    return X.system_evidence(nodes(spark, d), edges(spark, d), ["class", "method"])


@query("n38_search", f"WITH {NODES_SQL} SELECT id, NULL::DOUBLE AS score FROM nodes WHERE entity_type = 'class' AND contains(lower(coalesce(name, '')), '00') ORDER BY name, id LIMIT 20")
def n38(spark, d):
    return K.search(nodes(spark, d), None, "00", ["class"], "semantic")


@query("n40_impact_by_kind", f"""WITH RECURSIVE {CALLS_SQL}, r AS (SELECT target_id AS id FROM calls WHERE source_id = 'method://p100' UNION SELECT target_id FROM r JOIN calls ON source_id = r.id),
  own AS (SELECT 'method://p100' AS id UNION SELECT target_id FROM calls WHERE source_id = 'method://p100') SELECT id, 'explicit' AS kind FROM own UNION ALL SELECT id, 'inferred' FROM r WHERE id NOT IN (FROM own)""")
def n40(spark, d):
    return K.impact_by_kind(calls(spark, d).withColumn("rel_type", F.lit("calls")), "calls", "method://p100", 1)


@query("l4_impact_rows", f"""WITH RECURSIVE {NODES_SQL}, {CALLS_SQL}, r AS (SELECT 'method://p1' AS id UNION SELECT source_id FROM r JOIN calls ON target_id = r.id)
  SELECT id, coalesce(entity_type, '') AS entity_type, coalesce(nullif(trim(name), ''), id) AS label FROM r LEFT JOIN nodes USING (id) ORDER BY 2, 3, 1 LIMIT 50""")
def l4(spark, d):
    from loomgraph.operators.traverse import impact_closure

    return K.impact_rows(impact_closure(calls(spark, d), "method://p1", "up"), nodes(spark, d), 50)


@query("v14_intents_of_hits", """SELECT CASE o_orderkey % 3 WHEN 0 THEN 'method//p' WHEN 1 THEN 'method://p' ELSE 'class//p' END || o_orderkey AS id, o_totalprice AS score, CASE WHEN o_orderkey % 3 < 2 AND o_orderkey % 2 = 0 THEN o_orderstatus END AS technical,
  CASE WHEN o_orderkey % 3 < 2 AND o_orderkey % 5 = 0 THEN o_orderpriority END AS business FROM orders""")
def v14(spark, d):
    orders, k = table(spark, d, "orders"), F.col("o_orderkey") % 3
    hits = orders.select(F.concat(F.when(k == 0, "method//p").when(k == 1, "method://p").otherwise("class//p"), "o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    own = orders.withColumn("id", F.concat(F.lit("method//p"), "o_orderkey"))
    return K.with_intents(hits, own.filter("o_orderkey % 2 = 0").select("id", F.col("o_orderstatus").alias("text")), own.filter("o_orderkey % 5 = 0").select("id", F.col("o_orderpriority").alias("text")))
