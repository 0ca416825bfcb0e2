"""Rules over structure facts: services, templates, tables of methods, links of concepts, contexts, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import facts as P
from loomgraph.operators.policy import WalkPolicy
from loomgraph.operators.retrieval import nearest_to
from loomgraph.queries._registry import query
from loomgraph.session import table
from loomgraph.sources.tables import CALLS_SQL, EDGES_SQL, METHODS_SQL, NODES_SQL, calls, code_methods, edges, nodes


@query("j17_service_facts", f"""WITH {METHODS_SQL}, modules AS (SELECT DISTINCT p_brand AS id FROM part WHERE p_brand > 'Brand#2'),
  e AS (SELECT package || '/' || class_name AS id, CASE WHEN class_name LIKE '%Impl' THEN 'class' ELSE 'interface' END AS entity_type, min(module_id) AS module_id, NULL AS path, CASE WHEN class_name LIKE '%Facade' THEN 'Brand#' || length(class_name) END AS feign FROM methods GROUP BY ALL
    UNION ALL SELECT id, 'method', module_id, CASE WHEN class_name LIKE '%Controller' THEN '/' || words END, NULL FROM methods),
  known AS (SELECT id FROM modules UNION SELECT feign FROM e WHERE feign IS NOT NULL)
  SELECT id AS source_id, 'service://' || module_id AS target_id, 'belongs_to' AS rel_type FROM e WHERE entity_type <> 'method' AND module_id IN (SELECT id FROM modules)
  UNION SELECT 'service://' || module_id, 'api_endpoint://' || id, 'service_exposes' FROM e WHERE path IS NOT NULL AND module_id IN (SELECT id FROM modules)
  UNION SELECT id, 'service://' || feign, 'binds_to_service' FROM e WHERE feign IS NOT NULL
  UNION SELECT 'service://' || module_id, 'service://' || feign, 'service_calls' FROM e WHERE feign IS NOT NULL AND feign <> module_id AND module_id IN (SELECT id FROM known)""")
def j17(spark, d):
    m, none = code_methods(spark, d), F.lit(None).cast("string")
    classes = m.groupBy(F.concat_ws("/", "package", "class_name").alias("id"), F.when(F.col("class_name").endswith("Impl"), "class").otherwise("interface").alias("entity_type"), "class_name").agg(F.min("module_id").alias("module_id"))
    classes = classes.select("id", "entity_type", "module_id", none.alias("path"), F.when(F.col("class_name").endswith("Facade"), F.concat(F.lit("Brand#"), F.length("class_name"))).alias("feign_target"))
    methods = m.select("id", F.lit("method").alias("entity_type"), "module_id", F.when(F.col("class_name").endswith("Controller"), F.concat(F.lit("/"), "words")).alias("path"), none.alias("feign_target"))
    modules = table(spark, d, "part").filter("p_brand > 'Brand#2'").select(F.col("p_brand").alias("id"))
    return P.service_facts(classes.unionByName(methods), modules)[1]


@query("j12_templates", f"""WITH {METHODS_SQL}, t AS (SELECT DISTINCT 't' || l_linenumber || '-' || l_suppkey AS template_id, 'method://p' || (l_suppkey * l_linenumber) AS mid, class_name AS cn, 'step' || l_quantity::INT AS mn FROM lineitem JOIN methods ON p_partkey = l_suppkey)
  SELECT m.id, template_id FROM t JOIN methods m ON m.id = mid UNION SELECT m.id, template_id FROM t JOIN methods m ON lower(m.class_name) = lower(cn) AND m.name = mn""")
def j12(spark, d):
    m = code_methods(spark, d)
    owner = m.select(F.col("id").alias("owner"), F.concat(F.lit("com.x."), F.upper("class_name")).alias("class_name"))
    used = table(spark, d, "lineitem").select("l_linenumber", "l_suppkey", F.col("l_quantity").cast("int").alias("q")).distinct().join(owner, F.concat(F.lit("method://p"), "l_suppkey") == F.col("owner"))
    templates = used.select(F.concat(F.lit("t"), "l_linenumber", F.lit("-"), "l_suppkey").alias("template_id"), F.concat(F.lit("method//p"), F.col("l_suppkey") * F.col("l_linenumber")).alias("method_id"), "class_name", F.concat(F.lit("STEP"), "q").alias("method_name"))
    return P.templates_of_methods(templates, m.select("id", "class_name", F.lit(None).cast("string").alias("name"), F.concat(F.lit("public void "), "signature").alias("signature"), F.lit(None).cast("string").alias("location")))


@query("g22_first_access", f"""WITH RECURSIVE {CALLS_SQL}, a AS (SELECT l_suppkey AS t, 'method://p' || l_partkey AS m, CASE l_returnflag WHEN 'R' THEN 'select' ELSE 'update' END AS op, min(l_orderkey * 10 + l_linenumber) AS o FROM lineitem WHERE l_suppkey <= 5 AND l_returnflag <> 'R' GROUP BY ALL),
  r AS (SELECT DISTINCT m AS s, m AS id, 0 AS hop FROM a UNION SELECT s, source_id, hop + 1 FROM r JOIN calls ON target_id = id WHERE hop < 2 AND source_id NOT LIKE 'method://p1%'),
  f AS (SELECT t, m, min({{'o': o, 'op': op}}) AS x FROM a GROUP BY ALL), h AS (SELECT s, id, min(hop) AS hop FROM r WHERE hop > 0 GROUP BY ALL)
  SELECT t AS table_id, m AS method_id, op, 0 AS hop FROM a UNION ALL
  SELECT t, id, x.op, x.hop FROM (SELECT t, id, min({{'o': f.x.o, 's': s, 'op': f.x.op, 'hop': hop}}) AS x FROM f JOIN h ON s = m WHERE (t, id) NOT IN (SELECT (t, m) FROM a) GROUP BY ALL)""")
def g22(spark, d):
    used = table(spark, d, "lineitem").filter("l_suppkey <= 5")
    accesses = used.groupBy(F.col("l_suppkey").alias("table"), F.concat(F.lit("method://p"), "l_partkey").alias("method_id"), F.when(F.col("l_returnflag") == "R", "select").otherwise("update").alias("op")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    walk = WalkPolicy(excluded_relations=("implements",), excluded_prefixes=("method://p1",))
    found = P.methods_for_tables(accesses, calls(spark, d).withColumn("rel_type", F.lit("calls")), nodes(spark, d), "write", 2, walk)
    return found.select(F.col("table").alias("table_id"), "method_id", "op", "hop")


@query("j9_concept_edges", f"""WITH {NODES_SQL} SELECT 'term://' || p_brand AS source_id, 'method://p' || p_partkey AS target_id, 'RELATED_TO' AS rel_type, p_size / 100.0 AS confidence, NULL::VARCHAR AS source FROM part WHERE p_type <> 'PROMO' AND p_brand < 'Brand#2'
  UNION ALL SELECT 'domain://' || p_brand, 'method://p' || p_partkey, 'RELATED_TO', p_size / 100.0, NULL FROM part WHERE p_type <> 'PROMO' AND p_brand >= 'Brand#2' AND p_brand < 'Brand#3'
  UNION ALL SELECT 'capability://' || p_brand, 'method://p' || p_partkey, 'IMPLEMENTED_BY', p_size / 100.0, p_name FROM part WHERE p_type = 'PROMO' AND p_brand < 'Brand#2'""")
def j9(spark, d):
    part = table(spark, d, "part")
    links = part.select(F.col("p_brand").alias("concept_id"), F.concat(F.lit("method://p"), "p_partkey").alias("entity_id"), F.when(F.col("p_type") == "PROMO", "implemented_by").otherwise("related_to").alias("link_type"), (F.col("p_size") / 100.0).alias("confidence"), F.col("p_name").alias("source"))
    brands = part.select("p_brand").distinct()
    concepts = brands.filter("p_brand < 'Brand#2'").select(F.concat(F.lit("term://"), "p_brand").alias("id")).union(brands.filter("p_brand < 'Brand#3'").select(F.concat(F.lit("domain://"), "p_brand"))).union(brands.filter("p_brand < 'Brand#2'").select(F.concat(F.lit("capability://"), "p_brand")))
    return P.concept_edges(links, concepts.union(nodes(spark, d).select("id")))


_COSINE = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 4)"


@query("v16_retrieved_contexts", f"""WITH {EDGES_SQL}, h AS (SELECT 'method://p' || a.vec_id AS id, {_COSINE} AS score FROM embeddings a JOIN embeddings b ON b.vec_id = 5 ORDER BY score DESC, 1 LIMIT 8), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rn FROM h),
  o AS (SELECT id, list(DISTINCT target_id ORDER BY target_id)[1:5] AS p FROM r JOIN edges ON source_id = id WHERE rn <= 3 GROUP BY 1), i AS (SELECT id, list(DISTINCT source_id ORDER BY source_id)[1:5] AS p FROM r JOIN edges ON target_id = id WHERE rn <= 3 GROUP BY 1)
  SELECT r.id, score, CASE WHEN rn <= 3 THEN coalesce(array_to_string(o.p, ' '), '') END AS callees, CASE WHEN rn <= 3 THEN coalesce(array_to_string(i.p, ' '), '') END AS callers FROM r LEFT JOIN o USING (id) LEFT JOIN i ON i.id = r.id""")
def v16(spark, d):
    hits = nearest_to(table(spark, d, "embeddings").select(F.concat(F.lit("method://p"), "vec_id").alias("id"), "embedding"), "method://p5", 8, "id", "embedding")
    found = P.retrieved_contexts(hits, edges(spark, d))
    return found.select("id", "score", *[F.array_join(c, " ").alias(c) for c in ("callees", "callers")])


@query("x25_marked_summaries", r"""SELECT conv_id, turn, CASE role WHEN 'user' THEN CASE WHEN body = '' THEN 'intro' ELSE substr(body, 1, 50) END WHEN 'assistant' THEN 'told ' || length(text) ELSE 'about ' || conv_id END AS summary
  FROM (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM conversations)""")
def x25(spark, d):
    """Summaries between marks, up to the line's end, and from the first line that says something."""
    mark, detail = F.lit("[摘要]"), F.lit("\n[详情]\nmore")
    answer = F.when(F.col("role") == "user", F.concat(F.lit("intro\n"), mark, "text", detail)).when(F.col("role") == "assistant", F.concat(mark, F.lit(" told "), F.length("text"), F.lit("\n"), "text")).otherwise(F.concat(F.lit("abc\n## about "), "conv_id", F.lit("\n"), "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", X.summary_of(answer).alias("summary"))


@query("x31_answers_that_count", """SELECT event_type AS pattern_name, count(*) AS n, round(sum(greatest(0.0, least(1.0, value / 100))), 4) AS confidence FROM events WHERE event_type IN ('click', 'view', 'error') AND value IS NOT NULL GROUP BY 1""")
def x31(spark, d):
    e = table(spark, d, "events").filter("value IS NOT NULL")
    answers = e.select(F.col("user_id").cast("string").alias("scope"), F.when(F.col("event_type") == "error", " Architecture").otherwise("DESIGN ").alias("pattern_type"), F.col("event_type").alias("pattern_name"), (F.col("value") / 100).cast("string").alias("confidence"), F.coalesce("props", F.lit("-")).alias("summary"), F.array(F.col("event_id").cast("string"), F.lit("")).alias("entity_ids"), F.lit(None).cast("string").alias("notes"))
    found = P.valid_patterns(answers, {"design": ["click", "view"], "architecture": ["error", "purchase"]})
    return found.groupBy("pattern_name").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))
