"""Reports, screens and the ontology."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import views as S
from loomgraph.queries._registry import query
from loomgraph.session import table
from loomgraph.sources import triples as T
from loomgraph.sources.tables import EDGES_SQL, METHODS_SQL, NODES_SQL, calls, code_methods, edges, nodes


def _local(c: str) -> str:
    return f"regexp_replace({c}, '[^A-Za-z0-9_.-]', '_', 'g')"


def _class(c: str) -> str:
    return f"'<{T.BASE}' || CASE WHEN {c} IN ('class', 'method', 'package', 'service', 'api_endpoint') THEN 'code#' ELSE 'domain#' END || {_local(c)} || '>'"


@query("k8_ontology", f"""WITH {NODES_SQL}, {EDGES_SQL}, every AS (SELECT id, entity_type, name FROM nodes UNION ALL SELECT 'event//' || event_type, 'Event', event_type FROM events), t AS (SELECT DISTINCT entity_type AS t FROM every), k AS (SELECT DISTINCT rel_type AS k FROM edges)
  SELECT {_class('t')} || ' <{T.RDF}type> <{T.OWL}Class> .' AS triple FROM t UNION SELECT {_class('t')} || ' <{T.RDFS}label> "' || t || '" .' FROM t
  UNION SELECT '<{T.BASE}code#' || k || '> <{T.RDF}type> <{T.OWL}ObjectProperty> .' FROM k UNION SELECT '<{T.BASE}code#' || k || '> <{T.RDFS}label> "' || k || '" .' FROM k
  UNION SELECT '<{T.BASE}code#' || k || '> <{T.RDF}type> <{T.OWL}TransitiveProperty> .' FROM k WHERE k IN ({', '.join(f"'{x}'" for x in T.TRANSITIVE)})
  UNION SELECT '<{T.BASE}id/' || {_local('id')} || '> <{T.RDF}type> ' || {_class('entity_type')} || ' .' FROM every
  UNION SELECT '<{T.BASE}id/' || {_local('id')} || '> <{T.RDFS}label> "' || name || '" .' FROM every WHERE name IS NOT NULL
  UNION SELECT '<{T.BASE}id/' || {_local('source_id')} || '> <{T.BASE}code#' || rel_type || '> <{T.BASE}id/' || {_local('target_id')} || '> .' FROM edges""")
def k8(spark, d):
    kinds = table(spark, d, "events").select(F.concat(F.lit("event//"), "event_type").alias("id"), F.lit("Event").alias("entity_type"), F.col("event_type").alias("name"))
    return T.ontology_triples(nodes(spark, d).select("id", "entity_type", "name").union(kinds), edges(spark, d))


@query("n13_module_evidence", f"""WITH {METHODS_SQL}, c AS (SELECT DISTINCT class_name, module_id FROM methods), e AS (SELECT 'method://p' || p_partkey AS s, 'method://p' || (p_partkey // 2) AS t FROM part WHERE p_partkey >= 2),
  x AS (SELECT a.module_id AS a, b.module_id AS b, count(*) AS n FROM e JOIN methods a ON a.id = s JOIN methods b ON b.id = t WHERE a.module_id <> b.module_id AND 'Brand#7' IN (a.module_id, b.module_id) GROUP BY ALL ORDER BY n DESC, a, b LIMIT 10),
  p AS (SELECT words, count(*) AS n FROM methods WHERE module_id = 'Brand#7' AND class_name LIKE '%Controller' GROUP BY 1 ORDER BY n DESC, '/' || words LIMIT 12),
  h AS (SELECT class_name, (contains(lower(class_name), 'service')::INT + contains(lower(class_name), 'ring')::INT) AS n FROM c WHERE module_id = 'Brand#7' AND n > 0 ORDER BY n DESC, 'class//' || class_name LIMIT 10)
  SELECT 'counts' AS section, 'class=' || count(*) AS line FROM c WHERE module_id = 'Brand#7' HAVING count(*) > 0 UNION ALL SELECT 'counts', 'method=' || count(*) FROM methods WHERE module_id = 'Brand#7' HAVING count(*) > 0
  UNION ALL SELECT 'dependencies', '- ' || a || ' -> ' || b || ' (' || n || ')' FROM x UNION ALL SELECT 'paths', '- /' || words FROM p UNION ALL SELECT 'hints', '- class//' || class_name || ' | ' || class_name FROM h""")
def n13(spark, d):
    m, none = code_methods(spark, d), F.lit(None).cast("string")
    path = F.when(F.col("class_name").endswith("Controller"), F.concat(F.lit("/"), "words"))
    classes = m.select("class_name", "module_id").distinct().select(F.concat(F.lit("class//"), "class_name").alias("id"), F.lit("class").alias("entity_type"), F.col("class_name").alias("name"), "module_id", none.alias("class_name"), none.alias("code"), none.alias("path"))
    own = m.select("id", F.lit("method").alias("entity_type"), "name", "module_id", "class_name", none.alias("code"), path.alias("path"))
    return S.module_evidence(classes.unionByName(own), calls(spark, d).withColumn("rel_type", F.lit("CALLS")), "Brand#7", ["Service", "Ring"]).select("section", "line")


@query("n39_subgraph_of_module", f"""WITH {NODES_SQL}, {EDGES_SQL}, m AS (SELECT id FROM nodes WHERE module_id = 'ASIA') SELECT source_id, target_id, rel_type FROM edges WHERE source_id IN (SELECT id FROM m) AND target_id IN (SELECT id FROM m)""")
def n39(spark, d):
    """The edges within the module of a package in Asia."""
    return S.search_with_subgraph(nodes(spark, d), edges(spark, d), "NATION", "package//2")[2]


_SCORE = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 4)"


@query("n44_search_report", f"""WITH s AS (SELECT b.vec_id AS item, 'm' || a.vec_id AS id, a.vec_id AS v, {_SCORE} AS score FROM embeddings a JOIN embeddings b ON b.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, id) AS place FROM s)
  SELECT item::VARCHAR AS item, place, '[' || printf('%.4f', score) || '] L' || label || '.' || id || ' → ' || 'about ' || label AS line FROM r JOIN embeddings e ON e.vec_id = v WHERE place <= 5""")
def n44(spark, d):
    e = table(spark, d, "embeddings")
    texts = e.select(F.concat(F.lit("m"), "vec_id").alias("id"), F.col("embedding").alias("vector"), F.concat(F.lit("L"), "label").alias("class_name"), F.concat(F.lit("m"), "vec_id").alias("name"), F.concat(F.lit("[摘要] about "), "label", F.lit("\n[详情] more")).alias("text"))
    return S.search_report(texts, e.filter("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("item"), F.col("embedding").alias("vector")))
