"""Names that hold names, calls resolved by name, walks with a budget, reach with and without inferred edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import calls as C
from loomgraph.operators import containment as N
from loomgraph.operators.budget import budgeted_walks, call_chains
from loomgraph.operators.reach import benefit_of_inference
from loomgraph.queries._registry import query
from loomgraph.session import dealt, table
from loomgraph.sources.tables import CALLS_SQL, EDGES_SQL, METHODS_SQL, calls, code_methods, edges

_STATEMENTS_SQL = f"""statements AS (SELECT DISTINCT 'com.' || lower(l_returnflag) || '.' || regexp_replace(class_name, '(Service|Mapper|Controller|Facade).*$', '') || 'Mapper' AS namespace, 'STEP' || l_quantity::INT AS statement_id
  FROM lineitem JOIN methods ON l_partkey = p_partkey)"""


@query("j11_mapper_methods", f"""WITH {METHODS_SQL}, {_STATEMENTS_SQL}, hits AS (SELECT namespace, statement_id, min({{'name': name, 'id': id}}) AS x FROM statements JOIN methods
  ON contains(class_name, list_extract(string_split(namespace, '.'), -1)) AND contains(lower(name), lower(statement_id)) GROUP BY ALL)
  SELECT namespace, statement_id, x.id AS id FROM statements LEFT JOIN hits USING (namespace, statement_id)""")
def j11(spark, d):
    methods = code_methods(spark, d)
    sold = table(spark, d, "lineitem").select(F.concat(F.lit("method://p"), "l_partkey").alias("id"), "l_returnflag", F.col("l_quantity").cast("int").alias("quantity")).distinct()
    base = F.regexp_replace("class_name", "(Service|Mapper|Controller|Facade).*$", "")
    statements = sold.join(methods.select("id", "class_name"), "id").select(F.concat(F.lit("com."), F.lower("l_returnflag"), F.lit("."), base, F.lit("Mapper")).alias("namespace"), F.concat(F.lit("STEP"), "quantity").alias("statement_id"))
    return N.mapper_methods(statements, methods)


@query("j14_interface_methods", f"""WITH {METHODS_SQL}, own AS (SELECT class_name, name, max(id) AS id FROM methods GROUP BY ALL)
  SELECT a.id AS interface_id, b.id FROM own a JOIN own b ON a.name = b.name AND NOT a.class_name LIKE '%Impl' AND b.class_name LIKE '%Impl' AND contains(b.class_name, a.class_name)""")
def j14(spark, d):
    return N.interface_implementations(code_methods(spark, d))


@query("a20_pattern_hints", f"""WITH {METHODS_SQL}, k(word) AS (VALUES ('service'), ('impl'), ('brand1'), ('ring'), ('smallr')) SELECT class_name AS name, count(*) AS score FROM (SELECT DISTINCT class_name FROM methods) JOIN k ON contains(lower(class_name), word) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def a20(spark, d):
    classes = code_methods(spark, d).select(F.col("class_name").alias("id"), F.col("class_name").alias("name")).distinct()
    return N.keyword_scores(classes, ["Service", "Impl", "Brand1", "Ring", "SmallR"]).select(F.col("id").alias("name"), "score").orderBy(F.desc("score"), "name").limit(10)


@query("j15_resolved_calls", f"""WITH {METHODS_SQL}, classes AS (SELECT DISTINCT package || '.' || class_name AS fqn FROM methods),
  firsts AS (SELECT package || '.' || class_name AS fqn, name, min({{'o': p_partkey, 'id': id}}).id AS target_id FROM methods GROUP BY 1, 2),
  deferred AS (SELECT DISTINCT 'method://p' || l_partkey AS caller_id, CASE WHEN l_returnflag = 'R' THEN 'org' ELSE package END || '.' || class_name AS target_fqn, 'step' || l_quantity::INT AS callee FROM lineitem JOIN methods ON p_partkey = l_suppkey)
  SELECT caller_id, target_fqn, callee, target_id, CASE WHEN c.fqn IS NULL THEN 'no_class' WHEN target_id IS NULL THEN 'no_method' WHEN target_id = caller_id THEN 'self' ELSE 'resolved' END AS status
  FROM deferred d LEFT JOIN classes c ON c.fqn = target_fqn LEFT JOIN firsts f ON f.fqn = target_fqn AND f.name = callee""")
def j15(spark, d):
    methods = code_methods(spark, d).withColumn("ordinal", F.regexp_extract("id", r"\d+$", 0).cast("long")).withColumn("class_id", F.concat_ws("/", "package", "class_name"))
    classes = methods.groupBy("class_id", "package", F.col("class_name").alias("name")).agg(F.min("ordinal").alias("ordinal"))
    sold = table(spark, d, "lineitem").select(F.concat(F.lit("method://p"), "l_partkey").alias("caller_id"), F.concat(F.lit("method://p"), "l_suppkey").alias("id"), "l_returnflag", F.concat(F.lit("step"), F.col("l_quantity").cast("int")).alias("callee"))
    deferred = sold.join(methods.select("id", "package", "class_name"), "id").select("caller_id", F.concat_ws(".", F.when(F.col("l_returnflag") == "R", "org").otherwise(F.col("package")), "class_name").alias("target_fqn"), "callee")
    return C.resolve_calls(dealt(deferred, "caller_id", "callee", read=table(spark, d, "lineitem")), classes, methods.select("id", "class_id", "signature", "ordinal"))


@query("g8_budgeted_walks", f"""WITH RECURSIVE {EDGES_SQL}, steps AS (SELECT source_id AS a, target_id AS b FROM edges WHERE rel_type = 'belongs_to' UNION SELECT target_id, source_id FROM edges WHERE rel_type = 'belongs_to'),
  v AS (SELECT 'package//' || n_nationkey AS start_id, ['package//' || n_nationkey] AS seen, ['package//' || n_nationkey] AS front, 0 AS hop FROM nation
    UNION ALL SELECT start_id, list_concat(seen, list(b ORDER BY pos, b)[1:40 - len(seen)]), list(b ORDER BY pos, b)[1:40 - len(seen)], hop + 1 FROM
      (SELECT start_id, seen, hop, b, min(pos) AS pos FROM (SELECT start_id, seen, hop, unnest(front) AS a, generate_subscripts(front, 1) AS pos FROM v WHERE len(seen) < 40 AND hop < 3) JOIN steps USING (a) WHERE NOT list_contains(seen, b) GROUP BY ALL) GROUP BY start_id, seen, hop),
  f AS (SELECT start_id, hop, unnest(front) AS node_id, generate_subscripts(front, 1) + len(seen) - len(front) AS place FROM v) SELECT start_id, node_id, hop, place FROM f""")
def g8(spark, d):
    starts = table(spark, d, "nation").select(F.concat(F.lit("package//"), "n_nationkey").alias("start_id")).select("start_id", F.col("start_id").alias("node_id"))
    return budgeted_walks(edges(spark, d).filter("rel_type = 'belongs_to'"), starts, 40, 3, "both")


@query("g12_code_chains")
def g12(spark, d):
    """Call chains over classes with one and with several implementations; tested against a plain walk, which SQL can't express level by level."""
    methods = code_methods(spark, d)
    starts = table(spark, d, "supplier").select(F.concat(F.lit("method://p"), "s_suppkey").alias("start_id"))
    skipped = methods.filter("class_name LIKE '%Facade'").select("id")
    return call_chains(methods.withColumn("entity_type", F.lit("method")), calls(spark, d), N.interface_implementations(methods), skipped, starts, "up", 4, 30)


_INFERRED_SQL = "SELECT 'method://p' || p_partkey AS source_id, 'method://p' || p_size AS target_id FROM part WHERE p_size < p_partkey AND p_type = 'PROMO'"


@query("a19_reach_sizes", f"""WITH RECURSIVE {CALLS_SQL}, every AS (SELECT * FROM calls UNION {_INFERRED_SQL}), ids AS (SELECT 'method://p' || p_partkey AS id FROM part UNION SELECT target_id FROM every),
  a AS (SELECT id AS start_id, id FROM ids UNION SELECT start_id, target_id FROM a JOIN calls ON source_id = a.id), b AS (SELECT id AS start_id, id FROM ids UNION SELECT start_id, target_id FROM b JOIN every ON source_id = b.id)
  SELECT start_id AS id, x.n AS explicit, y.n AS reached, y.n - x.n AS gained FROM (SELECT start_id, count(*) AS n FROM a GROUP BY 1) x JOIN (SELECT start_id, count(*) AS n FROM b GROUP BY 1) y USING (start_id)""")
def a19(spark, d):
    method = lambda c: F.concat(F.lit("method://p"), c)
    inferred = table(spark, d, "part").filter("p_size < p_partkey AND p_type = 'PROMO'").select(method("p_partkey").alias("source_id"), method("p_size").alias("target_id"), F.lit(True).alias("inferred"))
    every = calls(spark, d).withColumn("inferred", F.lit(False)).unionByName(inferred)
    ids = table(spark, d, "part").select(method("p_partkey").alias("id")).union(every.select("target_id")).distinct()
    return benefit_of_inference(every, ids)
