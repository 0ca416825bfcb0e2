"""Traversals: closures, shortest hops, neighbourhoods, transitive closure, components, levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import traverse as T
from loomgraph.queries._registry import query
from loomgraph.session import table
from loomgraph.sources.tables import CALLS_SQL, EDGES_SQL, NODES_SQL, TRANSITIONS_SQL, calls, edges, nodes, transitions

_LAST = "(SELECT 'method://p' || max(p_partkey) FROM part)"


def _last(spark, d):
    return "method://p" + str(table(spark, d, "part").agg(F.max("p_partkey")).first()[0])


@query("g1_graph_with_phantoms", f"""WITH {NODES_SQL}, {EDGES_SQL}, every AS (SELECT id FROM nodes UNION SELECT source_id FROM edges UNION SELECT target_id FROM edges)
  SELECT coalesce(entity_type, 'phantom') AS entity_type, count(*) AS n FROM every LEFT JOIN nodes USING (id) GROUP BY 1""")
def g1(spark, d):
    from loomgraph.operators.graph import with_phantoms

    return with_phantoms(nodes(spark, d), edges(spark, d)).groupBy(F.coalesce("entity_type", F.lit("phantom")).alias("entity_type")).agg(F.count("*").alias("n"))


@query("g3_impact_down", f"""WITH RECURSIVE {CALLS_SQL}, r AS (SELECT {_LAST} AS id, 0 AS hop UNION SELECT target_id, hop + 1 FROM r JOIN calls ON source_id = id)
  SELECT id, min(hop) AS hop FROM r GROUP BY 1""")
def g3_down(spark, d):
    return T.impact_closure(calls(spark, d), _last(spark, d))


@query("g3_impact_up", f"""WITH RECURSIVE {CALLS_SQL}, r AS (SELECT 'method://p3' AS id, 0 AS hop UNION SELECT source_id, hop + 1 FROM r JOIN calls ON target_id = id)
  SELECT id, min(hop) AS hop FROM r GROUP BY 1""")
def g3_up(spark, d):
    return T.impact_closure(calls(spark, d), "method://p3", "up")


@query("g4_impact_both", f"""WITH RECURSIVE {CALLS_SQL}, u AS (SELECT 'method://p9' AS id, 0 AS hop UNION SELECT source_id, hop + 1 FROM u JOIN calls ON target_id = id),
  d AS (SELECT 'method://p9' AS id, 0 AS hop UNION SELECT target_id, hop + 1 FROM d JOIN calls ON source_id = id)
  SELECT id, min(hop) AS hop FROM (SELECT * FROM u UNION ALL SELECT * FROM d) GROUP BY 1""")
def g4(spark, d):
    return T.impact_closure(calls(spark, d), "method://p9", "both")


@query("g3_impact_cyclic", f"""WITH RECURSIVE {TRANSITIONS_SQL}, r AS (SELECT 'event//click' AS id UNION SELECT target_id FROM r JOIN transitions ON source_id = id) SELECT id FROM r""")
def g3_cyclic(spark, d):
    return T.impact_closure(transitions(spark, d), "event//click").select("id")


@query("g5_bfs_min_hops", f"""WITH RECURSIVE {EDGES_SQL}, walk AS (SELECT DISTINCT source_id, target_id FROM edges WHERE rel_type <> 'uses'),
  r AS (SELECT 'method://p7' AS node_id, 0 AS hop UNION SELECT target_id, hop + 1 FROM r JOIN walk ON source_id = node_id WHERE hop < 4) SELECT node_id, min(hop) AS hop FROM r GROUP BY 1""")
def g5(spark, d):
    walk = edges(spark, d).filter("rel_type <> 'uses'")
    start = spark.createDataFrame([("method://p7", "method://p7")], "start_id string, node_id string")
    return T.bfs(walk, start, 4).select("node_id", "hop")


@query("g6_parents", f"""WITH RECURSIVE {CALLS_SQL}, r AS (SELECT {_LAST} AS node_id, 0 AS hop, NULL::VARCHAR AS parent_id UNION ALL SELECT target_id, hop + 1, node_id FROM r JOIN calls ON source_id = node_id)
  SELECT node_id, hop, parent_id FROM r""")
def g6(spark, d):
    last = _last(spark, d)
    return T.bfs(calls(spark, d), spark.createDataFrame([(last, last)], "start_id string, node_id string")).select("node_id", "hop", "parent_id")


@query("g9_multi_source_distance", f"""WITH RECURSIVE {CALLS_SQL}, r AS (SELECT 'method://p' || p_partkey AS node_id, 0 AS dist FROM part WHERE p_partkey % 97 = 1
  UNION SELECT source_id, dist + 1 FROM r JOIN calls ON target_id = node_id) SELECT node_id, min(dist) AS dist FROM r GROUP BY 1""")
def g9(spark, d):
    starts = table(spark, d, "part").filter("p_partkey % 97 = 1").select(F.lit("all").alias("start_id"), F.concat(F.lit("method://p"), "p_partkey").alias("node_id"))
    return T.bfs(calls(spark, d), starts, direction="up").select("node_id", F.col("hop").alias("dist"))


@query("g10_call_rings", f"""WITH RECURSIVE {CALLS_SQL}, both_ways AS (SELECT source_id AS a, target_id AS b FROM calls UNION SELECT target_id, source_id FROM calls),
  r AS (SELECT 'method://p12' AS id, 0 AS hop UNION SELECT b, hop + 1 FROM r JOIN both_ways ON a = id WHERE hop < 6) SELECT ring, count(*) AS n FROM (SELECT id, least(min(hop), 3) AS ring FROM r GROUP BY 1) GROUP BY 1""")
def g10(spark, d):
    start = spark.createDataFrame([("method://p12", "method://p12")], "start_id string, node_id string")
    return T.bfs(calls(spark, d), start, 6, "both").groupBy(F.least("hop", F.lit(3)).alias("ring")).agg(F.count("*").alias("n"))


@query("g11_k_hop", f"""WITH RECURSIVE {EDGES_SQL}, both_ways AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges),
  r AS (SELECT 'package//3' AS id, 0 AS hop UNION SELECT b, hop + 1 FROM r JOIN both_ways ON a = id WHERE hop < 2) SELECT id, min(hop) AS hop FROM r GROUP BY 1""")
def g11(spark, d):
    start = spark.createDataFrame([("package//3", "package//3")], "start_id string, node_id string")
    return T.bfs(edges(spark, d), start, 2, "both").select(F.col("node_id").alias("id"), "hop")


@query("g13_service_subgraph", f"""WITH RECURSIVE {EDGES_SQL}, up AS (SELECT 'service://ASIA' AS id UNION SELECT source_id FROM up JOIN edges ON target_id = id AND rel_type = 'belongs_to')
  SELECT rel_type, count(*) AS n FROM edges WHERE source_id IN (SELECT id FROM up) AND target_id IN (SELECT id FROM up) GROUP BY 1""")
def g13(spark, d):
    from loomgraph.operators.graph import induced_edges

    e = edges(spark, d)
    inside = T.impact_closure(e.filter("rel_type = 'belongs_to'"), "service://ASIA", "up")
    return induced_edges(e, inside).groupBy("rel_type").agg(F.count("*").alias("n"))


@query("g14_transitive_pairs", f"""WITH RECURSIVE {CALLS_SQL}, r AS (SELECT source_id, target_id FROM calls UNION SELECT r.source_id, c.target_id FROM r JOIN calls c ON c.source_id = r.target_id)
  SELECT source_id, target_id FROM r WHERE source_id <> target_id EXCEPT SELECT source_id, target_id FROM calls""")
def g14(spark, d):
    return T.transitive_pairs(calls(spark, d))


@query("g17_strong_components", f"""WITH RECURSIVE {TRANSITIONS_SQL}, r AS (SELECT source_id AS a, target_id AS b FROM transitions UNION SELECT a, target_id FROM r JOIN transitions ON source_id = b),
  every AS (SELECT source_id AS id FROM transitions UNION SELECT target_id FROM transitions)
  SELECT id, greatest(id, coalesce((SELECT max(x.b) FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a = id), id)) AS component FROM every""")
def g17(spark, d):
    t = transitions(spark, d)
    return T.strong_components(t, t.select(F.col("source_id").alias("id")).union(t.select("target_id")))


@query("g18_levels", f"""WITH RECURSIVE {CALLS_SQL}, r AS (SELECT 'method://p' || p_partkey AS id, 0 AS level FROM part WHERE p_partkey < 2
  UNION ALL SELECT source_id, level + 1 FROM r JOIN calls ON target_id = id) SELECT id, max(level) AS level FROM r GROUP BY 1""")
def g18(spark, d):
    methods = nodes(spark, d).filter("entity_type = 'method'")
    return T.levels(calls(spark, d), methods).select("id", "level")


@query("g20_filtered_calls", f"""WITH {CALLS_SQL}, kept AS (SELECT 'method://p' || p_partkey AS id FROM part WHERE p_size > 5)
  SELECT count(*) AS edges, count(*) FILTER (s.id IS NOT NULL AND t.id IS NOT NULL) AS kept, count(*) FILTER (s.id IS NULL) AS dropped_sources, count(*) FILTER (t.id IS NULL) AS dropped_targets
  FROM calls LEFT JOIN kept s ON s.id = source_id LEFT JOIN kept t ON t.id = target_id""")
def g20(spark, d):
    kept = table(spark, d, "part").filter("p_size > 5").select(F.concat(F.lit("method://p"), "p_partkey").alias("id"), F.lit(True).alias("in"))
    j = calls(spark, d).join(kept.toDF("source_id", "s"), "source_id", "left").join(kept.toDF("target_id", "t"), "target_id", "left")
    no = lambda c: F.col(c).isNull()
    return j.agg(F.count("*").alias("edges"), F.count_if(~no("s") & ~no("t")).alias("kept"), F.count_if(no("s")).alias("dropped_sources"), F.count_if(no("t")).alias("dropped_targets"))


@query("g23_domain_rings", f"""WITH {NODES_SQL} SELECT module_id, entity_type, count(*) AS n FROM nodes WHERE module_id IN (SELECT r_name FROM region) GROUP BY ALL""")
def g23(spark, d):
    regions = table(spark, d, "region").select(F.col("r_name").alias("module_id"))
    return nodes(spark, d).join(regions, "module_id", "left_semi").groupBy("module_id", "entity_type").agg(F.count("*").alias("n"))


@query("g24_capability_chain", """SELECT r_name AS domain, p_brand AS capability, count(DISTINCT l_partkey) AS methods FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey
  JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def g24(spark, d):
    t = lambda n: table(spark, d, n)
    owners = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    # Parts are made distinct before the join, which leaves one row for each part and owner.
    used = t("lineitem").select("l_partkey", "l_suppkey").distinct().join(owners, F.col("l_suppkey") == F.col("s_suppkey")).select("r_name", "l_partkey").distinct()
    return used.join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("r_name").alias("domain"), F.col("p_brand").alias("capability")).agg(F.count("*").alias("methods"))


@query("g27_hits_with_neighbours", f"""WITH {NODES_SQL}, {EDGES_SQL}, hits AS (SELECT id FROM nodes WHERE entity_type = 'method' AND contains(lower(name), 'blue') ORDER BY id LIMIT 5)
  SELECT id, target_id FROM (SELECT id, target_id, row_number() OVER (PARTITION BY id ORDER BY target_id) AS rn FROM hits JOIN edges ON source_id = id) WHERE rn <= 5""")
def g27(spark, d):
    from pyspark.sql import Window as W

    hits = nodes(spark, d).filter((F.col("entity_type") == "method") & F.lower("name").contains("blue")).orderBy("id").limit(5).select("id")
    near = edges(spark, d).withColumnRenamed("source_id", "id").join(F.broadcast(hits), "id")  # five rows
    return near.withColumn("rn", F.row_number().over(W.partitionBy("id").orderBy("target_id"))).filter("rn <= 5").select("id", "target_id")


@query("g29_stats", f"WITH {NODES_SQL}, {EDGES_SQL} SELECT 'node' AS kind, entity_type AS label, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', rel_type, count(*) FROM edges GROUP BY 2")
def g29(spark, d):
    n = nodes(spark, d).groupBy(F.col("entity_type").alias("label")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "label", "n")
    return n.union(edges(spark, d).groupBy("rel_type").agg(F.count("*").alias("n")).select(F.lit("edge"), "rel_type", "n"))


@query("k8_triples", f"""WITH {NODES_SQL}, {EDGES_SQL} SELECT '<urn:' || regexp_replace(source_id, '[^A-Za-z0-9_.-]', '_', 'g') || '> <urn:' || rel_type || '> <urn:' || regexp_replace(target_id, '[^A-Za-z0-9_.-]', '_', 'g') || '> .' AS triple FROM edges
  UNION ALL SELECT '<urn:' || regexp_replace(id, '[^A-Za-z0-9_.-]', '_', 'g') || '> <rdf:type> <urn:' || entity_type || '> .' FROM nodes""")
def k8(spark, d):
    from loomgraph.functions.ids import uri_local

    uri = lambda c: F.concat(F.lit("<urn:"), uri_local(F.col(c)), F.lit(">"))
    typed = nodes(spark, d).select(F.concat_ws(" ", uri("id"), F.lit("<rdf:type>"), F.concat(F.lit("<urn:"), "entity_type", F.lit(">")), F.lit(".")).alias("triple"))
    return edges(spark, d).select(F.concat_ws(" ", uri("source_id"), F.concat(F.lit("<urn:"), "rel_type", F.lit(">")), uri("target_id"), F.lit(".")).alias("triple")).union(typed)
