"""Which method reaches which table and how; statements, incremental work lists, streaming upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.text import sql_tables
from loomgraph.operators.traverse import bfs
from loomgraph.queries._registry import query
from loomgraph.session import table
from loomgraph.sources.tables import CALLS_SQL, calls


@query("x19_sql_tables", """SELECT l_orderkey, l_linenumber, 'db.part_' || lower(l_returnflag) || ',supp_' || lower(l_linestatus) || ',log' AS tables FROM lineitem""")
def x19(spark, d):
    statement = F.concat(F.lit("INSERT INTO `Db`.Part_"), "l_returnflag", F.lit(" SELECT a FROM `supp_"), "l_linestatus", F.lit("` s JOIN (select 1 from where) x; truncate TABLE Log"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(sql_tables(statement), ",").alias("tables"))


@query("a10_access_groups", """SELECT l_suppkey AS "table", l_returnflag AS op, min(l_linenumber) AS min_hop, max(l_linenumber) AS max_hop, count(DISTINCT l_partkey) AS methods FROM lineitem GROUP BY ALL""")
def a10(spark, d):
    one = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("table"), F.col("l_returnflag").alias("op"), "l_partkey").agg(F.min("l_linenumber").alias("low"), F.max("l_linenumber").alias("high"))
    return one.groupBy("table", "op").agg(F.min("low").alias("min_hop"), F.max("high").alias("max_hop"), F.count("*").alias("methods"))


@query("g21_tables_for_method", f"""WITH RECURSIVE {CALLS_SQL}, r AS (SELECT 'method://p100' AS id, 0 AS hop UNION SELECT target_id, hop + 1 FROM r JOIN calls ON source_id = id WHERE hop < 8)
  SELECT l_suppkey AS "table", l_returnflag AS op, min(hop) AS min_hop, max(hop) AS max_hop FROM r JOIN lineitem ON id = 'method://p' || l_partkey GROUP BY ALL""")
def g21(spark, d):
    start = spark.createDataFrame([("method://p100", "method://p100")], "start_id string, node_id string")
    reached = bfs(calls(spark, d), start, 8).select("node_id", "hop")
    access = table(spark, d, "lineitem").select(F.concat(F.lit("method://p"), "l_partkey").alias("node_id"), F.col("l_suppkey").alias("table"), F.col("l_returnflag").alias("op")).distinct()
    return access.join(reached, "node_id").groupBy("table", "op").agg(F.min("hop").alias("min_hop"), F.max("hop").alias("max_hop"))


@query("g22_methods_for_table", f"""WITH RECURSIVE {CALLS_SQL}, r AS (SELECT DISTINCT 'method://p' || l_partkey AS id, 0 AS hop FROM lineitem WHERE l_suppkey = 3 UNION SELECT source_id, hop + 1 FROM r JOIN calls ON target_id = id WHERE hop < 3)
  SELECT id, min(hop) AS hop FROM r GROUP BY 1""")
def g22(spark, d):
    users = table(spark, d, "lineitem").filter("l_suppkey = 3").select(F.lit("3").alias("start_id"), F.concat(F.lit("method://p"), "l_partkey").alias("node_id")).distinct()
    return bfs(calls(spark, d), users, 3, "up").select(F.col("node_id").alias("id"), "hop")


@query("b1_enrichment_todo", "SELECT doc_id, length(text) AS size FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND length(text) >= 20 ORDER BY doc_id LIMIT 200")
def b1(spark, d):
    todo = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    return todo.filter(F.length("text") >= 20).orderBy("doc_id").limit(200).select("doc_id", F.length("text").alias("size"))


@query("b5_callee_context", f"""WITH {CALLS_SQL}, s AS (SELECT source_id, target_id, length(p_type) AS size FROM calls JOIN part ON target_id = 'method://p' || p_partkey),
  u AS (SELECT *, sum(size) OVER (PARTITION BY target_id ORDER BY source_id ROWS UNBOUNDED PRECEDING) AS used FROM s) SELECT target_id, count(*) AS callers, CAST(sum(size) AS BIGINT) AS chars FROM u WHERE used <= 2000 GROUP BY 1""")
def b5(spark, d):
    from pyspark.sql import Window as W

    summary = table(spark, d, "part").select(F.concat(F.lit("method://p"), "p_partkey").alias("target_id"), F.length("p_type").alias("size"))
    used = F.sum("size").over(W.partitionBy("target_id").orderBy("source_id").rowsBetween(W.unboundedPreceding, 0))
    kept = calls(spark, d).join(summary, "target_id").withColumn("used", used).filter("used <= 2000")
    return kept.groupBy("target_id").agg(F.count("*").alias("callers"), F.sum("size").alias("chars"))
