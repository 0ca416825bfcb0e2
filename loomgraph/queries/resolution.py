"""Resolution of names and ids across tables, scores, and functions on generated texts and paths."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.lexical import query_terms
from loomgraph.operators.containment import containing, first_containing
from loomgraph.operators.retrieval import nearest_to
from loomgraph.operators.semantic import capability_links
from loomgraph.operators.traverse import transitive_pairs
from loomgraph.queries._registry import query
from loomgraph.session import table
from loomgraph.sources.code import module_of
from loomgraph.sources.tables import CALLS_SQL, METHODS_SQL, calls, code_methods


@query("s4_page_modules", r"""SELECT page_id, CASE WHEN first = 'en' OR starts_with(p, 'en') THEN 'en' WHEN first = 'docs' OR starts_with(p, 'fr') THEN 'docs' ELSE first END AS module, regexp_extract(p, '\.([^./]+)$', 1) AS suffix
  FROM (SELECT page_id, p, split_part(p, '/', 1) AS first FROM (SELECT page_id, regexp_extract(url, '^[^:]+://[^/]+/([^?#]*)', 1) AS p FROM pages))""")
def s4(spark, d):
    p = F.regexp_extract("url", r"^[^:]+://[^/]+/([^?#]*)", 1)
    return table(spark, d, "pages").select("page_id", module_of(p, [("en", "en"), ("docs", "fr")]).alias("module"), F.regexp_extract(p, r"\.([^./]+)$", 1).alias("suffix"))


@query("s8_snippets", r"SELECT doc_id, substr(array_to_string(string_split(text, chr(10))[2:4], chr(10)), 1, 12000) AS snippet FROM documents")
def s8(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.array_join(F.slice(F.split("text", "\n"), 2, 3), "\n"), 1, 12000).alias("snippet"))


@query("j8_links_with_both_ends", "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def j8(spark, d):
    pairs = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    owners, parts = table(spark, d, "supplier").filter("s_acctbal > 0"), table(spark, d, "part").filter("p_size < 10")
    return pairs.join(owners.select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_semi").join(parts.select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").select("l_suppkey", "l_partkey")


@query("j11_name_in_name", "SELECT s_suppkey, min(c_custkey) AS first_hit FROM supplier JOIN customer ON s_nationkey = c_nationkey AND contains(c_name, substr(s_name, -2)) GROUP BY 1")
def j11(spark, d):
    owners, names = table(spark, d, "supplier"), table(spark, d, "customer")
    asked = owners.select("s_suppkey", F.col("s_nationkey").alias("nation"), F.substring("s_name", -2, 2).alias("pattern"))
    first = first_containing(names.select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), "c_custkey"), asked, ["c_custkey"], "c_custkey", ["nation"])
    return asked.join(first, ["nation", "pattern"]).select("s_suppkey", F.col("c_custkey").alias("first_hit"))


@query("j14_implementations", """SELECT a.w AS interface, count(*) AS implementations FROM (SELECT DISTINCT substr(p_type, 1, 2) AS w FROM part) a JOIN (SELECT DISTINCT p_type FROM part) b
  ON b.p_type <> a.w AND contains(b.p_type, a.w) GROUP BY 1""")
def j14(spark, d):
    types = table(spark, d, "part").select("p_type").distinct()
    pairs = containing(types.select(F.col("p_type").alias("name")), types.select(F.substring("p_type", 1, 2).alias("pattern")))
    return pairs.filter("name <> pattern").groupBy(F.col("pattern").alias("interface")).agg(F.count("*").alias("implementations"))


@query("j15_first_overload", "SELECT p_brand, p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_type, p_partkey) AS rn FROM part) WHERE rn = 1")
def j15(spark, d):
    return table(spark, d, "part").groupBy("p_brand", "p_name").agg(F.min(F.struct("p_type", "p_partkey")).alias("x")).select("p_brand", "p_name", "x.p_partkey")


@query("j17_service_bindings", "SELECT DISTINCT a.n_regionkey AS source_region, b.n_regionkey AS target_region FROM supplier JOIN nation a ON s_nationkey = a.n_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation b ON b.n_nationkey = c_nationkey WHERE a.n_regionkey <> b.n_regionkey")
def j17(spark, d):
    t = lambda n: table(spark, d, n)
    pairs = t("lineitem").select("l_orderkey", "l_suppkey").distinct()
    sellers = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("source_region"))
    buyers = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("n_regionkey").alias("target_region"))
    return pairs.join(sellers, "l_suppkey").join(buyers, "l_orderkey").filter("source_region <> target_region").select("source_region", "target_region").distinct()


@query("j20_merged_neighbours", f"WITH {CALLS_SQL} SELECT target_id AS id, 'method://p' || x AS peer FROM (SELECT target_id, p_partkey AS x FROM calls JOIN part ON source_id = 'method://p' || p_partkey UNION SELECT 'method://p' || l_partkey, l_suppkey FROM lineitem)")
def j20(spark, d):
    called = calls(spark, d).select(F.col("target_id").alias("id"), F.col("source_id").alias("peer"))
    stored = table(spark, d, "lineitem").select(F.concat(F.lit("method://p"), "l_partkey"), F.concat(F.lit("method://p"), "l_suppkey"))
    return called.union(stored).distinct()


@query("a16_requirement_coverage", "SELECT l_partkey AS id, count(*) AS coverage, sum(l_quantity) AS total, 10 * max(l_linenumber) + 5 * count(*) + 2 * sum(l_quantity) AS score FROM lineitem GROUP BY 1 ORDER BY score DESC, id LIMIT 20")
def a16(spark, d):
    found = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("coverage"), F.sum("l_quantity").alias("total"), F.max("l_linenumber").alias("level"))
    return found.select("id", "coverage", "total", (10 * F.col("level") + 5 * F.col("coverage") + 2 * F.col("total")).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query("a19_benefit_of_inference", f"""WITH RECURSIVE {CALLS_SQL}, r AS (SELECT 'method://p' || p_partkey AS start_id, 'method://p' || p_partkey AS id FROM part UNION SELECT start_id, target_id FROM r JOIN calls ON source_id = id)
  SELECT start_id, count(*) - 1 AS reached, count(*) - 2 AS gained FROM r GROUP BY 1 ORDER BY gained DESC, start_id LIMIT 8""")
def a19(spark, d):
    starts = table(spark, d, "part").select(F.concat(F.lit("method://p"), "p_partkey").alias("start_id"))
    direct = calls(spark, d).filter("source_id <> target_id").distinct().select(F.col("source_id").alias("start_id"), F.lit(False).alias("far"))
    ways = direct.union(transitive_pairs(calls(spark, d)).select("source_id", F.lit(True))).groupBy("start_id").agg(F.count("*").alias("reached"), F.count_if("far").alias("gained"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    sizes = starts.distinct().join(ways, "start_id", "left").select("start_id", none("reached"), none("gained"))
    return sizes.orderBy(F.desc("gained"), "start_id").limit(8)


@query("a21_pattern_candidates", """SELECT lang, bool_or(contains(lower(text), 'factory')) AS factory, bool_or(contains(lower(text), 'the')) AS observer, count(*) FILTER (contains(lower(text), 'que')) AS hits FROM documents GROUP BY 1""")
def a21(spark, d):
    has = lambda w: F.lower("text").contains(w)
    return table(spark, d, "documents").groupBy("lang").agg(F.bool_or(has("factory")).alias("factory"), F.bool_or(has("the")).alias("observer"), F.count_if(has("que")).alias("hits"))


@query("x4_capability_links", f"""WITH {METHODS_SQL}, c(capability, pattern) AS (VALUES ('small', 'small.*'), ('ring', 'ring$'), ('none', 'zebra.*')), m AS (SELECT id, capability FROM methods JOIN c ON regexp_matches(words, pattern))
  SELECT id, capability, 'path_match' AS evidence, 0.9::DOUBLE AS confidence FROM m UNION ALL
  SELECT id, 'small', 'class_naming', 0.5 FROM methods WHERE contains(class_name, 'Controller') AND id NOT IN (SELECT id FROM m)""")
def x4(spark, d):
    methods = code_methods(spark, d).select("id", F.col("words").alias("path"), "class_name")
    return capability_links(methods, [("small", "small**"), ("ring", "ring$"), ("none", "zebra**")])


@query("x10_query_terms", """SELECT item_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:60], ' ') AS terms FROM
  (SELECT item_id, list_concat(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]{2,}'), lambda x: lower(x)), ['订单取消', '步骤', '退款']) AS l FROM benchmark)""")
def x10(spark, d):
    asked = F.concat("text", F.lit(" 请问 订单取消的步骤？　退款"))
    return table(spark, d, "benchmark").select("item_id", F.array_join(query_terms(asked), " ").alias("terms"))


@query("x25_summaries", r"SELECT doc_id, substr(regexp_extract(text, '^\s*([^\n]{5,})', 1), 1, 50) AS summary FROM documents")
def x25(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.regexp_extract("text", r"^\s*([^\n]{5,})", 1), 1, 50).alias("summary"))


@query("x31_valid_patterns", "SELECT event_id, event_type, greatest(0.0, least(1.0, value / 100)) AS confidence FROM events WHERE event_type IN ('click', 'view') AND value IS NOT NULL")
def x31(spark, d):
    kept = table(spark, d, "events").filter(F.col("event_type").isin("click", "view") & F.col("value").isNotNull())
    return kept.select("event_id", "event_type", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100)).alias("confidence"))


@query("g26_why_it_belongs", "SELECT s_suppkey, s_name || ' -> ' || n_name || ' -> ' || r_name AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def g26(spark, d):
    t = lambda n: table(spark, d, n)
    joined = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("s_suppkey", F.concat_ws(" -> ", "s_name", "n_name", "r_name").alias("path"))


@query("v16_context", f"""WITH {CALLS_SQL}, q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 5), h AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 4) AS score
  FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 3) SELECT vec_id, source_id AS caller FROM (SELECT vec_id, source_id, row_number() OVER (PARTITION BY vec_id ORDER BY source_id) AS rn FROM h JOIN calls ON target_id = 'method://p' || vec_id) WHERE rn <= 5""")
def v16(spark, d):
    e = table(spark, d, "embeddings")
    hits = nearest_to(e, 5, 3, "vec_id", "embedding")
    near = calls(spark, d).join(F.broadcast(hits.select("vec_id", F.concat(F.lit("method://p"), "vec_id").alias("target_id"))), "target_id")  # three rows
    return near.withColumn("rn", F.row_number().over(W.partitionBy("vec_id").orderBy("source_id"))).filter("rn <= 5").select("vec_id", F.col("source_id").alias("caller"))


@query("o5_after_deletion", "SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 0 AND conv_id % 3 = 0)")
def o5(spark, d):
    c = table(spark, d, "conversations")
    return c.join(c.filter("turn = 0 AND conv_id % 3 = 0").select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", "turn", "role")


@query("n16_top_per_target", "SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 3")
def n16(spark, d):
    w = W.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")  # ranked with a limit: Spark keeps three rows of each lang before it shuffles
    return table(spark, d, "documents").select("lang", "doc_id", "n_chars", F.row_number().over(w).alias("rn")).filter("rn <= 3").drop("rn")
