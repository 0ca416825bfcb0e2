"""Vectors, lexical functions and identifiers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import ids as I
from loomgraph.functions import text as X
from loomgraph.functions import vectors as V
from loomgraph.operators import retrieval as R
from loomgraph.queries._registry import query
from loomgraph.session import table

_COSINE = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query("v1_cosine_pairs", f"SELECT a.vec_id, round({_COSINE}, 4) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def v1(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("next")), 4).alias("score"))


@query("v2_top_k", f"SELECT a.vec_id, round({_COSINE}, 4) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 3 ORDER BY score DESC, a.vec_id LIMIT 10")
def v2(spark, d):
    e = table(spark, d, "embeddings")
    return R.nearest_to(e, 3, 10, "vec_id", "embedding")


@query("v7_rejected_sizes", "SELECT label, count(*) FILTER (len(embedding) >= 64) AS fit, count(*) FILTER (len(embedding) < 64) AS rejected FROM embeddings GROUP BY 1")
def v7(spark, d):
    size = F.size("embedding")
    return table(spark, d, "embeddings").groupBy("label").agg(F.count_if(size >= 64).alias("fit"), F.count_if(size < 64).alias("rejected"))


@query("v6_hash_embedding", """WITH h AS (SELECT item_id, sha256(text) AS h FROM benchmark), x AS (SELECT item_id, unnest(range(64)) AS i, h FROM h),
  y AS (SELECT item_id, i, CASE WHEN (2 * i + 4) % 64 + 4 > (2 * i) % 64 THEN substr(h, (2 * i) % 64 + 1, (2 * i + 4) % 64 + 4 - (2 * i) % 64) ELSE '0' END AS s FROM x),
  z AS (SELECT item_id, i, (('0x' || s)::BIGINT % 10000) / 5000.0 - 1 AS v FROM y), n AS (SELECT item_id, sqrt(sum(v * v)) AS norm FROM z GROUP BY 1)
  SELECT item_id, round(max(v / norm), 4) AS largest, round(min(v / norm), 4) AS smallest FROM z JOIN n USING (item_id) GROUP BY 1""")
def v6(spark, d):
    e = table(spark, d, "benchmark").select("item_id", V.hash_embedding(F.col("text")).alias("v"))
    return e.select("item_id", F.round(F.array_max("v"), 4).alias("largest"), F.round(F.array_min("v"), 4).alias("smallest"))


@query("v8_search_joined", f"SELECT a.vec_id, a.label, d.lang, round({_COSINE}, 4) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = 11 LEFT JOIN documents d ON d.doc_id = a.vec_id ORDER BY score DESC, a.vec_id LIMIT 20")
def v8(spark, d):
    e = table(spark, d, "embeddings")
    hits = R.nearest_to(e, 11, 20, "vec_id", "embedding")
    return hits.join(e.select("vec_id", "label"), "vec_id").join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id", "left").select("vec_id", "label", "lang", "score")


@query("v15_batch_recall", f"""SELECT item, vec_id, score FROM (SELECT b.vec_id AS item, a.vec_id, round({_COSINE}, 4) AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY round({_COSINE}, 4) DESC, a.vec_id) AS rn
  FROM embeddings a JOIN embeddings b ON b.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) WHERE rn <= 3""")
def v15(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return R.top_k_of_queries(e, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("item"), F.col("embedding").alias("q")), 3, "vec_id", "embedding")


_FLAT = "' ' || trim(regexp_replace(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g')) || ' '"


@query("x9_hybrid_rerank", f"""SELECT doc_id AS id, round((n_chars % 100) / 100.0 + 0.42 * ((contains({_FLAT.format('text')}, ' the ')::INT + contains({_FLAT.format('text')}, ' que ')::INT + contains({_FLAT.format('text')}, ' ist ')::INT) / 3.0)
  + 0.28 * ((contains({_FLAT.format('source')}, ' the ')::INT + contains({_FLAT.format('source')}, ' que ')::INT + contains({_FLAT.format('source')}, ' ist ')::INT) / 3.0), 6) AS score FROM documents ORDER BY score DESC, id LIMIT 50""")
def x9(spark, d):
    hits = table(spark, d, "documents").select(F.col("doc_id").alias("id"), ((F.col("n_chars") % 100) / 100.0).alias("score"), "text", F.col("source").alias("ident"))
    return R.rerank(hits, ["the", "que", "ist"], 50)


@query("x1_identifier_tokens", "SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(replace(p_type, ' ', '_') || p_size, '([A-Z]+|[a-z]+|[0-9]+)', 1), lambda t: lower(t)), ' ') AS tokens FROM part")
def x1(spark, d):
    ident = F.concat(F.regexp_replace("p_type", " ", "_"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", F.array_join(X.identifier_tokens(ident), " ").alias("tokens"))


@query("x6_soft_tokens", f"SELECT p_partkey, {_FLAT.format('p_type')} AS flat FROM part")
def x6(spark, d):
    return table(spark, d, "part").select("p_partkey", X.soft_tokens(F.col("p_type")).alias("flat"))


@query("x3_vocabulary", "SELECT lower(p_type) AS term, max(p_partkey) AS term_id FROM part GROUP BY 1")
def x3(spark, d):
    return table(spark, d, "part").groupBy(F.lower("p_type").alias("term")).agg(F.max("p_partkey").alias("term_id"))


@query("x2_term_matches", """SELECT doc_id, min(pos) AS first_at, word FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word, generate_subscripts(string_split(lower(text), ' '), 1) - 1 AS pos FROM documents)
  WHERE word IN ('the', 'of', 'que', 'der') GROUP BY doc_id, word""")
def x2(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.lower("text"), " ")).alias("pos", "word"))
    return words.filter(F.col("word").isin("the", "of", "que", "der")).groupBy("doc_id", "word").agg(F.min("pos").cast("long").alias("first_at")).select("doc_id", "first_at", "word")


@query("x17_method_ids", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'method://p' ELSE 'method://q' END || p_partkey AS id FROM part")
def x17(spark, d):
    raw = F.concat(F.when(F.col("p_partkey") % 2 == 0, "method//p").otherwise("method://q"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", I.method_id(raw).alias("id"))


@query("x18_schemes", "SELECT n_nationkey, 'domain://' || CASE WHEN n_name LIKE '%1%' THEN 'term://' ELSE '' END || n_name AS id FROM nation")
def x18(spark, d):
    raw = F.when(F.col("n_name").contains("1"), F.concat(F.lit("term://"), "n_name")).when(F.col("n_name").contains("2"), F.concat(F.lit("domain://"), "n_name")).otherwise(F.col("n_name"))
    return table(spark, d, "nation").select("n_nationkey", I.with_scheme(raw, "domain").alias("id"))


@query("x21_one_line", r"SELECT doc_id, CASE WHEN length(f) > 120 THEN substr(f, 1, 119) || '…' ELSE f END AS line FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') AS f FROM documents)")
def x21(spark, d):
    return table(spark, d, "documents").select("doc_id", X.one_line(F.col("text"), 120).alias("line"))


@query("x24_without_thoughts", r"SELECT doc_id, length(regexp_replace(text || 'x', '^\s+|\s+$', '', 'g')) AS size FROM documents")
def x24(spark, d):
    half = F.floor(F.length("text") / 2).cast("int")
    text = F.concat(F.lit("<think>a\nb</think>"), F.substr("text", F.lit(1), half), F.lit("<think>c</think>"), F.substr("text", half + 1), F.lit("x<think>d</think>"))
    return table(spark, d, "documents").select("doc_id", F.length(X.without_thoughts(text)).alias("size"))


@query("x26_bean_names", "SELECT n_nationkey, CASE WHEN regexp_matches(n_name, '^[A-Z]{2}') THEN n_name ELSE lower(substr(n_name, 1, 1)) || substr(n_name, 2) END AS bean FROM nation")
def x26(spark, d):
    return table(spark, d, "nation").select("n_nationkey", X.bean_name(F.col("n_name")).alias("bean"))


@query("x28_stable_ids", """SELECT p_partkey, 'class//' || substr(sha256(p_name || '|' || coalesce(p_brand, '')), 1, 12) AS id,
  substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS key FROM (SELECT *, sha256(p_name) AS h FROM part)""")
def x28(spark, d):
    return table(spark, d, "part").select("p_partkey", I.stable_id("class", F.col("p_name"), F.col("p_brand")).alias("id"), I.store_key(F.col("p_name")).alias("key"))


@query("n1_simple_types", "SELECT p_partkey, p_type || '[]' AS type FROM part")
def n1(spark, d):
    return table(spark, d, "part").select("p_partkey", X.simple_type(F.concat(F.lit("java.util."), "p_type", F.lit(" []<String, java.util.List<a."), "p_brand", F.lit(">>"))).alias("type"))
