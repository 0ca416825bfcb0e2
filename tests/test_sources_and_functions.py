from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomgraph.functions import ids, text, vectors
from loomgraph.sources import code
from loomgraph.streaming.upserts import follow


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_stable_ids(spark):
    assert one(spark, ids.stable_id("package", F.lit("com.mall.admin.service"))) == "package//980f7116f14e"
    assert one(spark, ids.stable_id("class", F.lit("a/B.java"), F.lit("B"))) == "class//6992c7606af6"
    assert one(spark, ids.stable_id("class", F.lit(None), F.lit("Foo"))) == "class//1081724d8d39"


def test_id_spellings(spark):
    assert one(spark, ids.method_id(F.lit("method//abc12"))) == "method://abc12"
    assert set(one(spark, ids.method_id_variants(F.lit("method//abc12")))) == {"method//abc12", "method://abc12"}
    assert one(spark, ids.method_id_variants(F.lit("class//a"))) == ["class//a"]


def test_lexical(spark):
    flat = text.soft_tokens(F.lit("cancelTimeOutOrder"))
    assert one(spark, text.whole_word(F.lit("order"), flat)) and not one(spark, text.whole_word(F.lit("or"), flat))
    assert one(spark, text.whole_word(F.lit("or"), text.soft_tokens(F.lit("or callback"))))
    assert "order" in one(spark, text.identifier_tokens(F.lit("order_globalXMLNode")))
    assert one(spark, text.sql_tables(F.lit("select * from A.b x join c on 1 update D set"))) == ["a.b", "c", "d"]
    assert one(spark, text.without_thoughts(F.lit(" <think>a\nb</think>\tx "))) == "x"


def test_cosine_of_odd_vectors(spark):
    v = lambda *x: F.array(*(F.lit(float(y)) for y in x))
    assert one(spark, vectors.cosine(v(1, 0), v(1, 0))) == 1.0
    assert one(spark, vectors.cosine(v(0, 0), v(1, 0))) == 0.0
    assert one(spark, vectors.cosine(v(1), v(1, 0))) == 0.0
    assert one(spark, vectors.hash_embedding(F.lit(" \t"))) == [0.0] * 64


def test_facts_snapshot_and_upsert(spark, tmp_path):
    facts = {"entities": [{"id": "m", "type": "method", "name": "f", "attributes": {"signature": "f()"}}], "relations": [{"type": "calls", "source_id": "m", "target_id": "n"}], "meta": {}}
    (tmp_path / "facts.json").write_text(json.dumps(facts))
    nodes, edges = code.read_facts(spark, str(tmp_path / "facts.json"))
    code.write_snapshot(nodes, edges, str(tmp_path / "snap"), "v1")
    n, e, meta = code.read_snapshot(spark, str(tmp_path / "snap"))
    assert (n.count(), e.first()["target_id"], meta.first()["version"]) == (1, "n", "v1")
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in code.upsert(old, new, ["k"]).select("k", "v", "created").collect()} == {(1, "a", False), (2, "c", False), (3, "d", True)}


def test_ddl_and_mapper(spark):
    ddl = "CREATE TABLE `t` (id bigint, price decimal(10,2) NOT NULL, PRIMARY KEY (id));"
    files = spark.createDataFrame([(ddl,), (None,)], "text string")
    assert [(r["column"], r["type"]) for r in code.ddl_columns(files).orderBy("ordinal").collect()] == [("id", "bigint"), ("price", "decimal(10,2)")]
    odd = "create table if not exists shop (`key` int comment 'a (b', price decimal(10, 2), \"order\" text, KEY k (price)); create table u (x int)"
    found = code.ddl_columns(spark.createDataFrame([(odd,)], "text string")).orderBy("table", "ordinal").collect()
    assert [(r["table"], r["column"], r["type"]) for r in found] == [("shop", "key", "int"), ("shop", "price", "decimal(10, 2)"), ("shop", "order", "text"), ("u", "x", "int")]
    xml = '<mapper namespace="a.B"><select id="q">SELECT 1 <if test="x">FROM t</if> END</select><update id="e"></update></mapper>'
    files = spark.createDataFrame([(xml,), ("<broken",)], "text string")
    assert [r["sql"] for r in code.mapper_statements(files).collect()] == ["SELECT 1 FROM t END"]
    assert [r["sql"] for r in code.mapper_statements(files, whole=False).collect()] == ["SELECT 1"]


def test_source_files(spark, tmp_path):
    (tmp_path / "m" / ".git").mkdir(parents=True)
    (tmp_path / "m" / "A.java").write_text("class A {}")
    (tmp_path / "m" / ".git" / "B.java").write_text("x")
    rows = code.source_files(spark, str(tmp_path), "*.java").collect()
    assert [(r["language"], r["text"]) for r in rows] == [("java", "class A {}")]


def test_streamed_upserts(spark, tmp_path):
    schema = spark.createDataFrame([], "k int, v string").schema
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
    for batch in ([(1, "a"), (2, "b")], [(2, "c")]):
        put(batch)
        follow(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), ["k"], str(tmp_path / "ck")).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "v1")).collect()} == {(1, "a"), (2, "c")}
    put([(1, "b"), (1, "d"), (1, "c")])  # of equal keys the last wins
    follow(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), ["k"], str(tmp_path / "ck")).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "v2")).collect()} == {(1, "d"), (2, "c")}


def test_sinks_and_orphans(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("m", "method")], "id string, entity_type string"), spark.createDataFrame([("m", "n")], "source_id string, target_id string")
    code.write_facts(nodes, edges, str(tmp_path / "facts"))
    assert spark.read.json(str(tmp_path / "facts" / "entities")).first()["id"] == "m" and spark.read.json(str(tmp_path / "facts" / "relations")).first()["target_id"] == "n"
    code.write_stats(nodes, edges, str(tmp_path / "stats"))
    assert tuple(spark.read.json(str(tmp_path / "stats")).select("nodes", "edges").first()) == (1, 1)
    stored = spark.createDataFrame([("m", 1), ("gone", 2)], "id string, v int")
    assert [r["id"] for r in code.without_orphans(stored, nodes, "id").collect()] == ["m"]


def test_question_terms(spark):
    from loomgraph.functions import lexical

    assert one(spark, lexical.query_terms(F.lit("请问 OrderService 的订单取消和退款流程是什么？"))) == ["orderservice", "订单取消", "退款流程是什么"]
    long = one(spark, lexical.query_terms(F.lit("甲乙丙丁戊己庚辛壬癸子丑寅")))
    assert long[:2] == ["甲乙", "乙丙"] and "甲乙丙" in long and len(long) == 12 + 11
    assert one(spark, lexical.query_terms(F.lit(None).cast("string"))) == []
    noise = lambda t, q: one(spark, lexical.is_noise(F.lit(t), F.lit(q), ["get", "order"], ["order"]))
    assert noise("get", "how to cancel") and not noise("get", "how to get it") and not noise("order", "x") and not noise("订单", "x")


def test_paths_and_ids(spark):
    from loomgraph.operators import walk
    from loomgraph.operators.traverse import bfs

    calls = spark.createDataFrame([("a", "i"), ("impl1", "b"), ("impl2", "get"), ("get", "c")], "source_id string, target_id string")
    start = spark.createDataFrame([("a", "a")], "start_id string, node_id string")
    paths = {r["node_id"]: r["path"] for r in walk.with_paths(bfs(calls, start)).collect()}
    assert paths == {"a": ["a"], "i": ["a", "i"]}
    far = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "source_id string, target_id string")
    assert {r["node_id"]: r["path"] for r in walk.with_paths(bfs(far, start), most_steps=1).collect()}["d"] == ["a", "d"]
    known = spark.createDataFrame([("method//x",)], "id string"), spark.createDataFrame([("method://x",), ("method://y",)], "id string")
    asked = spark.createDataFrame([("method://x",), ("method//y",), ("z",)], "asked string")
    assert {tuple(r) for r in walk.resolve_ids(asked, *known).collect()} == {("method://x", "method//x"), ("method//y", "method://y"), ("z", "z")}
