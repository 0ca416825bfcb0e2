"""Merges by key, node-link documents, annotated mapper statements, bottom-up texts and searches of many questions."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from loomgraph.functions.ids import uri_local
from loomgraph.functions import predicates, text
from loomgraph.operators import batch_search, propagate, semantic
from loomgraph.sources import code, dynamic_sql, merge, node_link
from loomgraph.store import listed, scope, shared_dir, staged
from loomgraph.streaming.upserts import follow_merged


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


SCHEMA = "k string, at int, tags map<string, string>"


def test_merge_by_key(spark, tmp_path):
    root, make = str(tmp_path / "t"), lambda r: spark.createDataFrame(r, SCHEMA)
    schema = make([]).schema
    assert rows(merge.read_merged(spark, root, schema)) == []
    first = make([("a", 1, {"x": "1"}), (None, 1, None), ("b", 2, {"y": "2"}), (None, 3, {"n": "3"})])
    assert merge.merge_batch(spark, root, first, ["k"], 0, "at", buckets=8)
    assert rows(merge.read_merged(spark, root, schema)) == sorted([("a", 1, {"x": "1"}), ("b", 2, {"y": "2"}), (None, 3, {"n": "3"})], key=str)
    second = make([("a", 0, {"x": "old"}), ("b", 2, {"y": "same"}), ("c", 1, None), (None, 4, {})])
    assert rows(merge.with_created(second, merge.read_merged(spark, root, schema), ["k"])) == sorted([("a", False), ("b", False), ("c", True), (None, False)], key=str)
    assert merge.merge_batch(spark, root, second, ["k"], 1, "at")
    want = sorted([("a", 1, {"x": "1"}), ("b", 2, {"y": "same"}), ("c", 1, None), (None, 4, {})], key=str)
    assert rows(merge.read_merged(spark, root, schema)) == want
    assert not merge.merge_batch(spark, root, make([("z", 9, None)]), ["k"], 1, "at")  # merged before
    assert rows(merge.read_merged(spark, root, schema)) == want
    for number in range(2, 6):
        merge.merge_batch(spark, root, make([("a", number, {})]), ["k"], number, "at")
    manifest = json.loads((tmp_path / "t" / "manifests" / "5").read_text())
    kept = [x for x in listed(spark, root) if x.startswith("data-")]
    assert len(listed(spark, f"{root}/manifests")) == 2 and set(manifest["buckets"].values()) <= set(kept) and len(kept) <= 4
    assert [r for r in rows(merge.read_merged(spark, root, schema)) if r[0] == "a"] == [("a", 5, {})]
    merge.merge_batch(spark, root, make([("long key", 1, None)]), ["k"], 6, "at", most_chars={"k": 4})
    assert "long" in {r[0] for r in rows(merge.read_merged(spark, root, schema))}


def test_inferred_edges_merge_without_doubles(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", "calls", True), ("a", "b", "calls", True), ("a", "c", "calls", False)], "source_id string, target_id string, rel_type string, inferred boolean")
    batch, key = merge.inferred_edges_table(edges), ["source_id", "target_id", "rel_type"]
    for number in (0, 1):
        merge.merge_batch(spark, str(tmp_path / "e"), batch, key, number)
    assert rows(merge.read_merged(spark, str(tmp_path / "e"), batch.schema)) == [("a", "b", "calls", True)]


def test_streamed_merge_and_upsert_of_maps(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    for batch in ([("a", 1, {"x": "1"}), (None, 1, None)], [("a", 2, None)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(str(tmp_path / "in"))
        follow_merged(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), ["k"], str(tmp_path / "ck"), "at").awaitTermination()
    assert rows(merge.read_merged(spark, str(tmp_path / "out"), schema)) == [("a", 2, None), (None, 1, None)]
    old, new = spark.createDataFrame([(None, 1, {"x": "1"})], SCHEMA), spark.createDataFrame([(None, 2, {"x": "2"}), ("b", 1, {})], SCHEMA)
    assert rows(code.upsert(old, new, ["k"])) == sorted([(None, 2, {"x": "2"}, False), ("b", 1, {}, True)], key=str)


def test_node_link_round_trip(spark, tmp_path):
    nodes = [(f"n{i}", f"name {i} }}", {"deep": {"a": i}}) for i in range(50)]
    n = spark.createDataFrame([(a, b, c["deep"]) for a, b, c in nodes], "id string, name string, attributes map<string, int>")
    e = spark.createDataFrame([("n1", "n2", "calls"), ("n1", "n2", "calls"), ("n3", "n4", "uses"), ("n3", "n4", "uses")], "source_id string, target_id string, rel_type string")
    node_link.write_node_link(n, e, str(tmp_path / "s"), "v7", parts=3)
    document = json.loads("\n".join(p.read_text() for p in sorted((tmp_path / "s" / "graph.json").glob("part-*"))))
    assert len(document["nodes"]) == 50 and len(document["links"]) == 4 and document["multigraph"]
    back_n, back_e, meta = node_link.read_node_link(spark, str(tmp_path / "s"), "id string, name string, attributes map<string, int>")
    assert rows(back_n) == rows(n) and rows(back_e.select("source_id", "target_id", "rel_type")) == rows(e)
    assert json.loads(meta) == {"version": "v7", "nodes": 50, "edges": 4}
    other = {"directed": True, "multigraph": True, "graph": {}, "nodes": [{"entity_type": "method", "attrs": {"k": [1, {"x": "}\n    }"}]}, "id": "a"}, {"id": "订单"}], "links": [{"rel_type": "calls", "source": "a", "target": "订单", "key": 0}]}
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "graph.json").write_text(json.dumps(other, indent=2, ensure_ascii=False))
    (tmp_path / "o" / "meta.json").write_text("{}")
    n, e, _ = node_link.read_node_link(spark, str(tmp_path / "o"))
    assert sorted(r["id"] for r in n.collect()) == ["a", "订单"] and rows(e.select("source_id", "target_id", "rel_type", "key")) == [("a", "订单", "calls", 0)]
    empty = spark.createDataFrame([], "id string"), spark.createDataFrame([], "source_id string, target_id string, rel_type string")
    node_link.write_node_link(*empty, str(tmp_path / "e"))
    assert json.loads("\n".join(p.read_text() for p in sorted((tmp_path / "e" / "graph.json").glob("part-*"))))["nodes"] == []


ORDER_XML = """<mapper namespace="a.Order">
<sql id="cols">id, name <include refid="b.Base.extra"/></sql>
<sql id="self">x <include refid="self"/> y</sql>
<select id="q">SELECT <include refid="cols"/> FROM t
  <where><if test="id != null">AND id = #{id}</if><choose><when test="n &gt; 1">n</when><otherwise>m</otherwise></choose></where>
  <foreach collection="ids" item="i" separator="," open="(" close=")">#{i}</foreach> END</select>
<update id="u">UPDATE t <set>a = 1</set><trim prefix="(" suffix=")">b</trim><bind name="p" value="v"/><foreach collection="l">z</foreach><odd> kept </odd>tail</update>
<insert id="i"><selectKey keyProperty="id">SELECT 1</selectKey>INSERT <include refid="gone"/></insert>
<delete id="d">DELETE <include refid="self"/></delete></mapper>"""
BASE_XML = '<mapper namespace="b.Base"><sql id="extra">, extra</sql></mapper>'


def test_annotated_statements(spark):
    files = spark.createDataFrame([(ORDER_XML,), (BASE_XML,), (None,), ("<broken",)], "text string")
    got = {r["statement_id"]: (r["sql"].split("\n"), r["missing"]) for r in dynamic_sql.annotated_statements(files).collect()}
    assert got["q"] == (
        ["SELECT", "-- [引用 SQL 片段] cols", "  id, name", "  -- [引用 SQL 片段] b.Base.extra", "    , extra", "FROM t", "WHERE", "  -- [条件] 当 id != null 时:", "    AND id = #{id}", "  -- [分支选择]:", "    -- [当 n > 1]:", "      n",
         "    -- [否则]:", "      m", "-- [循环] 遍历 ids 中的每个 i，以 ',' 分隔，包裹在 (...) 中:", "  #{i}", "END"], [],
    )
    assert got["u"] == (["UPDATE t", "SET", "  a = 1", "(", "b", ")", "-- [变量绑定] p = v", "-- [循环] 遍历 l 中的每个 item:", "  z", "kept", "tail"], [])
    assert got["i"] == (["-- [主键生成] id", "  SELECT 1", "INSERT", "-- [引用 SQL 片段] gone"], ["a.Order.gone"])
    assert got["d"] == (["DELETE", "-- [引用 SQL 片段] self", "  x", "  -- [引用 SQL 片段] self", "  y"], [])
    plain = {r["statement_id"]: r["sql"] for r in dynamic_sql.annotated_statements(files, with_includes=False).collect()}
    assert plain["d"] == "DELETE\n-- [引用 SQL 片段] self"
    assert dynamic_sql.annotated_statements(files.limit(0)).count() == 0


def test_bottom_up_texts(spark, tmp_path):
    methods = spark.createDataFrame([(x, f"name{x}", f"code {x}") for x in "abcde"] + [(f"z{i:03}", "n", "leaf") for i in range(200)], "id string, name string, code string")
    calls = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "b"), ("b", "d"), ("e", "e"), ("a", "gone")] + [("e", f"z{i:03}") for i in range(200)], "source_id string, target_id string")
    write = lambda c, callees: F.when(callees == "", F.upper(c)).otherwise(F.concat(c, F.lit("{"), callees, F.lit("}")))
    store = str(tmp_path / "texts")
    got = {r["id"]: (r["level"], r["text"]) for r in propagate.write_bottom_up(methods, calls, write, store, budget=60).collect()}
    assert got["d"] == (0, "CODE D") and got["c"] == (1, "CODE C") and got["b"] == (1, "code b{- named: CODE D}") and got["a"] == (2, "code a{- nameb: code b{- named: CODE D}}")
    assert got["e"] == (1, "code e{" + "\n".join(["- n: LEAF"] * 6 + ["- ... 还有 194 个方法省略"]) + "}")
    (tmp_path / "texts" / "level=2" / "_SUCCESS").unlink()  # as if the run was cut there
    assert {r["id"]: (r["level"], r["text"]) for r in propagate.write_bottom_up(methods, calls, write, store, budget=60).collect()} == got
    never = lambda c, callees: F.lit("again")
    assert {r["text"] for r in propagate.write_bottom_up(methods, calls, never, store, budget=60).collect()} == {t for _, t in got.values()}
    assert propagate.write_bottom_up(methods.limit(0), calls, write, str(tmp_path / "none")).count() == 0


def test_search_of_many_questions(spark):
    rng = np.random.default_rng(0)
    vectors = [(f"m{i % 40}", "api" if i % 3 else "class", rng.normal(size=8).tolist()) for i in range(120)] + [("m1", "api", None), ("m2", "api", [0.0] * 8), ("m3", "api", [1.0]), (None, "api", [1.0] * 8)]
    questions = [(f"q{i}", rng.normal(size=8).tolist()) for i in range(7)] + [("none", None)]
    v, q = spark.createDataFrame(vectors, "id string, level string, vector array<double>").repartition(3), spark.createDataFrame(questions, "item string, vector array<double>")

    def plain(rows_, k):
        out = []
        for item, x in questions:
            best = {}
            for id_, _, y in rows_:
                if id_ is not None:
                    fit = x is not None and y is not None and len(y) == 8 and np.linalg.norm(y) > 1e-9
                    score = round(float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))), 4) if fit else 0.0
                    best[id_] = max(best.get(id_, -2), score)
            out += [(item, id_, s) for id_, s in sorted(best.items(), key=lambda b: (-b[1], b[0]))[:k]]
        return sorted(out, key=str)

    assert rows(batch_search.search_many(v, q, 5)) == plain(vectors, 5)
    assert rows(batch_search.search_many(v, q, 4, F.col("level") == "api", at_once=3)) == plain([x for x in vectors if x[1] == "api"], 4)
    some = spark.createDataFrame([("m1",), ("m7",)], "id string")
    assert rows(batch_search.search_many(v, q, 4, ids=some)) == plain([x for x in vectors if x[0] in ("m1", "m7")], 4)
    assert rows(batch_search.search_many(v, q, 2, F.col("level") == "gone")) == plain(vectors, 2)  # the filter leaves none
    assert rows(batch_search.search_many(v.limit(0), q, 2)) == [] and rows(batch_search.search_many(v, q.limit(0), 2)) == []
    texts = spark.createDataFrame([("method//a", "API ", [1.0, 0.0]), ("method://a", "api", [0.0, 1.0]), ("class//b", "api", [0.0, 1.0]), ("method://c", "class", [0.0, 1.0])], "id string, level string, vector array<double>")
    assert rows(batch_search.business_hits(texts, spark.createDataFrame([("q", [0.0, 2.0])], "item string, vector array<double>"), 3)) == [("q", "method://a", 1.0)]


def test_mended_functions(spark):
    json_of = lambda s: one(spark, text.json_of(F.lit(s)))
    assert json_of('first {"a": 1} then {"b": 2}') is None and json_of("see {x} here") is None and json_of('say: {"a": [1]} ') == '{"a": [1]}' and json_of('```json\n[1, 2]\n```') == "[1, 2]" and json_of("") is None
    assert [one(spark, text.class_role(F.lit(x))) for x in ("OrderFacade", "OrderManager", "OrderServiceImpl", "OrderDao", "A")] == ["Service", "Service", "Other", "Repository", "Other"]
    assert one(spark, text.simple_type(F.lit("java.util.Map<String, java.util.List<a.B>>"))) == "Map" and one(spark, text.simple_type(F.lit("a.b.C []"))) == "C[]"
    assert one(spark, text.one_line(F.lit("x" * 2000), 1200)) == "x" * 1199 + "…" and one(spark, text.one_line(F.lit(" a \n b "), 3)) == "a b"
    assert one(spark, uri_local(F.lit("method://a.B#c"))) == "method___a.B_c"
    from loomgraph.functions import lexical

    assert one(spark, lexical.query_terms(F.lit("订单　取消"))) == ["订单", "取消"]
    assert one(spark, predicates.is_source_path(F.lit("m/target/apt/A.java"))) and not one(spark, predicates.is_source_path(F.lit("m/target/generated-sources/site/A.java")))
    assert one(spark, predicates.is_code_type(F.lit("Api_Endpoint"))) and not one(spark, predicates.is_code_type(F.lit("term")))
    methods = spark.createDataFrame([("1", "/order/pay", "X"), ("2", "/none", "OrderController"), ("3", "/none", "Order")], "id string, path string, class_name string")
    assert rows(semantic.capability_links(methods, [("orders", "/order/**"), ("pay", "pay"), ("", "")])) == [("1", "orders", "path_match", 0.9), ("1", "pay", "path_match", 0.9), ("2", "orders", "class_naming", 0.5)]


def test_scopes_remove_their_tables(spark):
    root = shared_dir(spark)
    before = set(listed(spark, root))
    with scope(spark):
        first = staged(spark.range(3), "a")
        with scope(spark):
            inner = staged(first, "b")
            kept = staged(inner.filter("id > 0"), "c", keep=True)
        assert kept.count() == 2
        out = staged(kept, "d", keep=True)
    assert sorted(r["id"] for r in out.collect()) == [1, 2]
    new = set(listed(spark, root)) - before
    assert len(new) == 1 and new.pop().startswith("d-")
