"""Rules over structure facts on small cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import facts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def edges_of(spark, *rows_):
    return spark.createDataFrame(list(rows_), "source_id string, target_id string, rel_type string")


def test_meaningful_and_interface_methods(spark):
    methods = spark.createDataFrame([("method://a", "x", None, None), ("method//b", "", False, False), ("c", "y", True, False), ("d", "z", False, True), ("e", None, None, None)], "id string, code string, is_getter boolean, is_setter boolean")
    assert [r["id"] for r in facts.meaningful_methods(methods).collect()] == ["method://a"]
    nodes = spark.createDataFrame([("I", "Interface"), ("C", "class")], "id string, entity_type string")
    edges = edges_of(spark, ("method//a", "I", "BELONGS_TO"), ("method://b", "I", "belongs_to"), ("c", "C", "belongs_to"), ("d", "I", "calls"))
    assert sorted(r["id"] for r in facts.declared_on_interfaces(methods, nodes, edges).collect()) == ["method//b", "method://a"]
    assert sorted(r["id"] for r in facts.not_declared_on_interfaces(methods, nodes, edges).collect()) == ["c", "d", "e"]


def test_concepts(spark):
    nodes = spark.createDataFrame([("capability://pay",), ("term://pay",), ("domain://pay",), ("domain://only",), ("m",)], "id string")
    links = spark.createDataFrame([("pay", "m", "implemented_by", 0.9, "rule"), ("pay", "gone", "implemented_by", 0.8, "rule"), ("pay", "m", "related_to", 0.7, "x"), ("only", "m", "related_to", 0.6, "x"), ("none", "m", "related_to", 0.5, "x"), ("only", "gone", "related_to", 0.4, "x"), ("none", "m", "implemented_by", 0.3, "x")], "concept_id string, entity_id string, link_type string, confidence double, source string")
    assert rows(facts.concept_edges(links, nodes)) == sorted([("capability://pay", "m", "IMPLEMENTED_BY", 0.9, "rule"), ("capability://pay", "gone", "IMPLEMENTED_BY", 0.8, "rule"), ("term://pay", "m", "RELATED_TO", 0.7, None), ("domain://only", "m", "RELATED_TO", 0.6, None)], key=str)


def test_templates(spark):
    templates = spark.createDataFrame([("t1", "method//a", None, None), ("t2", None, "x.OrderMapper", "Find"), ("t3", "method://a", "OrderMapper", "find")], "template_id string, method_id string, class_name string, method_name string")
    methods = spark.createDataFrame([("method://a", "a.b.ordermapper", "find", None, None), ("b", None, None, "List<x> y.FIND(int a)", "src\\OrderMapper.java:12"), ("c", "OrderMapper", None, "find", None), ("d", "", "find", None, None)], "id string, class_name string, name string, signature string, location string")
    assert rows(facts.templates_of_methods(templates, methods)) == [("b", "t2"), ("b", "t3"), ("method://a", "t1"), ("method://a", "t2"), ("method://a", "t3")]


def test_services(spark):
    entities = spark.createDataFrame([("C1", "class", "m1", None, "m2"), ("C2", "Interface", "m1", None, "m1"), ("C3", "class", "zz", None, "new"), ("C4", "class", "new", None, "m1"), ("f", "method", "m1", "/pay", None), ("g", "method", "zz", "/x", None), ("h", "method", "m1", "", None), ("E", "enum", "m2", None, "m1")], "id string, entity_type string, module_id string, path string, feign_target string")
    nodes, edges = facts.service_facts(entities, spark.createDataFrame([("m1",), ("m2",), ("m1",)], "id string"))
    assert rows(nodes) == sorted([("service://m1", "service", "m1"), ("service://m2", "service", "m2"), ("service://new", "service", "new"), ("api_endpoint://f", "api_endpoint", "/pay"), ("api_endpoint://g", "api_endpoint", "/x")], key=str)
    s = "service://"
    assert rows(edges) == sorted([("C1", s + "m1", "belongs_to"), ("C2", s + "m1", "belongs_to"), ("E", s + "m2", "belongs_to"), (s + "m1", "api_endpoint://f", "service_exposes"), ("C1", s + "m2", "binds_to_service"), ("C2", s + "m1", "binds_to_service"), ("C3", s + "new", "binds_to_service"), ("C4", s + "m1", "binds_to_service"), (s + "m1", s + "m2", "service_calls"), (s + "new", s + "m1", "service_calls")], key=str)


def test_entries_modules_and_overloads(spark):
    methods = spark.createDataFrame([("1", "/a", "m", "C", "f"), ("2", "/a", "m", "C", "f"), ("3", "/b", None, "C", "g"), ("4", " ", "m", "D", "f"), ("5", None, "m", "D", "f")], "id string, path string, module_id string, class_name string, name string")
    assert [tuple(r) for r in facts.entry_paths(methods).collect()] == [("/a（m）", 2), ("/b", 1)]
    asked = spark.createDataFrame([("C", "f"), ("C", "f"), ("X", "f")], "class_name string, name string")
    assert rows(facts.methods_named(methods, asked)) == [("C", "f", ["1", "2"])]
    nodes = spark.createDataFrame([("Method", "b"), ("class", "a"), ("field", "a"), ("class", None), ("interface", "b")], "entity_type string, module_id string")
    assert [tuple(r) for r in facts.ranked_modules(nodes).collect()] == [("b", 2), ("a", 1)]
    modules = spark.createDataFrame([("Order-A", " Trade "), ("order-b", "Other"), (None, "Trade")], "id string, business_domain string")
    assert rows(facts.modules_of_domain(modules, "Trade", "ORDER").select("id")) == [("Order-A",)] and facts.modules_of_domain(modules, None, None).count() == 3


def test_methods_for_tables(spark):
    ids = [f"method://{x}" for x in "abcdef"]
    nodes = spark.createDataFrame([(i, None) for i in ids] + [("k", "class"), ("term://t", "term")], "id string, entity_type string")
    edges = edges_of(spark, (ids[2], ids[0], "calls"), (ids[2], ids[1], "calls"), ("k", ids[0], "contains"), (ids[3], "k", "uses"), (ids[4], ids[0], "implements"), ("term://t", ids[0], "related_to"), (ids[5], ids[3], "calls"), (ids[0], ids[1], "calls"))
    accesses = spark.createDataFrame([("t", ids[1], "select", 1), ("t", ids[0], "update", 2), ("t", ids[0], "select", 3), ("t", "gone", "select", 0)], "table string, method_id string, op string, ordinal int")
    got = rows(facts.methods_for_tables(accesses, edges, nodes, max_hops=2))
    assert got == sorted([("t", ids[1], "select", 0, ids[1]), ("t", ids[0], "update", 0, ids[0]), ("t", ids[0], "select", 0, ids[0]), ("t", ids[2], "select", 1, ids[1]), ("t", ids[3], "update", 2, ids[0])], key=str)
    assert {r[1] for r in rows(facts.methods_for_tables(accesses, edges, nodes, "write", 8))} == {ids[0], ids[2], ids[3], ids[5]}


def test_code_with_sql(spark):
    methods = spark.createDataFrame([("a", "code a"), ("b", None), ("c", "code c")], "id string, code string")
    statements = spark.createDataFrame([("a", "SELECT 1"), ("b", "SELECT 2"), ("c", "")], "id string, sql string")
    tables = spark.createDataFrame([("a", 2, "u"), ("a", 1, "t"), ("a", 3, "gone")], "id string, ordinal int, table string")
    ddl = spark.createDataFrame([("t", "CREATE t"), ("u", "CREATE u")], "table string, definition string")
    assert rows(facts.code_with_sql(methods, statements, tables, ddl)) == [("a", "code a\n\n-- [MyBatis SQL]\nSELECT 1\n\n-- [表结构 t]\nCREATE t\n\n-- [表结构 u]\nCREATE u"), ("b", "-- [MyBatis SQL]\nSELECT 2"), ("c", "code c")]


def test_patterns_sessions_and_contexts(spark):
    answers = spark.createDataFrame([("s", " Design ", "Factory", "1.7", " it makes ", ["a", "", None, "b"], None), ("s", "design", "Layers", "0.5", "x", None, None), ("s", "architecture", "Layers", "oops", "x", None, "n"), ("s", "architecture", "Layers", "-1", " ", None, None), ("s", "odd", "Factory", "1", "x", None, None), ("s", "design", "Factory", "NaN", "y", None, None)], "scope string, pattern_type string, pattern_name string, confidence string, summary string, entity_ids array<string>, notes string")
    got = rows(facts.valid_patterns(answers, {"design": ["Factory"], "architecture": ["Layers"]}))
    assert got == sorted([("s", "design", "Factory", 1.0, "it makes", ["a", "b"], ""), ("s", "architecture", "Layers", 0.0, "x", [], "n"), ("s", "design", "Factory", 0.0, "y", [], "")], key=str)
    sessions, messages = spark.createDataFrame([(1, "u"), (2, "v")], "session_id int, user_id string"), spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "session_id int, created_at int, text string")
    assert [r["text"] for r in facts.session_detail(sessions, messages, 1, "u").collect()] == ["a", "b"] and facts.session_detail(sessions, messages, 2, "u").count() == 0
    hits = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.7)], "id string, score double")
    edges = edges_of(spark, ("a", "x", "calls"), ("a", "x", "uses"), ("a", "w", "calls"), ("y", "a", "calls"), ("b", "t1", "accesses_table"), ("c", "z", "calls"))
    assert [tuple(r) for r in facts.retrieved_contexts(hits, edges, 2, 1).orderBy("id").collect()] == [("a", 0.9, ["w"], ["y"], []), ("b", 0.8, ["t1"], [], ["t1"]), ("c", 0.7, None, None, None)]


def test_summaries(spark):
    cases = {"[摘要] short \n[详情] long": "short", "[摘要]one\ntwo": "one", "x [摘要]\n[详情]d": "x [摘要]", "abc\n  ## Title of it\nrest": "Title of it", "ab": "ab", "": "", "[摘要] " + "y" * 80: "y" * 50}
    for raw, want in cases.items():
        assert spark.range(1).select(text.summary_of(F.lit(raw)).alias("s")).first()["s"] == want, raw
