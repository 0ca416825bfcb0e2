"""Contexts, lookups and functions on source text on hand-sized cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import code as C
from loomgraph.functions import lexical as L
from loomgraph.operators import context as X
from loomgraph.operators import lookup as K
from loomgraph.sources.code import domain_tables

METHODS = "id string, entity_type string, name string, module_id string, class_name string, signature string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_accessor_kinds(spark):
    rows = [("getA", "{ return a; }", "getter"), ("isA", "{return a;}", "getter"), ("getB", "{ return b; }", "none"), ("setA", "{ this.a = a; }", "setter"), ("setA", "{ return this; }", "none"), ("setA", "{ a = 1; b = 2; c = 3; }", "none"), ("getA", "", "none"), ("getA", None, "none"), ("get", "{ return a; }", "none")]
    df = spark.createDataFrame(rows, "name string, code string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", C.accessor_kind(F.col("name"), F.col("code"), F.array(F.lit("a"))).alias("got")).collect())
    assert one(spark, C.accessor_kind(F.lit("getA"), F.lit("{ return a; }"), F.lit(None).cast("array<string>"))) == "none"


def test_names_of_locations_and_signatures(spark):
    assert one(spark, C.mapper_class(F.lit(None).cast("string"))) == ""
    assert one(spark, C.mapper_class(F.lit("a\\b\\omsMAPPER.java:3"))) == "omsmapper"
    assert one(spark, C.method_name(F.lit(None).cast("string"), F.lit(None).cast("string"))) == ""
    assert one(spark, C.method_name(F.lit(""), F.lit("@A x.B a.b.Run(int i)"))) == "run"
    assert one(spark, C.endpoint_method(F.lit("#api"), F.lit(None).cast("string"))) is None
    assert one(spark, C.service_module(F.lit("service://"))) is None


def test_bean_context_stops_at_its_budget_and_takes_the_last_new(spark):
    codes = spark.createDataFrame([(1, "A x = new A(); B x = new B(); x.setName(1); x.getURL(); x.getName();"), (2, None), (3, "return x; x.getName();")], "id int, code string")
    comments = spark.createDataFrame([("B", "name", "n" * 10), ("B", "URL", "u" * 10), ("A", "name", "no")], "class_name string, field string, comment string")
    assert [tuple(r) for r in X.bean_contexts(codes, comments).collect()] == [(1, "B.name: " + "n" * 10 + "\nB.URL: " + "u" * 10)]
    assert [tuple(r) for r in X.bean_contexts(codes, comments, 20).collect()] == [(1, "B.name: " + "n" * 10)]


def test_expanded_terms(spark):
    terms = lambda q, base, *more: one(spark, L.expand_terms(F.lit(q), F.array(*map(F.lit, base)), *more))
    assert terms("取消订单 now", ["订单", "now"], ["订单超时", "取消订单", "库存"], [("订单", ["Order", "o", "单"]), ("库存", ["stock"])]) == ["订单", "now", "取消订单", "订单超时", "order", "单"]
    assert terms("abc", ["abc"], ["ab", "zz"], [], 1) == ["abc"]
    assert terms("", [""], [], []) == []


def test_hits_and_fallbacks(spark):
    ids = lambda df: [r["id"] for r in df.collect()]
    some = spark.createDataFrame([("b",), ("a",), ("a",)], "id string")
    assert ids(K.among_hits(some, spark.createDataFrame([("b", 0.1), ("z", 0.9)], "id string, score double"), 5)) == ["b"]
    assert ids(K.among_hits(some, spark.createDataFrame([], "id string, score double"), 5)) == ["a", "b"]
    assert ids(K.among_hits(some.limit(0), spark.createDataFrame([("b", 0.1)], "id string, score double"), 5)) == []
    nodes = spark.createDataFrame([("method://1", "method", "run", "m", None, None), ("method://2", "method", "run", "k", None, None)], METHODS)
    assert ids(K.resolve_method(nodes, "RUN")) == ["method://1"]
    assert ids(K.resolve_method(nodes, "run", "k")) == ["method://2"]
    assert ids(K.resolve_method(nodes, "method://1", "k")) == [] and ids(K.resolve_method(nodes, "method://9", "k")) == ["method://9"]
    assert ids(K.resolve_method(nodes, "")) == []


def test_implementations_prefer_code(spark):
    wanted = spark.createDataFrame([("Pay", "run"), ("Ship", "go")], "interface string, name string")
    methods = spark.createDataFrame([("1", "PayImpl", "run", None), ("2", "FastPayImpl", "run", "x"), ("3", "Pay", "run", "x"), ("4", "ShipImpl", "go", ""), ("5", "MyShipImpl", "go", None), ("6", "PayImpl", "stop", "x")], "id string, class_name string, name string, code string")
    assert sorted(r["id"] for r in K.implementations(wanted, methods).collect()) == ["2", "4", "5"]


def test_contexts_of_lonely_methods_and_cards_of_unknown_ids(spark):
    nodes = spark.createDataFrame([("a", "method", "run", None, None, None), ("b", "method", " ", "m", "C", "s()")], METHODS)
    none = spark.createDataFrame([], "source_id string, target_id string, rel_type string")
    assert {tuple(r) for r in X.method_contexts(nodes, none).collect()} == {("a", "", "run", "", "-", "-"), ("b", "C", "s()", "m", "-", "-")}
    assert {(r["id"], tuple(r["related"])) for r in X.related_ids(nodes, none).collect()} == {("a", ("a",)), ("b", ("b",))}
    listing = spark.createDataFrame([("b", "Titled", None, "D")], "id string, title string, signature string, class_name string")
    asked = spark.createDataFrame([("a",), ("b",), ("zz",)], "id string")
    assert {tuple(r) for r in X.cards(asked, nodes, listing).collect()} == {("a", "method", "run", "", "", None), ("b", "method", "Titled", "s()", "D", "m"), ("zz", "", "zz", "", "", None)}


def test_citations_and_backgrounds(spark):
    sections = spark.createDataFrame([([([("b",), (None,), ("a",)],), (None,), ([("b",), ("",)],)],)], "s array<struct<references:array<struct<entity_id:string>>>>")
    assert sections.select(X.cited(F.col("s")).alias("x")).first()["x"] == ["b", "a"]
    tables = domain_tables(spark, {"domain": {"business_domains": [{"id": "d", "capability_ids": ["c"]}], "terms": None}})
    assert [tuple(r) for r in tables["domains"].collect()] == [(0, "d", "", ["c"])] and tables["terms"].isEmpty() and tables["capabilities"].isEmpty()
    lists = tables["domains"].agg(F.collect_list(F.struct("id", "name", "capability_ids")).alias("d"), F.array().cast("array<struct<id:string,name:string,path_pattern:string>>").alias("c"))
    assert lists.select(X.domain_background(F.col("d"), F.col("c")).alias("x")).first()["x"] == "业务域：\n- d: c"
