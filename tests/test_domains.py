"""Walk policies, domain rings, class contexts and requirement entries on small cases."""

from __future__ import annotations

from loomgraph.operators import domains, policy


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_policies(spark):
    assert policy.CALLS_ONLY.calls_only and policy.CALLS_ONLY.excluded_prefixes == ()
    assert not policy.METHOD_TO_TABLE.calls_only and "implements" in policy.METHOD_TO_TABLE.excluded_relations and "term://" in policy.TABLE_TO_METHOD.excluded_prefixes
    edges = spark.createDataFrame([("m", "term://x", "calls"), ("m", "i", "IMPLEMENTS"), ("m", "c", "calls"), ("m", "b", "uses"), ("m", "b", "uses"), ("m", "d", None), ("domain://y", "m", "in")], "source_id string, target_id string, rel_type string")
    other = spark.createDataFrame([("m", "a", "uses"), ("m", "b", "calls"), ("m", None, "uses"), ("m", "", "uses")], "source_id string, target_id string, rel_type string")
    asked = spark.createDataFrame([("m",), ("m",), ("gone",)], "id string")
    assert rows(policy.policy_neighbours([edges, other], asked, policy.METHOD_TO_TABLE)) == [("m", 1, "b"), ("m", 2, "c"), ("m", 3, "d"), ("m", 4, "a")]
    assert rows(policy.policy_neighbours([edges], asked, policy.CALLS_ONLY)) == [("m", 1, "c"), ("m", 2, "term://x")]
    assert rows(policy.policy_neighbours([edges], asked, policy.TABLE_TO_METHOD, "up")) == []


def test_rings(spark):
    nodes = spark.createDataFrame([("m1", "Method", "f", "s1"), ("c1", "class", None, "s1"), ("c2", "class", "C", "s2"), ("t", "table", "T", "s2"), ("cap", "capability", "Pay", None)], "id string, entity_type string, name string, module_id string")
    edges = spark.createDataFrame([("d1", "cap", "CONTAINS_CAPABILITY"), ("d1", "zz", "contains_capability"), ("m1", "d1", "IN_DOMAIN"), ("t", "d2", "in_domain"), ("service://s2", "d2", "belongs_to_domain"), ("service://s1", "d1", "belongs_to_domain")], "source_id string, target_id string, rel_type string")
    got = rows(domains.domain_rings(nodes, edges, spark.createDataFrame([("d1",), ("d2",), ("d3",)], "id string")))
    assert got == [("d1", 1, "", "zz", "zz", False), ("d1", 1, "capability", "cap", "Pay", False), ("d1", 2, "method", "m1", "f", False), ("d2", 2, "class", "c2", "C", True)]


def test_class_contexts(spark):
    classes = spark.createDataFrame([("1", "OrderFacade", "m", "a.b"), ("2", "Empty", None, None)], "id string, name string, module_id string, package string")
    methods = spark.createDataFrame([("x1", "OrderFacade", "saveOrder", "saveOrder(Order)", "/order/save"), ("x2", "OrderFacade", "pageList", None, None), ("x3", "OrderFacade", "addItem", "addItem()", None), ("x4", "Other", "delete", None, None)], "id string, class_name string, name string, signature string, path string")
    got = {r["id"]: r for r in domains.class_contexts(classes, methods, spark.createDataFrame([("m", "Trade"), ("m", "Sale"), ("m", "Sale")], "module_id string, domain string")).collect()}
    assert (got["1"]["domains"], got["1"]["role"], got["1"]["capabilities"]) == ("Sale, Trade", "Service", "创建 / 新增, 订单相关操作, 查询 / 列表 / 搜索")
    assert got["1"]["context"].split("\n")[-3:] == ["- saveOrder(Order)  路由: /order/save", "- pageList", "- addItem()"] and "关联业务域: Sale, Trade" in got["1"]["context"]
    assert got["2"]["context"].split("\n")[-4:] == ["关联业务域: 未知", "", "主要方法（含路由信息，节选）:", "(无方法或未收集)"]


def test_requirements(spark):
    hits = spark.createDataFrame([("a", "m1", 0.5), ("b", "m1", 0.25), ("a", "m2", 0.9)], "item string, id string, score double")
    levels = spark.createDataFrame([("m1", 1)], "id string, level int")
    assert [tuple(r) for r in domains.requirement_entries(hits, levels).collect()] == [("m1", 1, 2, 0.75, 21.5), ("m2", 0, 1, 0.9, 6.8)]
    wanted = spark.createDataFrame([("a", "m1"), ("a", "m3"), ("b", "m1"), ("c", "m1")], "item string, id string")
    assert [tuple(r) for r in domains.mean_hit_rate(hits, wanted).collect()] == [(3, 0.5)]
