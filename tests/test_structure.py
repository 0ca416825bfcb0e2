"""Containment joins, call resolution, budgeted walks, levels of chains and reach sizes against plain loops."""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pytest

from loomgraph.operators import budget, calls, containment, reach, traverse


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_containment_equals_loop(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abAB日"), int(rng.integers(1, 9))))
    names = [(k, "aaa" + word()) for k in ("x", "y") for _ in range(60)] + [("x", None), (None, "abab"), ("y", "")]  # "aaa" is in a third and more of them
    patterns = [(k, word()) for k in ("x", "y") for _ in range(40)] + [("x", "aaa"), ("y", "aaa"), ("x", ""), ("x", None), (None, "a"), ("x", "a")]
    n, p = spark.createDataFrame(names, "k string, name string"), spark.createDataFrame(patterns, "k string, pattern string")
    want = sorted({(k, a, b) for k, a in names for j, b in patterns if k and k == j and a and b and b in a}, key=str)
    for at_once in (100_000, 7):
        assert rows(containment.containing(n, p, ["k"], names_a_task=at_once)) == want
    plan = containment.containing(n, p, ["k"])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rows(containment.containing(n.limit(0), p)) == [] and rows(containment.containing(n, p.limit(0))) == []


def test_first_containing(spark):
    names = spark.createDataFrame([(1, "OrderService", 2), (2, "OrderServiceImpl", 1), (3, "OrderService", 0)], "id long, name string, at int")
    patterns = spark.createDataFrame([("Order",), ("Impl",), ("Gone",)], "pattern string")
    assert rows(containment.first_containing(names, patterns, ["at"])) == [("Impl", 2), ("Order", 3)]


def test_mappers_and_implementations(spark):
    methods = spark.createDataFrame(
        [("m1", "OrderMapper", "findById"), ("m2", "com.a.OrderMapper", "FindByIdAndName"), ("m3", "OrderService", "pay"), ("m4", "OrderServiceImpl", "pay"), ("m5", "FastOrderServiceImpl", "pay"), ("m6", "OrderServiceImpl", "pay"), ("m7", "OrderServiceImpl", None), ("m8", "Impl", "pay")],
        "id string, class_name string, name string",
    )
    statements = spark.createDataFrame([("com.a.OrderMapper", "findById"), ("OrderMapper", "idAndName"), ("com.a.GoneMapper", "findById"), ("com.a.OrderMapper", "delete")], "namespace string, statement_id string")
    assert rows(containment.mapper_methods(statements, methods)) == [("OrderMapper", "idAndName", "m2"), ("com.a.GoneMapper", "findById", None), ("com.a.OrderMapper", "delete", None), ("com.a.OrderMapper", "findById", "m2")]
    assert rows(containment.interface_implementations(methods)) == [("m3", "m5"), ("m3", "m6")]
    classes = spark.createDataFrame([("1", "OrderFactoryBuilder"), ("2", "Plain"), ("3", "myfactory")], "id string, name string")
    assert rows(containment.keyword_scores(classes, ["Factory", "Builder"])) == [("1", 2, ["builder", "factory"]), ("3", 1, ["factory"])]


def test_deferred_calls(spark):
    classes = spark.createDataFrame([("c1", "a.b", "Order", 1), ("c2", "", "Order", 2), ("c3", "a.b", "Order", 3), ("c4", None, "Pay", 4)], "class_id string, package string, name string, ordinal int")
    methods = spark.createDataFrame([("m1", "c3", "save(Order)", 2), ("m2", "c3", "save(Order,int)", 1), ("m3", "c2", "save", 3), ("m4", "c1", "save()", 4), ("m5", "c4", "run()", 5)], "id string, class_id string, signature string, ordinal int")
    deferred = spark.createDataFrame([("m5", "a.b.Order", "save"), ("m5", "a.b.Order", "save"), ("m2", "a.b.Order", "save"), ("m1", "Order", "save"), ("m1", "Pay", "gone"), ("m1", "x.Gone", "run"), (None, "Pay", "run"), ("m1", None, "run")], "caller_id string, target_fqn string, callee string")
    got = rows(calls.resolve_calls(deferred, classes, methods))
    assert got == sorted([("m5", "a.b.Order", "save", "m2", "resolved"), ("m2", "a.b.Order", "save", "m2", "self"), ("m1", "Order", "save", "m3", "resolved"), ("m1", "Pay", "gone", None, "no_method"), ("m1", "x.Gone", "run", None, "no_class"), (None, "Pay", "run", "m5", "resolved"), ("m1", None, "run", None, "no_class")], key=str)
    named = spark.createDataFrame([("m5", "Pay", "run"), ("m2", "Order", "save")], "id string, class_name string, name string")
    edges = rows(calls.call_edges(calls.resolve_calls(deferred, classes, methods), named).filter("source_id = 'm5'"))
    assert edges == [("m5", "m2", "Pay", "run", "Order", "save")]


def graph(seed, n, m):
    rng = np.random.default_rng(seed)
    return sorted({(f"n{a:02}", f"n{b:02}") for a, b in rng.integers(0, n, (m, 2))} | {("n00", f"n{i:02}") for i in range(1, n)})


def queue_walk(edges, start, budget_, depth, direction):
    near = defaultdict(set)
    for a, b in edges:
        if direction in ("down", "both"):
            near[a].add(b)
        if direction in ("up", "both"):
            near[b].add(a)
    hop, queue = {start: 0}, deque([start])
    while queue and len(hop) < budget_:
        at = queue.popleft()
        if hop[at] < depth:
            for x in sorted(near[at]):
                if x not in hop and len(hop) < budget_:
                    hop[x] = hop[at] + 1
                    queue.append(x)
    return [(start, x, h, i) for i, (x, h) in enumerate(hop.items(), 1)]


@pytest.mark.parametrize("direction", ["down", "up", "both"])
def test_budgeted_walks_equal_a_queue(spark, direction, monkeypatch):
    edges = graph(2, 40, 90)
    starts = ["n00", "n07", "n33", "zz"]
    df = spark.createDataFrame(edges + edges[:9], "source_id string, target_id string")
    asked = spark.createDataFrame([(s, s) for s in starts], "start_id string, node_id string")
    for budget_, depth in ((1, 5), (12, 6), (500, 3)):
        want = sorted((r for s in starts for r in queue_walk(edges, s, budget_, depth, direction)), key=str)
        assert rows(budget.budgeted_walks(df, asked, budget_, depth, direction)) == want
    written = []
    monkeypatch.setattr(budget, "staged", lambda d, label, by=None, f=budget.staged: written.append(label) or f(d, label, by))
    budget.budgeted_walks(df, asked.filter("start_id = 'n00'"), 12, 50, "down").collect()
    assert len(written) <= 3  # the walk is full after one round


def chain_of(nodes, edges, impls, skipped, start, direction, depth, most):
    """Level by level: nearest first; in a level interfaces give way before anything is stepped from."""
    seen, out, level = set(), [], {start} & nodes
    for d in range(depth + 1):
        fresh = level - seen
        shown, passed = set(), set()
        for x in fresh:
            found = sorted(impls.get(x, set()) & nodes)
            if len(found) == 1 and found[0] not in seen:
                shown.add(found[0])
                passed.add(x)
            else:
                shown.add(x)
                if len(found) > 1:
                    shown |= set(found) - seen
        out += [(d, x) for x in shown]
        seen |= shown | passed
        if len(out) >= most or not shown:
            break
        level = {b for a, b in edges if a in shown and b not in skipped and b in nodes} if direction == "down" else {a for a, b in edges if b in shown and a not in skipped and a in nodes}
    return out


def test_call_chains(spark):
    ids = [f"n{i:02}" for i in range(30)]
    edges = graph(5, 30, 45)[:-25]
    impls = {"n03": {"n20"}, "n00": {"n11"}, "n05": {"n21", "n22", "gone"}, "n06": {"gone"}}
    nodes = spark.createDataFrame([(x, "method" if x != "n09" else "class", f"C{int(x[1:]) % 4}", f"m{x}") for x in ids], "id string, entity_type string, class_name string, name string")
    impl = spark.createDataFrame([(a, b) for a, bs in impls.items() for b in bs], "interface_id string, id string")
    skipped = spark.createDataFrame([("n02",), ("n13",)], "id string")
    df = spark.createDataFrame(edges, "source_id string, target_id string")
    starts = ["n00", "n05", "n09", "unknown", "n14"]
    known = set(ids) - {"n09"}
    for direction, depth, most in (("down", 6, 30), ("up", 2, 30), ("down", 4, 5)):
        got = budget.call_chains(nodes, df, impl, skipped, spark.createDataFrame([(s,) for s in starts], "start_id string"), direction, depth, most)
        want = []
        for s in starts:
            found = chain_of(known, edges, impls, {"n02", "n13"}, s, direction, depth, most)
            named = sorted((d, f"C{int(x[1:]) % 4}", f"m{x}", x) for d, x in found)[:most]
            want += [(s, x, d, c, m) for d, c, m, x in named]
        assert rows(got) == sorted(want, key=str)


def plain_levels(edges, ids):
    """Longest paths down, components by mutual reachability."""
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    reached = {}
    for x in ids:
        seen, todo = {x}, [x]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        reached[x] = seen
    part = {x: max(y for y in reached[x] if x in reached[y]) for x in ids}
    memo = {}

    def level(c):
        if c not in memo:
            memo[c] = max((level(part[b]) + 1 for a in ids if part[a] == c for b in out[a] if part[b] != c), default=0)
        return memo[c]

    return {x: (part[x], level(part[x])) for x in ids}, {x: len(s) for x, s in reached.items()}


@pytest.mark.parametrize("seed", [1])
def test_levels_and_reach_of_random_graphs(spark, seed):
    rng = np.random.default_rng(seed)
    ids = [f"v{i:03}" for i in range(28)]
    edges = sorted({(ids[a], ids[b]) for a, b in rng.integers(0, 28, (22, 2)) if a != b} | {(ids[i], ids[i + 1]) for i in range(10, 17)})
    df, nodes = spark.createDataFrame(edges, "source_id string, target_id string"), spark.createDataFrame([(x,) for x in ids], "id string")
    level, size = plain_levels(edges, ids)
    assert {r["id"]: (r["component"], r["level"]) for r in traverse.levels(df, nodes).collect()} == level
    assert {r["id"]: r["reached"] for r in reach.reach_sizes(df, nodes, 1).collect()} == size


def test_benefit_of_inference(spark):
    edges = spark.createDataFrame([("a", "b", False), ("b", "c", False), ("a", "c", True), ("a", "d", True), ("d", "e", False), ("a", "b", True)], "source_id string, target_id string, inferred boolean")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    assert rows(reach.benefit_of_inference(edges, nodes)) == [("a", 3, 5, 2), ("b", 2, 2, 0), ("c", 1, 1, 0), ("d", 2, 2, 0), ("e", 1, 1, 0), ("f", 1, 1, 0)]


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    n = 10_000
    df = spark.range(n).selectExpr("format_string('c%05d', id) AS source_id", "format_string('c%05d', id + 1) AS target_id")
    nodes = spark.range(n + 1).selectExpr("format_string('c%05d', id) AS id")
    written = []
    monkeypatch.setattr(traverse, "staged", lambda d, label, by=None, f=traverse.staged: written.append(label) or f(d, label, by))
    got = traverse.levels(df, nodes)
    assert got.filter(f"level <> {n} - cast(substr(id, 2) AS int)").count() == 0 and got.count() == n + 1
    assert len(written) < 60
