"""Hand-sized graphs with hand-derived answers."""

from __future__ import annotations

from loomgraph.operators import graph as G
from loomgraph.operators import traverse as T


def edge(spark, *pairs):
    return spark.createDataFrame([(a, b, "calls") for a, b in pairs], "source_id string, target_id string, rel_type string")


def node(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_closure_directions_and_cycles(spark):
    e = edge(spark, ("s", "x"), ("y", "s"), ("x", "s"), ("x", "z"))
    ids = lambda **k: {r["id"] for r in T.impact_closure(e, "s", **k).collect()}
    assert ids() == {"s", "x", "z"}
    assert ids(direction="up") == {"s", "x", "y"}
    assert ids(direction="both") == {"s", "x", "y", "z"}
    assert ids(max_hops=1) == {"s", "x"}
    assert {r["id"] for r in T.impact_closure(e, "nowhere").collect()} == {"nowhere"}


def test_bfs_hops_and_parents_of_a_diamond(spark):
    e = edge(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"))
    start = spark.createDataFrame([("a", "a")], "start_id string, node_id string")
    found = {r["node_id"]: (r["hop"], r["parent_id"]) for r in T.bfs(e, start).collect()}
    assert found == {"a": (0, None), "b": (1, "a"), "c": (1, "a"), "d": (2, "b"), "e": (3, "d")}


def test_components_and_levels_with_cycles(spark):
    e = edge(spark, ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("c", "leaf"), ("x", "x"))
    n = node(spark, ["a", "b", "c", "d", "leaf", "x"])
    parts = {r["id"]: r["component"] for r in T.strong_components(e, n).collect()}
    assert parts == {"a": "b", "b": "b", "c": "d", "d": "d", "leaf": "leaf", "x": "x"}
    assert {r["id"]: r["level"] for r in T.levels(e, n).collect()} == {"a": 2, "b": 2, "c": 1, "d": 1, "leaf": 0, "x": 0}


def test_components_beside_long_chains(spark):
    chain = [(f"m{i}", f"m{i + 1}") for i in range(10, 20)]  # m10 -> ... -> m20, with a cycle m14 <-> m15 and one at the end of a branch
    e = edge(spark, *chain, ("m15", "m14"), ("m12", "q"), ("q", "r"), ("r", "q"), ("r", "ghost"), ("ghost", "r"))
    n = node(spark, [f"m{i}" for i in range(10, 21)] + ["q", "r"])
    parts = {r["id"]: r["component"] for r in T.strong_components(e, n).collect()}
    assert parts == {f"m{i}": f"m{i}" for i in range(10, 21)} | {"m14": "m15", "q": "r", "r": "r"}
    assert {r["id"]: r["component"] for r in T.strong_components(edge(spark, *chain), node(spark, ["m10", "m11"])).collect()} == {"m10": "m10", "m11": "m11"}
    assert T.strong_components(e.limit(0), n.limit(0)).count() == 0


def test_bfs_of_both_directions_and_several_starts(spark):
    e = edge(spark, ("a", "b"), ("c", "b"), ("c", "d"), ("e", "d"), ("a", "e"), ("f", "f"))
    starts = spark.createDataFrame([("x", "a"), ("x", "d"), ("y", "a"), ("z", "f")], "start_id string, node_id string")
    found = {(r["start_id"], r["node_id"]): r["hop"] for r in T.bfs(e, starts, direction="both").collect()}
    near = {"a": 0, "b": 1, "e": 1, "c": 2, "d": 2}
    assert found == {("y", k): v for k, v in near.items()} | {("x", k): v for k, v in {"a": 0, "d": 0, "b": 1, "e": 1, "c": 1}.items()} | {("z", "f"): 0}


def test_levels_of_parts_with_gaps_in_their_keys(spark, tmp_path):
    from loomgraph.queries import QUERIES

    keys = [(1, "a"), (3, "a"), (5, "b"), (6, "b"), (8, "b")]  # 3 calls 1 and 6 calls 3; 5 and 8 call parts that aren't there
    spark.createDataFrame(keys, "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    assert [tuple(r) for r in QUERIES["l7_deepest"](spark, str(tmp_path)).collect()] == [(6, 2), (3, 1), (1, 0), (5, 0), (8, 0)]
    assert {tuple(r) for r in QUERIES["a12_module_level_pivot"](spark, str(tmp_path)).collect()} == {("a", 1, 1, 0), ("b", 2, 1, 0)}


def test_transitive_pairs_have_no_loops_and_no_edges(spark):
    e = edge(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"))
    assert {(r[0], r[1]) for r in T.transitive_pairs(e).collect()} == {("a", "c"), ("a", "d"), ("b", "a"), ("b", "d"), ("c", "b")}


def test_phantoms_and_search_modes(spark):
    n = spark.createDataFrame([("m1", "method", "deleteOrder"), ("m2", "method", None)], "id string, entity_type string, name string")
    e = edge(spark, ("m1", "ghost"))
    assert {(r["id"], r["entity_type"]) for r in G.with_phantoms(n, e).collect()} == {("m1", "method"), ("m2", "method"), ("ghost", None)}
    assert G.search_by_name(n, "").count() == 2
    assert G.search_by_name(n, "", mode="name_or_id").count() == 0
    assert [r["id"] for r in G.search_by_name(n, "M", mode="name_or_id").collect()] == ["m1", "m2"]


def test_parallel_edges_stay_unless_distinct(spark):
    e = edge(spark, ("a", "b"), ("a", "b"))
    assert G.neighbours(e, ["CALLS"]).count() == 2
    assert G.neighbours(e, ["calls"], distinct=True).count() == 1
