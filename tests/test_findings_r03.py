"""Small tests of what the third round's findings named."""

from __future__ import annotations

import json
import math

from pyspark.sql import functions as F

from loomgraph.operators import budget, context, facts, reach, retrieval, semantic, traverse
from loomgraph.sources import node_link, triples


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_batch_recall_makes_no_row_for_a_pair(spark):
    """F1: odd vectors score as the column expression scores them; nothing is joined pair by pair."""
    from loomgraph.functions.vectors import cosine

    odd = [None, [], [0.0, 0.0], [1.0], [1.0, None], [math.nan, 1.0], [math.inf, 1.0], [1e200, 1e200], [1e-12, 0.0], [1.0, 2.0], [1.0, 2.0], [-2.0, 1.0], [0.3, 0.1], [3.0, 1.0], [1.0, 2.0]]
    e = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "vec_id long, embedding array<double>")
    asked = e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("q"))
    for k in (1, 3, 20):
        out = retrieval.top_k_of_queries(e, asked, k, "vec_id", "embedding", at_once=5)
        assert "NestedLoopJoin" not in plan_of(out) and "CartesianProduct" not in plan_of(out)
        found = {}
        for r in out.collect():
            found.setdefault(r["item"], []).append((r["vec_id"], str(r["score"])))
        scored = e.crossJoin(asked).filter("vec_id <> item").select("item", "vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 4).alias("score")).orderBy("item", F.desc("score"), "vec_id").collect()
        for item in range(len(odd)):
            assert sorted(found[item]) == sorted((r["vec_id"], str(r["score"])) for r in [r for r in scored if r["item"] == item][:k])


def test_transitive_pairs_are_written_once(spark, monkeypatch):
    """A chain's pairs are each staged once, whatever the rounds; graphs with shorter and longer ways and cycles keep their pairs."""
    written = []
    monkeypatch.setattr(traverse, "staged", lambda df, *a, _do=traverse.staged, **k: written.append(_do(df, *a, **k)) or written[-1])
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "source_id long, target_id long")
    assert traverse.transitive_pairs(chain).count() == 20 * 21 // 2 - 20
    assert sum(w.count() for w in written) == 20 * 21 // 2
    arcs = {(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (0, 4), (5, 6), (6, 7), (7, 5), (7, 8), (9, 9), (8, 9), (2, 2)}
    pairs = set(arcs)
    while True:
        more = pairs | {(a, d) for a, b in pairs for c, d in arcs if b == c}
        if more == pairs:
            break
        pairs = more
    found = [tuple(r) for r in traverse.transitive_pairs(spark.createDataFrame(sorted(arcs), "source_id long, target_id long")).collect()]
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a, b in pairs - arcs if a != b}


def test_terms_are_grouped_by_id_only(spark):
    """no hash table of words; texts of one id keep the order of places."""
    texts = spark.createDataFrame([(1, "beta getAlpha beta"), (1, "alpha x x gamma"), (2, "nothing")], "id long, text string")
    lookup = spark.createDataFrame([("alpha", "A"), ("beta", "B"), ("gamma", "C")], "term string, term_id string")
    out = semantic.term_matches(texts, lookup)
    assert [(r["id"], r["term_ids"]) for r in out.collect()] == [(1, ["A", "B", "C"])]
    assert plan_of(out).split("== Optimized")[0].count("Aggregate [id#") == 1  # in the analyzed plan


def test_bean_contexts_deal_texts_by_number(spark):
    """one shuffle, by id, for however small a file of texts."""
    codes = spark.createDataFrame([(1, "Item item = new Item(); item.getA(); item.setB(1);"), (2, "x")], "id long, code string")
    out = context.bean_contexts(codes, spark.createDataFrame([("Item", "A", "first"), ("Item", "B", "second")], "class_name string, field string, comment string"))
    assert [tuple(r) for r in out.collect()] == [(1, "Item.A: first\nItem.B: second")]
    assert "RepartitionByExpression [id" in plan_of(out)


def test_templates_under_several_names(spark):
    """what an id and a name both lead to comes once, ids of several names too, however the pairs are dealt; the output isn't shuffled."""
    templates = spark.createDataFrame([("t1", "m1", "a.C", "n"), ("t2", None, "a.C", "n"), ("t2", None, "a.D", "n"), ("t3", "m1", "a.X", "n"), ("t3", "m1", "a.X", "n")], "template_id string, method_id string, class_name string, method_name string")
    methods = spark.createDataFrame([("m1", "a.C", "n"), ("m1", "a.D", "n"), ("m2", "C", "N"), ("m2", "C", "N")], "id string, class_name string, name string").selectExpr("*", "CAST(NULL AS STRING) AS signature", "CAST(NULL AS STRING) AS location")
    for most in (1, 2_000_000):
        out = facts.templates_of_methods(templates, methods, most)
        assert sorted(tuple(r) for r in out.collect()) == [("m1", "t1"), ("m1", "t2"), ("m1", "t3"), ("m2", "t1"), ("m2", "t2")]
    plain = facts.templates_of_methods(templates, methods.filter("id = 'm2'"))
    assert "Union" in plan_of(plain).split("\n")[1]  # nothing stands over the pairs


def test_levels_merge_what_grows(spark):
    """no table of nodes is broadcast, which would pass the driver."""
    arcs = spark.createDataFrame([(f"m{i}", f"m{i // 2}") for i in range(2, 8)], "source_id string, target_id string")
    nodes = spark.createDataFrame([(f"m{i}",) for i in range(1, 8)], "id string")
    for out in (traverse.levels(arcs, nodes), reach.reach_sizes(arcs, nodes)):
        assert out.count() == 7
        assert "BroadcastHashJoin" not in plan_of(out)


def test_snapshot_files_follow_the_elements(spark, tmp_path):
    """more files for more elements, still one document, with the last of several equal links without a comma."""
    n = spark.createDataFrame([(f"n{i}",) for i in range(40)], "id string")
    e = spark.createDataFrame([("a", "b", "calls"), ("n9", "n9", "uses"), ("n9", "n9", "uses"), ("n9", "n9", "uses")], "source_id string, target_id string, rel_type string")
    node_link.write_node_link(n, e, str(tmp_path / "s"), parts=1, elements_a_file=5)
    files = sorted((tmp_path / "s" / "graph.json").glob("part-*"))
    document = json.loads("\n".join(p.read_text() for p in files if p.stat().st_size))
    assert len(files) >= 5 and len(document["nodes"]) == 40 and len(document["links"]) == 4


def test_triples_are_dealt_before_repeats_go(spark):
    """no task holds a hash table of all triples of its split."""
    n = spark.createDataFrame([("a", "class", "A"), ("a", "class", "A")], "id string, entity_type string, name string")
    out = triples.ontology_triples(n, spark.createDataFrame([("a", "a", "calls")], "source_id string, target_id string, rel_type string"))
    assert out.count() == out.distinct().count() == 8
    assert "RepartitionByExpression [triple" in plan_of(out)


def test_edges_are_dealt_by_number(spark, small):
    """F16: pairs of lines are dealt before repeats go, by a number that AQE doesn't lower; a source's edges of a type lie in one task."""
    from loomgraph.sources.tables import edges

    plan = plan_of(edges(spark, small)).split("== Optimized")[0]  # in the analyzed plan
    assert "RepartitionByExpression [l_orderkey" in plan and "RepartitionByExpression [l_partkey" in plan
    uses = edges(spark, small).filter("rel_type = 'uses'").groupBy("source_id", F.spark_partition_id()).count()
    assert uses.count() == uses.select("source_id").distinct().count() > 0


def test_deferred_calls_are_dealt_once(spark, small):
    """one deal of the deferred calls, by a number that AQE doesn't lower, and their repeats go once."""
    from loomgraph.queries import QUERIES

    plan = plan_of(QUERIES["j15_resolved_calls"](spark, small))
    assert "RepartitionByExpression [caller_id" in plan
    physical = plan.split("== Physical Plan ==")[1]
    assert "l_returnflag" not in "".join(line for line in physical.splitlines() if "Aggregate" in line)


def test_mappers_of_one_split_are_parsed_by_all_slots(spark):
    """a small file of very many mappers is no single task's; texts that aren't XML still give no lines."""
    from loomgraph.sources.dynamic_sql import mapper_lines

    texts = [(f'<mapper namespace="n"><select id="q{i}">SELECT {i}</select></mapper>',) for i in range(400)] + [("no xml",), (None,)]
    out = mapper_lines(spark.createDataFrame(texts, "text string").coalesce(1))
    tasks = out.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in tasks) == 400
    assert len(tasks) >= spark.sparkContext.defaultParallelism and max(r["n"] for r in tasks) < 200


def test_call_chains_merge_what_grows(spark, monkeypatch):
    """no depth broadcasts a table of methods, calls or what was seen, which would pass the driver."""
    plans = []
    monkeypatch.setattr(budget, "staged", lambda df, *a, _do=budget.staged, **k: plans.append(plan_of(df)) or _do(df, *a, **k))
    methods = spark.createDataFrame([(f"m{i}", "method", f"C{i}", "n") for i in range(6)], "id string, entity_type string, class_name string, name string")
    arcs = spark.createDataFrame([("m0", "m1"), ("m1", "m4"), ("m3", "m5")], "source_id string, target_id string")
    faces = spark.createDataFrame([("m1", "m2"), ("m1", "m3")], "interface_id string, id string")
    out = budget.call_chains(methods, arcs, faces, spark.createDataFrame([("m4",)], "id string"), spark.createDataFrame([("m0",)], "start_id string"))
    assert sorted(tuple(r)[1:3] for r in out.collect()) == [("m0", 0), ("m1", 1), ("m2", 1), ("m3", 1), ("m5", 2)]
    assert plans and not any("BroadcastHashJoin" in p for p in [*plans, plan_of(out)])


def test_policy_neighbours_make_the_asked_ids_once(spark, small):
    """what is asked is read once, not anew for each part of the graphs; repeated and null ids change nothing, nor does the number of tasks."""
    from loomgraph.operators.policy import WalkPolicy, policy_neighbours
    from loomgraph.queries import QUERIES
    from loomgraph.sources.tables import edge_sources, edges

    graph = spark.createDataFrame([("a", "c", "uses"), ("a", "b", "uses"), ("a", "b", "calls"), ("b", "a", "calls"), (None, "a", "calls"), ("", "a", "calls"), ("c", "a", "calls")], "source_id string, target_id string, rel_type string")
    more = spark.createDataFrame([("a", "a0", "uses"), ("a", "c", "uses"), ("b", "z", "uses")], "source_id string, target_id string, rel_type string")
    asked = spark.createDataFrame([("a",), ("a",), (None,), ("",), ("gone",), ("b",)], "id string")
    for tasks in (None, 1, 3):
        out = policy_neighbours([graph.union(graph), more], asked, WalkPolicy(), tasks=tasks)
        assert sorted(tuple(r) for r in out.collect()) == [("", 1, "a"), ("a", 1, "b"), ("a", 2, "c"), ("a", 3, "a0"), ("b", 1, "a"), ("b", 2, "z")]
    plan = plan_of(QUERIES["n29_policy_neighbours"](spark, small)).split("== Optimized")[1].split("== Physical")[0]
    assert plan.count("Relation [l_") == 3 and "LeftSemi" not in plan  # pairs of parts and suppliers, and the orders and parts that lines leave
    sources = edges(spark, small).select("source_id").distinct()
    assert edge_sources(spark, small).exceptAll(sources).count() == 0 == sources.exceptAll(edge_sources(spark, small)).count()
    again = edges(spark, small, repeats=True).distinct()
    assert again.exceptAll(edges(spark, small)).count() == 0 == edges(spark, small).exceptAll(again).count()
