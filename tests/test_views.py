"""Reports, lists, tables for analysis and the ontology on small cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.code import snippet
from loomgraph.operators import graph, views
from loomgraph.sources import code, triples


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_module_report(spark):
    nodes = spark.createDataFrame(
        [("c1", "class", "OrderFactory", "m", None, None, None), ("c2", "Class", "Plain", "m", None, None, None), ("f", "method", "make", "m", "OrderFactory", "new Order()", "/o"), ("g", "method", "x", "m", "Plain", "y", "/o"), ("h", "method", "z", "n", "Z", "z", "/z")],
        "id string, entity_type string, name string, module_id string, class_name string, code string, path string",
    )
    edges = spark.createDataFrame([("f", "h", "calls"), ("g", "h", "CALLS"), ("h", "f", "uses"), ("f", "g", "calls"), ("h", "g", "depends_on")], "source_id string, target_id string, rel_type string")
    got = {(r["section"], r["line"]) for r in views.module_evidence(nodes, edges, "m", ["factory"]).collect()}
    assert {x for x in got if x[0] != "excerpts"} == {("counts", "class=2"), ("counts", "method=2"), ("dependencies", "- m -> n (2)"), ("dependencies", "- n -> m (1)"), ("paths", "- /o"), ("hints", "- c1 | OrderFactory")}
    assert [x for x in got if x[0] == "excerpts"] == [("excerpts", "- OrderFactory f\nnew Order()")]
    assert views.module_evidence(nodes, edges, "gone", ["factory"]).count() == 0
    assert {r["line"] for r in views.module_evidence(nodes, edges, "m", ["M"]).filter("section = 'hints'").collect()} == {"- c1 | OrderFactory", "- c2 | Plain"}


def test_lists_and_tables(spark):
    nodes = spark.createDataFrame([("domain://b", "BusinessDomain", "Trade"), ("domain://a", "businessdomain", None), ("x", "class", "C")], "id string, entity_type string, name string")
    assert [tuple(r) for r in views.domain_list(nodes).collect()] == [("domain://b", "b", "Trade"), ("domain://a", "a", "domain://a")]
    facts = spark.createDataFrame([("f", "Method", "go", None, {"class_name": "C", "code_snippet": "abc", "is_getter": "True"}), ("g", "method", "x", "m", None), ("k", "field", "size", "m", {"class_name": "C", "comment": "how big"})], "id string, entity_type string, name string, module_id string, attributes map<string, string>")
    edges = spark.createDataFrame([("f", "g", "calls"), ("f", "g", "calls"), ("f", "gone", "calls"), ("g", "f", "uses")], "source_id string, target_id string, rel_type string")
    methods, calls, fields = views.analysis_tables(facts, edges)
    assert rows(methods) == [("f", "go", "C", "", "", True, False, True, 3), ("g", "x", "", "m", "", False, False, False, 0)]
    assert rows(calls) == [("f", "g"), ("f", "g")] and rows(fields) == [("C", "size", "how big")]
    hits, members, inner = views.search_with_subgraph(facts, edges.union(spark.createDataFrame([("g", "k", "has")], edges.schema)), "G", "g")
    assert [r["id"] for r in hits.collect()] == ["f", "g"] and sorted(r["id"] for r in members.collect()) == ["g", "k"] and rows(inner) == [("g", "k", "has")]
    patterns = spark.createDataFrame([("p", {"a": 1}, ["x"]), ("q", None, None)], "id string, evidence map<string, int>, related_entity_ids array<string>")
    assert rows(views.with_encoded_evidence(patterns)) == [("p", '{"a":1}', '["x"]'), ("q", "", "[]")]
    snippets = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", " ")], "id string, code string")
    assert rows(views.code_of(spark.createDataFrame([("a",), ("b",), ("a",)], "id string"), snippets)) == [("a", "1")]


def test_search_report(spark):
    texts = spark.createDataFrame([("m1", [1.0, 0.0], "C", "f", "[摘要] pays\nmore"), ("m2", [0.0, 1.0], None, None, "other text")], "id string, vector array<double>, class_name string, name string, text string")
    questions = spark.createDataFrame([("q", [1.0, 0.0])], "item string, vector array<double>")
    assert rows(views.search_report(texts, questions, 2)) == [("q", 1, "[1.0000] C.f → pays"), ("q", 2, "[0.0000] m2 → other text")]
    assert rows(views.interpretation_hits(texts, questions, 1)) == [("q", "m1", 1.0)]


def test_ontology(spark, tmp_path):
    nodes = spark.createDataFrame([("method://a.B", "method", 'say "hi"\n'), ("term://x", "Term", None), ("z", None, "Z")], "id string, entity_type string, name string")
    edges = spark.createDataFrame([("method://a.B", "term://x", "calls"), ("z", "term://x", None), ("z", "term://x", "related_to"), ("z", "term://x", "related_to")], "source_id string, target_id string, rel_type string")
    base, rdf, rdfs, owl = triples.BASE, triples.RDF, triples.RDFS, triples.OWL
    want = {
        f"<{base}code#method> <{rdf}type> <{owl}Class> .", f'<{base}code#method> <{rdfs}label> "method" .', f"<{base}domain#Term> <{rdf}type> <{owl}Class> .", f'<{base}domain#Term> <{rdfs}label> "Term" .', f"<{base}domain#Thing> <{rdf}type> <{owl}Class> .",
        f"<{base}code#calls> <{rdf}type> <{owl}ObjectProperty> .", f'<{base}code#calls> <{rdfs}label> "calls" .', f"<{base}code#calls> <{rdf}type> <{owl}TransitiveProperty> .", f"<{base}code#related_to> <{rdf}type> <{owl}ObjectProperty> .", f'<{base}code#related_to> <{rdfs}label> "related_to" .',
        f"<{base}id/method___a.B> <{rdf}type> <{base}code#method> .", f'<{base}id/method___a.B> <{rdfs}label> "say \\"hi\\"\\n" .', f"<{base}id/term___x> <{rdf}type> <{base}domain#Term> .", f"<{base}id/z> <{rdf}type> <{base}domain#Thing> .", f'<{base}id/z> <{rdfs}label> "Z" .',
        f"<{base}id/method___a.B> <{base}code#calls> <{base}id/term___x> .", f"<{base}id/z> <{base}code#related_to> <{base}id/term___x> .",
    }
    triples.write_ontology(nodes, edges, str(tmp_path / "o"))
    found = [r["value"] for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert set(found) == want and len(found) == len(want)


def test_modules_snippets_and_accesses(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(code.module_of(F.lit("a/b.java"), [("x", "")])) == "x" and one(code.module_of(F.lit("a/b.java"), [])) is None
    assert one(code.module_of(F.lit("a\\b.java"), [("x", "y"), ("z", "a")])) == "z" and one(code.module_of(F.lit("q/b"), [("x", "y"), ("z", "a")])) == "q"
    text = F.lit("one\n  two\nthree  \nfour")
    assert one(snippet(text, F.lit(2), F.lit(3))) == "two\nthree" and one(snippet(text, F.lit(3), F.lit(99))) == "three  \nfour" and one(snippet(text, F.lit(0), F.lit(2))) is None and one(snippet(text, F.lit(3), F.lit(2))) is None
    assert one(snippet(text, F.lit(1), F.lit(1), 2)) == "on..."
    xml = '<mapper namespace="a.B"><select id="q">SELECT id, name FROM t JOIN u ON 1</select><update id="e">UPDATE v SET x = 1</update><delete id="n">nothing</delete></mapper>'
    got = code.statement_accesses(code.mapper_statements(spark.createDataFrame([(xml,), ('<mapper><select id="z">SELECT 1 FROM t</select></mapper>',)], "text string")))
    assert rows(got.select("namespace", "statement_id", "op", "table", F.array_join("columns", ",").alias("c"))) == [("a.B", "e", "update", "v", "x"), ("a.B", "q", "select", "t", "id,name"), ("a.B", "q", "select", "u", "id,name")]


def test_graph_rules(spark):
    entities = spark.createDataFrame([("m", {"a": "1", "b": None, "code_snippet": "x"}), ("n", None)], "id string, attributes map<string, string>")
    edges = spark.createDataFrame([("m", "n", "calls"), ("m", "n", "calls"), ("m", "o", "uses"), ("p", "m", "CALLS")], "source_id string, target_id string, rel_type string")
    nodes, same = graph.graph_of(entities, edges)
    assert rows(nodes) == [("m", {"a": "1"}), ("n", {})] and same.count() == 4
    asked = spark.createDataFrame([("m",)], "id string")
    assert rows(graph.peers(edges, asked)) == [("m", "n", "calls"), ("m", "o", "uses")] and rows(graph.peers(edges, asked, "up", ["calls"])) == [("m", "p", "CALLS")]
    details = spark.createDataFrame([("t", "r", 2, "s", "x"), ("t", "r", 1, "z", "y"), ("t", "r", 1, "z", "y"), ("t", "w", 0, "s", "x")], "table string, op string, hop int, statement string, source string")
    assert rows(graph.access_groups(details)) == [("t", "r", 1, 2, [(1, "z", "y"), (2, "s", "x")]), ("t", "w", 0, 0, [(0, "s", "x")])]
    patterns = spark.createDataFrame([("a", "p", 0.5), ("a", "q", 0.5), ("b", "r", 0.9)], "scope string, pattern_name string, confidence double")
    assert [r["pattern_name"] for r in graph.best_patterns(patterns, 2).collect()] == ["r", "p"] and rows(graph.best_patterns(patterns, 1, ["scope"])) == [("a", "p", 0.5), ("b", "r", 0.9)]
    sized = spark.createDataFrame([("g", i, n) for i, n in enumerate([5, 1, 5, 5, 9, 2])] + [("h", 9, 3)], "g string, k int, n int")
    assert rows(graph.samples_by_size(sized, "g", "n", "k")) == [("g", 1, 1), ("g", 2, 5), ("g", 4, 9), ("h", 9, 3)]
