"""Small tests of what the fourth round's findings named."""

from __future__ import annotations

import gzip
import json
import os

from loomgraph.sources import node_link
from loomgraph.store import shared_dir


def shared_files(spark):
    top = shared_dir(spark).removeprefix("file:")
    return {f"{d}/{f}" for d, _, names in os.walk(top) for f in names if f.startswith("part-")}


def test_snapshot_leaves_only_compressed_parts(spark, small):
    """no staged table stays beside the snapshot, and its parts are compressed; together they are one whole JSON document."""
    from loomgraph.queries import QUERIES

    before = shared_files(spark)
    out = QUERIES["s14_node_link"](spark, small)
    left = sorted(shared_files(spark) - before)
    assert left and all(f.endswith(".txt.gz") and "/graph.json/" in f for f in left)
    document = json.loads("\n".join(gzip.open(f, "rt").read() for f in left))
    assert out.count() == len(document["nodes"]) + len(document["links"])
    assert out.filter("kind = 'link'").count() == len(document["links"])


def test_snapshot_texts_are_not_shuffled(spark, tmp_path, monkeypatch):
    """elements are written where they are; sections still follow one another, with one comma less than each has elements, whatever the columns and repeats."""
    monkeypatch.setattr(type(spark.range(0)), "repartitionByRange", None)
    for links in (0, 1, 7):
        n = spark.createDataFrame([(f"n{i}", {"b": [i]}) for i in range(30)], "id string, a map<string, array<int>>").selectExpr("*", "struct() AS s", "make_interval(1, 2) AS i").repartition(5)
        e = spark.createDataFrame([("x", "y", "calls")] * links, "source_id string, target_id string, rel_type string").repartition(3)
        path = tmp_path / f"s{links}"
        node_link.write_node_link(n, e, str(path), parts=2, elements_a_file=4, compression="gzip")
        files = sorted((path / "graph.json").glob("part-*.gz"))
        document = json.loads("\n".join(gzip.open(f, "rt").read() for f in files))
        assert sorted(x["id"] for x in document["nodes"]) == sorted(f"n{i}" for i in range(30)) and document["nodes"][0]["s"] == {}
        assert document["links"] == [{"source": "x", "target": "y", "rel_type": "calls"}] * links
        assert json.loads((path / "meta.json").read_text()) == {"version": "default", "nodes": 30, "edges": links}


def test_elements_of_one_pass(spark, tmp_path):
    """what one parse gives is what from_json gives, for numbers, objects, repeated and escaped names and for what can't be parsed."""
    bodies = ['"id": "a"', '"id": 1.10', '"id": -5e3', '"id": true', '"id": null', '"id": {"k": [1,\n        2.50]}', '"id": "{x"', '"id": "9a"', '"id": ""', '"x": 1', '"id": "b", "id": "c"', '"id": "\\u00e9\\"q\\""', '"id": "bad', '"id": "d", "bad": tru']
    links = ['"source": "s", "target": "t"', '"source": "", "target": ""', '"source": {"a":  1}, "target": [1,  2]', '"\\u0073ource": "e", "target": "f", "id": "订单"']
    others = ['"source": null, "target": "t", "id": "n"', '"id": "q", "attrs": {"source": "x", "target": "y"}']
    text = ",\n".join(f"    {{\n      {b}\n    }}" for b in [*bodies, *others, *links])
    (tmp_path / "graph.json").write_text(f'{{\n  "graph": {{\n    "l": [\n      {{\n        "z": 1\n      }}\n    ]\n  }},\n  "nodes": [\n{text},\n    {{\n    }}\n  ]\n}}')
    found = [tuple(r) for r in node_link.read_elements(spark, str(tmp_path), "id string, source string").collect()]
    rows = spark.createDataFrame([(f"{{{b}\n}}",) for b in [*bodies, *others, *links]], "json string")
    given = [tuple(r) for r in rows.selectExpr("from_json(json, 'id string, source string') AS x").select("x.*").collect()]
    assert [r[1:] for r in found] == given
    assert [r[0] for r in found] == [False] * (len(bodies) + len(others)) + [True] * len(links)
