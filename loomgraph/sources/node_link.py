"""Graph snapshots as one node-link JSON document, written and read in parts.

The document has the members directed, multigraph, graph, nodes and links. Each node and link stands
at a depth of four blanks, as pretty-printed JSON has it, so that a reader can cut a document of any size at
the ends of its elements without reading it whole.
"""

from __future__ import annotations

import functools
import json
import operator
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from loomgraph.store import read_text, scope, shared_dir, staged, write_text

HEAD = '{\n  "directed": true,\n  "multigraph": true,\n  "graph": {},\n  "nodes": ['
ELEMENTS_A_FILE = 500_000
BETWEEN, TAIL = '  ],\n  "links": [', "  ]\n}"


def _section(rows: DataFrame, key: list[str], label: str) -> tuple[int, DataFrame, list[str]]:
    """How many elements there are, the texts of all but one with a comma after each, and the text of that one, if there is any: the section's last, which has no comma."""
    body = F.to_json(F.struct(*[F.col(c) for c in rows.columns]))
    text = F.concat(F.lit("    {\n      "), F.substr(body, F.lit(2), F.length(body) - 2), F.lit("\n    }"))  # without the braces
    # Sorted where they are, so that what is alike takes little room here and in the document; the whole isn't sorted, which would shuffle all texts.
    held = staged(rows.sortWithinPartitions(*[F.col(k).cast("string") for k in key]).select(text.alias("value")), label)
    file, at = F.col("_metadata.file_path"), F.col("_metadata.row_index")  # one row's own, however many equal it (links may come several times)
    found = held.agg(F.count("*").alias("n"), F.max(F.struct(file.alias("file"), at.alias("at"))).alias("last")).first()
    is_last = (file == found["last"]["file"]) & (at == found["last"]["at"]) if found["n"] else F.lit(False)
    return found["n"], held.filter(~is_last).select(F.concat("value", F.lit(",")).alias("value")), [r["value"] for r in held.filter(is_last).collect()]  # one row at most


def write_node_link(nodes: DataFrame, edges: DataFrame, path: str, version: str = "default", parts: int = 1, elements_a_file: int = ELEMENTS_A_FILE, compression: str = "none") -> None:
    """``path``/graph.json, a folder of text parts that are one JSON document one after another, and ``path``/meta.json with the version and the numbers of nodes and edges.

    nodes: id and any columns but nulls; edges: source_id, target_id, rel_type and any others, written as source, target, and key. parts: how many files there are at least; none gets more than ``elements_a_file`` elements. compression: of each part, a name that Spark's text files know; what takes names it by the parts' endings.
    """
    spark = nodes.sparkSession
    with scope(spark):
        n, plain_nodes, last_node = _section(nodes, ["id"], "nodes")
        m, plain_links, last_link = _section(edges.withColumnsRenamed({"source_id": "source", "target_id": "target"}), ["source", "target", "rel_type"], "links")
        # Parts of a union stand in its order, and so in the files' names.
        fixed = lambda *lines: spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1)
        every = fixed(HEAD).union(plain_nodes).union(fixed(*last_node, BETWEEN)).union(plain_links).union(fixed(*last_link, TAIL))
        every.write.mode("overwrite").option("compression", compression).option("maxRecordsPerFile", max(1, min(elements_a_file, (n + m) // parts))).text(f"{path}/graph.json")
    write_text(spark, f"{path}/meta.json", json.dumps({"version": version, "nodes": n, "edges": m}, indent=2, ensure_ascii=False))


def _elements(spark: SparkSession, path: str) -> DataFrame:
    """json of every node and link, as it stands in the document."""
    pieces = spark.read.option("lineSep", "\n    }").text(f"{path}/graph.json")
    begun = F.instr(F.concat(F.lit("\n"), "value"), "\n    {\n")  # 0 where no element begins
    return pieces.filter((begun > 0) & (F.length("value") > begun + 5)).select(F.concat(F.lit("{"), F.substr("value", begun + 6), F.lit("}")).alias("json"))


def _parsed(elements: DataFrame, schema: str | None = None) -> DataFrame:
    """json, is_link, and with a schema fields, which has what ``from_json`` gives.

    Fields that are all strings come from the one parse that tells links, which is faster. What may have been a number or an object there has a text of its own in ``from_json``; such elements, and those that can't be parsed, go through it.
    """
    wanted = DataType.fromDDL(schema).fields if schema else []
    flat = [f.name for f in wanted] if all(f.dataType == StringType() for f in wanted) else []
    names = list(dict.fromkeys(["source", "target", *flat]))
    text = {name: F.col(f"f{i}") for i, name in enumerate(names)}
    found = elements.select("json", F.json_tuple("json", *names).alias(*[f"f{i}" for i in range(len(names))]))
    fields = F.from_json("json", schema) if schema else F.lit(None)
    if flat:
        odd = [F.coalesce(F.substring(text[name], 1, 1).isin(*"-0123456789{["), F.lit(False)) for name in flat]
        fields = F.when(functools.reduce(operator.or_, odd, F.coalesce(*[text[name] for name in flat]).isNull()), fields).otherwise(F.struct(*[text[name].alias(name) for name in flat]))
    return found.select("json", (text["source"].isNotNull() & text["target"].isNotNull()).alias("is_link"), fields.alias("fields"))


def read_elements(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """is_link and the schema's fields of every node and link of a snapshot folder, in one pass over the document. Links are the elements with a source and a target."""
    return _parsed(_elements(spark, path), schema).select("is_link", "fields.*")


def read_node_link(spark: SparkSession, path: str, node_schema: str | None = None, edge_schema: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """(nodes, edges, meta text) of a snapshot folder, this library's or another's pretty-printed graph.json, a file or a folder.

    Schemas of the elements' fields; without them a pass over the document infers them. Fields source and target come back as source_id and target_id. Each table reads the document; ``read_elements`` reads it once for both.
    """
    elements = _elements(spark, path)

    def table(is_link: bool, schema: str | None) -> DataFrame:
        rows = _parsed(elements, schema).filter(F.col("is_link") == is_link)
        if schema:
            return rows.select("fields.*")
        lines = f"{shared_dir(spark)}/elements-{uuid.uuid4().hex}"
        rows.select(F.regexp_replace("json", "[\\r\\n]", " ")).write.text(lines)
        return spark.read.json(lines)

    nodes, edges = table(False, node_schema), table(True, edge_schema)
    return nodes, edges.withColumnsRenamed({"source": "source_id", "target": "target_id"}), read_text(spark, f"{path}/meta.json")
