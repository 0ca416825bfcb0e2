"""The graph as an ontology in N-Triples: classes, properties, individuals and what is stated of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ids import uri_local
from loomgraph.functions.predicates import is_code_type

# The vocabularies' names, and relations that carry over.
BASE = "http://example.org/graph/"
RDF, RDFS, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
TRANSITIVE = ("calls", "extends", "implements", "depends_on", "belongs_to", "service_calls", "BELONGS_TO_DOMAIN", "CONTAINS_CAPABILITY")


def _uri(text: Column | str) -> Column:
    return F.concat(F.lit("<"), F.lit(text) if isinstance(text, str) else text, F.lit(">"))


def _literal(text: Column) -> Column:
    """Quoted, with quotes, backslashes and line ends escaped."""
    out = text
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def ontology_triples(nodes: DataFrame, edges: DataFrame, base: str = BASE, transitive: tuple[str, ...] = TRANSITIVE) -> DataFrame:
    """triple: each once: a labelled class for every type of entity, in the code's or the domain's vocabulary; a labelled property for every relation, transitive where it is; every node with
    its class (Thing without a type) and label; every edge. nodes: id, entity_type, name; edges: source_id, target_id, rel_type; edges without a relation are left out."""
    code, domain = f"{base}code#", f"{base}domain#"
    kind = F.coalesce(F.nullif(F.trim("entity_type"), F.lit("")), F.lit("Thing"))
    class_uri = lambda c: _uri(F.concat(F.when(is_code_type(c), code).otherwise(domain), uri_local(c)))
    individual = lambda c: _uri(F.concat(F.lit(f"{base}id/"), uri_local(F.col(c))))
    relation = _uri(F.concat(F.lit(code), uri_local(F.col("rel_type"))))
    said = lambda df, s, p, o: df.select(F.concat_ws(" ", s, p, o, F.lit(".")).alias("triple"))
    a, label = _uri(RDF + "type"), _uri(RDFS + "label")
    types = nodes.select(kind.alias("t")).distinct()
    kinds = edges.filter("rel_type <> ''").select("rel_type").distinct()
    stated = edges.filter("rel_type <> ''")
    parts = [
        said(types, class_uri(F.col("t")), a, _uri(OWL + "Class")),
        said(types.filter("t <> 'Thing'"), class_uri(F.col("t")), label, _literal(F.col("t"))),
        said(kinds, relation, a, _uri(OWL + "ObjectProperty")),
        said(kinds, relation, label, _literal(F.col("rel_type"))),
        said(kinds.filter(F.col("rel_type").isin(*transitive)), relation, a, _uri(OWL + "TransitiveProperty")),
        said(nodes, individual("id"), a, class_uri(kind)),
        said(nodes.filter("name IS NOT NULL"), individual("id"), label, _literal(F.col("name"))),
        said(stated, individual("source_id"), relation, individual("target_id")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    # Dealt by triple before repeats go: a task's table of triples holds its share of them, not what its splits of the input make.
    return out.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "triple").distinct()


def write_ontology(nodes: DataFrame, edges: DataFrame, path: str, **options) -> None:
    """The triples as a folder of N-Triples files."""
    ontology_triples(nodes, edges, **options).write.mode("overwrite").text(path)
