"""Readers for a code base: source files, structure facts, DDL, mapper statements."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import one_line, sql_columns, sql_tables
from loomgraph.sources.merge import last_of_each

FACTS_SCHEMA = (
    "entities array<struct<id: string, type: string, name: string, location: string, module_id: string, language: string, attributes: map<string, string>>>, "
    "relations array<struct<type: string, source_id: string, target_id: string, attributes: map<string, string>>>, meta map<string, string>"
)
LANGUAGES = {"java": "java", "kt": "kotlin", "py": "python", "xml": "xml", "sql": "sql"}


def source_files(spark: SparkSession, root: str, pattern: str = "*", excluded: tuple[str, ...] = (".git", "node_modules")) -> DataFrame:
    """path, language, text of the files under root, without those in an excluded folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    kept = files.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, excluded))))
    return kept.select("path", language(F.col("path")).alias("language"), F.decode("content", "UTF-8").alias("text"))


def language(path: Column) -> Column:
    """Language by file suffix, null for an unknown one."""
    suffix = F.regexp_extract(path, r"\.([^./]+)$", 1)
    return F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))[suffix]


def module_of(path: Column, modules: list[tuple[str, str]]) -> Column:
    """The first module whose id is the first segment or whose folder's name begins the path; else the only module there is, else the first segment; null without modules.

    modules: (id, folder), the folder empty if it isn't known. Backslashes count as slashes in segments.
    """
    first = F.substring_index(F.translate(path, "\\", "/"), "/", 1)
    out = F.lit(None).cast("string") if not modules else F.lit(modules[0][0]) if len(modules) == 1 else first
    for module, folder in reversed(modules):
        out = F.when((first == module) | (path.startswith(folder) if folder else F.lit(False)), module).otherwise(out)
    return out


def read_facts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of structure-facts JSON files."""
    facts = spark.read.schema(FACTS_SCHEMA).option("multiLine", True).json(path)
    nodes = facts.select(F.inline("entities")).select("id", F.col("type").alias("entity_type"), "name", "location", "module_id", "language", "attributes")
    edges = facts.select(F.inline("relations")).select("source_id", "target_id", F.col("type").alias("rel_type"), "attributes")
    return nodes, edges


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str, version: str) -> None:
    """Nodes, edges and a row of meta data as Parquet."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    meta = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges"))).withColumn("version", F.lit(version))
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "meta"))  # type: ignore[return-value]


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with rows of the same keys replaced by new ones; created tells rows that are new. Null keys are equal.

    Of equal keys in new the last in the order of all columns but maps wins, then the last by its JSON.
    """
    plain = [F.col(f.name) for f in new.schema.fields if "map" not in f.dataType.simpleString()]
    last = last_of_each(new, keys, plain)
    known = old.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_old", F.lit(True))
    same = lambda a, b: reduce(lambda x, y: x & y, (F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")) for k in keys))
    created = last.join(known, same("", "_"), "left").select(*new.columns, F.col("_old").isNull().alias("created"))
    replaced = last.select(*[F.col(k).alias(f"_{k}") for k in keys])
    return old.join(replaced, same("", "_"), "left_anti").withColumn("created", F.lit(False)).unionByName(created)


def without_orphans(stored: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """The stored rows whose key the facts still have."""
    return stored.join(facts.select(key).distinct(), key, "left_semi")


def write_facts(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The facts as JSON lines: entities and relations in folders of their own."""
    nodes.write.mode("overwrite").json(f"{path}/entities")
    edges.write.mode("overwrite").json(f"{path}/relations")


def write_stats(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes, edges: their numbers, as one JSON line."""
    nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges"))).coalesce(1).write.mode("overwrite").json(path)


_QUOTES = "'\"`"


def _outside_quotes(text: str) -> list[bool]:
    """Whether each character lies outside of quotes (and is none)."""
    out, quote = [], ""
    for c in text:
        if quote:
            out.append(False)
            quote = "" if c == quote else quote
        else:
            out.append(c not in _QUOTES)
            quote = c if c in _QUOTES else ""
    return out


def _columns_of(body: str) -> list[tuple[str, str]]:
    """(column, type) of the parts of a CREATE TABLE: parentheses and commas count outside of quotes only."""
    plain = _outside_quotes(body + ",")
    parts, depth, start = [], 0, 0
    for i, c in enumerate(body + ","):
        if not plain[i]:
            continue
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(body[start:i].strip())
            start = i + 1
    out = []
    for part in parts:
        m = re.match(r"(`[^`]+`|\"[^\"]+\"|\S+)\s+([\w.]+(?:\s*\([^)]*\))?)", part)
        if m and m[1].upper() not in {"PRIMARY", "KEY", "UNIQUE", "INDEX", "CONSTRAINT", "FOREIGN", "FULLTEXT", "CHECK"}:
            out.append((m[1].strip("`\""), m[2]))
    return out


def ddl_columns(files: DataFrame) -> DataFrame:
    """table, ordinal, column, type of every CREATE TABLE in the text column; parentheses are balanced."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = re.compile(r"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?[`\"]?([\w.]+)[`\"]?\s*\(")
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                for m in head.finditer(text or ""):
                    plain, depth, end = _outside_quotes(text[m.end() :]), 1, m.end()
                    while end < len(text) and depth:
                        depth += plain[end - m.end()] * ((text[end] == "(") - (text[end] == ")"))
                        end += 1
                    rows += [(m[1], i, c, t) for i, (c, t) in enumerate(_columns_of(text[m.end() : end - 1]))]
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], names=["table", "ordinal", "column", "type"])

    return files.select("text").mapInArrow(parse, "table string, ordinal int, column string, type string")


def mapper_statements(files: DataFrame, whole: bool = True) -> DataFrame:
    """namespace, statement_id, op, sql of every statement element of mapper XML texts.

    whole: all text inside the element; else only what stands before its first child.
    Texts that aren't XML give no rows.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                try:
                    root = ET.fromstring(text or "")
                except ET.ParseError:
                    continue
                for e in root.iter():
                    if e.tag in ("select", "insert", "update", "delete") and e.get("id"):
                        sql = " ".join("".join(e.itertext() if whole else [e.text or ""]).split())
                        if sql:
                            rows.append((root.get("namespace"), e.get("id"), e.tag, sql))
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["namespace", "statement_id", "op", "sql"])

    return files.select("text").mapInArrow(parse, "namespace string, statement_id string, op string, sql string")


def statement_accesses(statements: DataFrame) -> DataFrame:
    """namespace, statement_id, op, table, columns, sql of each table that a statement names; statements without a namespace or a table have no row.

    statements: as ``mapper_statements`` gives them; sql is cut to 1200 characters.
    """
    named = statements.filter(F.trim("namespace") != "").withColumn("_tables", sql_tables(F.col("sql")))
    return named.select("namespace", "statement_id", "op", F.explode("_tables").alias("table"), sql_columns(F.col("sql"), F.col("op")).alias("columns"), one_line(F.col("sql"), 1200).alias("sql"))


def domain_tables(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """The tables ``domains``, ``capabilities`` and ``terms`` of a project's configuration; sections that are missing give empty ones."""
    own = config.get("domain") or {}
    some = lambda key: [(i, x) for i, x in enumerate(own.get(key) or []) if isinstance(x, dict)]
    text = lambda x, key: str(x.get(key) or "")
    texts = lambda x, key: [str(v) for v in x.get(key) or []]
    rows = {
        "domains": ([(i, text(x, "id"), text(x, "name"), texts(x, "capability_ids")) for i, x in some("business_domains")], "capability_ids array<string>"),
        "capabilities": ([(i, text(x, "id"), text(x, "name"), text(x, "path_pattern")) for i, x in some("capabilities")], "path_pattern string"),
        "terms": ([(i, text(x, "id"), text(x, "name"), texts(x, "synonyms")) for i, x in some("terms")], "synonyms array<string>"),
    }
    return {name: spark.createDataFrame(held, f"ordinal int, id string, name string, {last}") for name, (held, last) in rows.items()}
