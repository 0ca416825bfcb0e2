"""Statements of mapper XML as annotated SQL: conditions, loops, choices and included fragments in the order of the document."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.store import dropped, staged

STATEMENTS = ("select", "insert", "update", "delete")

# What a tag is announced by, from its attributes; containers that add nothing are empty.
HEADINGS = {
    "if": "-- [条件] 当 {test} 时:",
    "where": "WHERE",
    "set": "SET",
    "choose": "-- [分支选择]:",
    "when": "-- [当 {test}]:",
    "otherwise": "-- [否则]:",
    "include": "-- [引用 SQL 片段] {refid}",
    "selectKey": "-- [主键生成] {keyProperty}",
    "bind": "-- [变量绑定] {name} = {value}",
}
LOOP, SEPARATED, WRAPPED = "-- [循环] 遍历 {collection} 中的每个 {item}", "，以 '{separator}' 分隔", "，包裹在 {open}...{close} 中"
DEFAULTS = {"collection": "?", "item": "item", "refid": "?"}

Line = tuple[int, str, str | None]  #: depth, text, refid of an include


class _Attributes(dict):
    def __missing__(self, key: str) -> str:
        return DEFAULTS.get(key, "")


def _texts(text: str | None, depth: int) -> Iterator[Line]:
    for line in (text or "").split("\n"):
        if line.strip():
            yield depth, line.strip(), None


def _loop_heading(own: _Attributes) -> str:
    more = (SEPARATED if own["separator"] else "") + (WRAPPED if own["open"] or own["close"] else "")
    return (LOOP + more + ":").format_map(own)


def annotated(element: ET.Element, depth: int = 0) -> Iterator[Line]:
    """The lines of an element: its text, and each child under its heading, one step deeper."""
    yield from _texts(element.text, depth)
    for child in element:
        own, tag = _Attributes(child.attrib), child.tag
        if tag == "trim":
            yield from _texts(own["prefix"], depth)
            yield from annotated(child, depth)
            yield from _texts(own["suffix"], depth)
        elif tag == "foreach":
            yield depth, _loop_heading(own), None
            yield from annotated(child, depth + 1)
        elif tag in HEADINGS:
            yield depth, HEADINGS[tag].format_map(own), own["refid"] if tag == "include" else None
            if tag not in ("include", "bind"):
                yield from annotated(child, depth + 1)
        elif isinstance(tag, str):
            yield from _texts((child.text or "").strip(), depth)
        yield from _texts(child.tail, depth)


_FIELDS = [("kind", pa.string()), ("namespace", pa.string()), ("id", pa.string()), ("op", pa.string()), ("at", pa.int32()), ("depth", pa.int32()), ("line", pa.string()), ("refid", pa.string())]


def mapper_lines(files: DataFrame) -> DataFrame:
    """kind (statement or fragment), namespace, id, op, at, depth, line, refid of every line of the mappers in the column text; texts that aren't XML give none."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                try:
                    root = ET.fromstring(text or "")
                except ET.ParseError:
                    continue
                space = root.get("namespace") or ""
                for e in root.iter():
                    if e.get("id") and (e.tag in STATEMENTS or e.tag == "sql"):
                        kind = "fragment" if e.tag == "sql" else "statement"
                        rows += [(kind, space, e.get("id"), e.tag, i, depth, line, ref) for i, (depth, line, ref) in enumerate(annotated(e))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(list(zip(*rows)) or [[]] * len(_FIELDS), _FIELDS)], names=[n for n, _ in _FIELDS])

    # A few MB of a table can hold very many files: they are parsed in four tasks for each slot, not in one for each split.
    dealt = files.select("text").repartition(4 * files.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(parse, "kind string, namespace string, id string, op string, at int, depth int, line string, refid string")


def annotated_statements(files: DataFrame, with_includes: bool = True) -> DataFrame:
    """namespace, statement_id, op, sql, missing of every statement; ``missing`` are references that no file defines.

    An include is followed by the fragment's own lines, one step deeper, wherever it is defined: a name
    without a namespace is looked up in the statement's file's namespace. A fragment that would come again within itself is
    only named. Lines are joined round by round, one for each depth of includes; of fragments that are
    defined several times the first by their text counts.
    """
    lines = staged(mapper_lines(files), "mapper")
    of_fragment = lines.filter("kind = 'fragment'").groupBy("namespace", "id", "line", "at", "depth", "refid").agg(F.lit(1).alias("_")).drop("_")
    whole = of_fragment.groupBy("namespace", "id").agg(F.sort_array(F.collect_set(F.struct("at", "depth", "line", "refid"))).alias("body"))
    whole = whole.select(F.concat_ws(".", "namespace", "id").alias("ref"), F.col("namespace").alias("home"), "body")
    full = lambda space: F.when(F.col("refid").contains("."), F.col("refid")).when(F.col("refid").isNotNull(), F.concat_ws(".", space, "refid"))
    start = lines.filter("kind = 'statement'").select("namespace", F.col("id").alias("statement_id"), "op", F.array("at").alias("path"), "depth", "line", full(F.col("namespace")).alias("ref"), F.array().cast("array<string>").alias("within"))
    done, now, missing = [start.drop("ref", "within")], start.filter("ref IS NOT NULL"), []
    while with_includes:
        now = staged(now, "includes")
        if now.isEmpty():
            dropped(now)
            break
        joined = now.join(whole, "ref", "left")
        missing.append(joined.filter("body IS NULL").select("namespace", "statement_id", "ref"))
        body = joined.filter("body IS NOT NULL AND NOT array_contains(within, ref)")
        inner = body.select("namespace", "statement_id", "op", "path", F.col("depth").alias("outer"), "home", F.concat("within", F.array("ref")).alias("within"), F.explode("body").alias("x"))
        step = inner.select("namespace", "statement_id", "op", F.concat("path", F.array("x.at")).alias("path"), (F.col("outer") + 1 + F.col("x.depth")).alias("depth"), F.col("x.line").alias("line"), F.col("x.refid").alias("refid"), "home", "within")
        step = step.select("namespace", "statement_id", "op", "path", "depth", "line", full(F.col("home")).alias("ref"), "within")
        done.append(step.drop("ref", "within"))
        now = step.filter("ref IS NOT NULL")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    text = every.groupBy("namespace", "statement_id", "op").agg(F.sort_array(F.collect_list(F.struct("path", F.concat(F.repeat(F.lit("  "), F.col("depth")), "line").alias("line")))).alias("lines"))
    out = text.select("namespace", "statement_id", "op", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("sql"))
    none = F.array().cast("array<string>")
    if not missing:
        return out.withColumn("missing", none)
    gone = missing[0]
    for more in missing[1:]:
        gone = gone.unionByName(more)
    gone = gone.groupBy("namespace", "statement_id").agg(F.sort_array(F.collect_set("ref")).alias("missing"))
    return out.join(gone, ["namespace", "statement_id"], "left").withColumn("missing", F.coalesce("missing", none))
