"""Texts of methods written bottom-up: each level sees what its callees' texts say, within a budget of characters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators.traverse import levels
from loomgraph.store import exists, staged

#: What stands for callees that the budget leaves out. A fixed value.
LEFT_OUT = "- ... 还有 {} 个方法省略"
SHORTEST_LINE = 5


def callee_lines(calls: DataFrame, texts: DataFrame, budget: int = 2000, left_out: str = LEFT_OUT) -> DataFrame:
    """id, callees: a line "- name: text" for each callee that has a text, in the order of their ids, as many as the budget of characters holds, then how many it doesn't.

    calls: source_id, target_id; texts: id, name, text. A caller of very many keeps only as many
    lines as could ever fit before they are sorted.
    """
    known = texts.filter("text <> ''").select(F.col("id").alias("target_id"), F.concat(F.lit("- "), "name", F.lit(": "), "text").alias("line"))
    lines = calls.select("source_id", "target_id").filter("source_id <> target_id").distinct().join(known.hint("merge"), "target_id")
    in_order = W.partitionBy("source_id").orderBy("target_id")
    first = lines.withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= budget // SHORTEST_LINE + 1)
    spent = first.withColumn("spent", F.sum(F.length("line")).over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    kept = spent.filter(F.col("spent") <= budget).groupBy("source_id").agg(F.count("*").alias("kept"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("lines"))
    every = lines.groupBy("source_id").agg(F.count("*").alias("n"))
    more = F.col("n") - F.coalesce("kept", F.lit(0))
    before, after = left_out.split("{}")
    rest = F.when(more > 0, F.array(F.concat(F.lit(before), more.cast("string"), F.lit(after)))).otherwise(F.array().cast("array<string>"))
    return every.join(kept.hint("merge"), "source_id", "left").select(F.col("source_id").alias("id"), F.array_join(F.concat(F.coalesce("lines", F.array().cast("array<string>")), rest), "\n").alias("callees"))


def write_bottom_up(methods: DataFrame, calls: DataFrame, text: Callable[[Column, Column], Column], store: str, budget: int = 2000, left_out: str = LEFT_OUT) -> DataFrame:
    """id, name, text, level of every method, written level by level to the folder ``store``.

    methods: id, name, code. ``text`` makes a method's text of its code and its callees' lines (empty without any). A level whose
    folder is complete isn't written again, so that a run that was cut goes on where it stopped; the
    methods and calls must be the same ones. Methods of a cycle share a level and don't see each other's texts.
    """
    spark = methods.sparkSession
    known = calls.join(methods.select(F.col("id").alias("source_id")).hint("merge"), "source_id", "left_semi").join(methods.select(F.col("id").alias("target_id")).hint("merge"), "target_id", "left_semi")
    placed = staged(methods.select("id", "name", "code").join(levels(known, methods.select("id")).select("id", "level").hint("merge"), "id"), "placed", "level")
    last = placed.agg(F.max("level")).first()[0]
    schema = "id string, name string, text string"
    done: list[DataFrame] = []
    for level in range(0 if last is None else last + 1):
        path = f"{store}/level={level}"
        if not exists(spark, f"{path}/_SUCCESS"):
            own = placed.filter(F.col("level") == level)
            if done:
                below = done[0]
                for more in done[1:]:
                    below = below.unionByName(more)
                own = own.join(callee_lines(known.join(own.select(F.col("id").alias("source_id")).hint("merge"), "source_id", "left_semi"), below, budget, left_out).hint("merge"), "id", "left")
            else:
                own = own.withColumn("callees", F.lit(""))
            own.select("id", "name", text(F.coalesce("code", F.lit("")), F.coalesce("callees", F.lit(""))).alias("text")).write.mode("overwrite").parquet(path)
        done.append(spark.read.schema(schema).parquet(path))
    out = [d.withColumn("level", F.lit(i)) for i, d in enumerate(done)]
    if not out:
        return spark.createDataFrame([], schema + ", level int")
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]
