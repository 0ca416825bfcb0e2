"""Tables that are merged by key batch by batch: rows lie in buckets of their key, and a batch rewrites the buckets that it touches.

A table is a folder of data folders, one for each batch, with a part for each bucket, and of
manifests: ``manifests/<batch>`` names the data folder of each bucket as of that batch. The manifest is
written last and makes the batch count; a batch that is not newer than the last manifest changes nothing, so that it
may run again. Readers open the newest manifest. Data folders that no kept manifest names go.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgraph.store import listed, read_text, removed, write_text

BUCKETS = 64


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _manifests(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(x) for x in listed(spark, f"{root}/manifests") if x.isdigit())


def _manifest(spark: SparkSession, root: str, number: int) -> dict:
    return json.loads(read_text(spark, f"{root}/manifests/{number}"))


def _stored(spark: SparkSession, root: str, schema: StructType, buckets: dict[str, str]) -> DataFrame:
    paths = [f"{root}/{data}/bucket={bucket}" for bucket, data in buckets.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_merged(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The table as of its last batch; an empty one before any."""
    numbers = _manifests(spark, root)
    return _stored(spark, root, schema, _manifest(spark, root, numbers[-1])["buckets"] if numbers else {})


def last_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; null keys are equal. Rows of equal order go by their JSON, so that the choice never depends on the partitions."""
    every = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.max_by(every, F.struct(*order, F.to_json(every, {"ignoreNullFields": "false"}))).alias("_row")).select("_row.*")


def merge_batch(spark: SparkSession, root: str, batch: DataFrame, keys: list[str], number: int, order: str | None = None, buckets: int = BUCKETS, kept: int = 2, most_chars: dict[str, int] | None = None) -> bool:
    """Merges a batch by key; False if it was merged before.

    order: the column of arrival; of equal keys the row with the greatest value stays, whether new or
    stored, a new one if they are equal. most_chars: lengths to which texts are cut. kept: how many manifests stay for readers.
    """
    numbers = _manifests(spark, root)
    if numbers and number <= numbers[-1]:
        return False
    before = _manifest(spark, root, numbers[-1]) if numbers else {"buckets": {}, "of": buckets}
    buckets = before["of"]
    cut = most_chars or {}
    new = batch.select(*[F.substring(c, 1, cut[c]).alias(c) if c in cut else F.col(c) for c in batch.columns]).withColumn("bucket", _bucket(keys, buckets))
    touched = [str(r["bucket"]) for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if touched:
        data = f"data-{number}"
        old = _stored(spark, root, batch.schema, {b: d for b, d in before["buckets"].items() if b in touched})
        arrival = [F.col(order)] if order else []
        both = old.withColumn("bucket", _bucket(keys, buckets)).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        merged = last_of_each(both, keys, [*arrival, F.col("_new")]).drop("_new")
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{data}")
        before["buckets"] |= dict.fromkeys(touched, data)
    write_text(spark, f"{root}/manifests/{number}", json.dumps({"buckets": before["buckets"], "of": buckets}))
    for gone in _manifests(spark, root)[:-kept]:
        removed(spark, f"{root}/manifests/{gone}")
    named = {d for n in _manifests(spark, root) for d in _manifest(spark, root, n)["buckets"].values()}
    for folder in listed(spark, root):
        if folder.startswith("data-") and folder not in named and int(folder[5:]) <= number:
            removed(spark, f"{root}/{folder}")
    return True


def with_created(batch: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of a batch, each once, and whether the stored table lacks them."""
    asked = batch.select(*keys).distinct()
    known = stored.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_known", F.lit(True))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return asked.join(known, same, "left").select(*keys, F.col("_known").isNull().alias("created"))


def inferred_edges_table(edges: DataFrame) -> DataFrame:
    """Inferred edges as a batch to be merged on all but ``inferred``: each once."""
    return edges.filter("inferred").select("source_id", "target_id", "rel_type", "inferred").distinct()

