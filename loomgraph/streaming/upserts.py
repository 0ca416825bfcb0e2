"""Incremental upserts of graph tables from a stream of fact files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from loomgraph.sources.code import upsert
from loomgraph.sources.merge import merge_batch


def follow(spark: SparkSession, folder: str, schema: StructType, target: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Every new Parquet file of ``folder`` is merged by key into ``target``: each batch writes the next version of the table.

    Within a batch, the last of equal keys in the order of all columns wins. A batch that runs
    again writes the same version again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        old = spark.read.schema(schema).parquet(f"{target}/v{number - 1}") if number else batch.limit(0)
        new = upsert(old, batch, keys).drop("created")
        new.write.mode("overwrite").parquet(f"{target}/v{number}")

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_merged(spark: SparkSession, folder: str, schema: StructType, root: str, keys: list[str], checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Every new Parquet file of ``folder`` is merged by key into the bucketed table ``root``: a batch rewrites the buckets of its keys only, and one that runs again changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        merge_batch(spark, root, batch, keys, number, order)

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
