"""Tables written between steps: the library's own store."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from loomgraph.store import dropped, scope, shared_dir, staged

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Whole texts go to Python at most ``rows`` at a time in what runs inside the block: a task and its worker hold two such batches."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


__all__ = ["dropped", "scope", "shared_dir", "small_batches", "staged"]
