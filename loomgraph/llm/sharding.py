"""Sharding by a Feistel permutation of global row numbers.

Row numbers 0..n-1 follow the order (doc_id, size, crc32), nulls first. A keyed Feistel
network permutes the smallest power-of-four domain that holds n; values outside 0..n-1 walk
the cycle until they fall inside. The permuted position p gives shard ``p % shards`` and
slot ``p // shards``: shards differ by one row at most, slots have no gaps, and both
directions can be computed from the row number alone.

Defined cases: a null text has size 1 and crc32 0; a null doc_id sorts first; repeated rows
get consecutive row numbers (which of two equal rows gets which is immaterial, their output
columns agree); a very long text is measured and hashed where it lies and never moves; an empty
table gives an empty result; columns of the input besides doc_id
and text are ignored, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._store import staged

ROUNDS = 8


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(28))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _half_bits(n: int) -> int:
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _rounds(x: np.ndarray, n: int, seed: int, order: range) -> np.ndarray:
    half = _half_bits(n)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _mix(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(seed % 2**63) * np.uint64(ROUNDS) + np.uint64(1))
    left, right = x >> shift, x & mask
    forward = order.step > 0
    for r in order:
        if forward:
            left, right = right, left ^ (_mix(right ^ keys[r]) & mask)
        else:
            left, right = right ^ (_mix(left ^ keys[r]) & mask), left
    return (left << shift) | right


def _walk(x: np.ndarray, n: int, seed: int, order: range) -> np.ndarray:
    y = _rounds(x.astype(np.uint64), n, seed, order)
    out = np.flatnonzero(y >= n)
    while len(out):
        y[out] = _rounds(y[out], n, seed, order)
        out = out[y[out] >= n]
    return y.astype(np.int64)


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Positions of the row numbers ``x`` in the shuffled order of n rows."""
    return _walk(x, n, seed, range(0, ROUNDS))


def unpermute(y: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Row numbers at the positions ``y``."""
    return _walk(y, n, seed, range(ROUNDS - 1, -1, -1))


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number that lies in a shard's slot."""
    return int(unpermute(np.array([slot * shards + shard]), n, seed)[0])


def number_rows(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``row_number`` 0..n-1 in the order of ``keys``, and n.

    The rows are written, range-partitioned and sorted; each partition numbers its own rows
    and adds the row count of the partitions before it, which is a table of one row for each
    partition. The last sort key is the row's place in the written table: it spreads equal
    rows over partitions, and a task that runs again deals them out as before.
    """
    placed = staged(rows, "rows").withColumn("_place", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(*keys, "_place").sortWithinPartitions(*keys, "_place").drop("_place")
    local = ordered.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id"))
    local = staged(local.withColumn("_local", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id"), "numbered")
    counts = {r["_part"]: r["n"] for r in local.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts, n = [], 0
    for part in sorted(counts):
        starts.append((part, n))
        n += counts[part]
    base = rows.sparkSession.createDataFrame(starts, "_part int, _base long")
    # One row for each partition of the sort: bounded by the number of tasks of one stage.
    numbered = local.join(F.broadcast(base), "_part").withColumn("row_number", F.col("_base") + F.col("_local"))
    return numbered.drop("_part", "_base", "_local"), n


def assign_shards(docs: DataFrame, shards: int = 16, seed: int = 20240229) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot for each row of ``docs``."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    numbered, n = number_rows(sized, ["doc_id", "size", "text_crc32"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = permute(batch.column("row_number").to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array((at % shards).astype(np.int32)), pa.array(at // shards)],
                names=[*batch.schema.names, "shard", "slot"],
            )

    return numbered.mapInArrow(place, "doc_id long, size long, text_crc32 long, row_number long, shard int, slot long")


def op6_feistel_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents dealt over 16 shards by the ``rows`` law."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
