"""Nearest vectors of many questions at once, under filters of ids and levels; each task keeps a bounded list of each question."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.ids import method_id

SLICE_ROWS = 2048


def _unit(rows: list[list[float] | None], dim: int) -> np.ndarray:
    """The vectors at length one; zeros for those that are missing, of another size, or all but zero."""
    out = np.zeros((len(rows), dim))
    for i, row in enumerate(rows):
        if row is not None and len(row) == dim:
            v = np.array(row, float)
            norm = float(np.sqrt(v @ v)) if np.isfinite(v).all() else 0.0
            if norm >= 1e-9:
                out[i] = v / norm
    return out


def _best_of_task(questions: list[tuple], k: int):
    """Keeps the best score of each id, and of these the k best of each question (by score, then id)."""
    dim = len(questions[0][1])
    asked = _unit([q for _, q in questions], dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[dict[str, float]] = [{} for _ in questions]

        def trimmed(held: dict[str, float]) -> dict[str, float]:
            return dict(heapq.nsmallest(k, held.items(), key=lambda x: (-x[1], x[0])))

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                ids = batch.column("id").to_pylist()
                scores = np.round(asked @ _unit(batch.column("vector").to_pylist(), dim).T, 4) + 0.0
                for i, held in enumerate(best):
                    least = min(held.values()) if len(held) >= k else -np.inf
                    for j in np.flatnonzero(scores[i] >= least).tolist():
                        score = float(scores[i, j])
                        if score > held.get(ids[j], -np.inf):
                            held[ids[j]] = score
                    if len(held) > k:
                        best[i] = trimmed(held)
        rows = [(questions[i][0], id_, score) for i, held in enumerate(best) for id_, score in held.items()]
        if rows:
            items, ids, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(ids, pa.string()), pa.array(scores, pa.float64())], names=["item", "id", "score"])

    return run


def search_many(vectors: DataFrame, questions: DataFrame, k: int, wanted: Column | None = None, ids: DataFrame | None = None, at_once: int = 512) -> DataFrame:
    """item, id, score: the k nearest ids of every question by cosine, rounded to four digits; ties by id.

    vectors: id, vector, and what ``wanted`` reads; an id may have several rows, of which the best counts. questions:
    item (text), vector. wanted: a condition on the rows; ids: a table of the ids that may be found. If they leave
    no row at all, all rows are searched. Questions go out in blocks of ``at_once``; a task holds k ids for each of
    them, and only those are shuffled. Questions that are null or of no direction score 0 with everything.
    """
    kept = vectors.filter(wanted) if wanted is not None else vectors
    kept = kept.join(ids.select("id").distinct(), "id", "left_semi") if ids is not None else kept
    if (wanted is not None or ids is not None) and kept.isEmpty():
        kept = vectors
    blocks = max(1, -(-questions.count() // at_once))
    dim = questions.agg(F.max(F.size("vector")).alias("n")).first()["n"] or 0
    out = None
    for block in range(blocks):
        own = [(r["item"], r["vector"] if r["vector"] is not None and len(r["vector"]) == dim else [0.0] * dim) for r in questions.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select(F.col("item").cast("string").alias("item"), "vector").collect()]  # about at_once rows
        if own:
            found = kept.select(F.col("id").cast("string").alias("id"), "vector").filter("id IS NOT NULL").mapInArrow(_best_of_task(own, k), "item string, id string, score double")
            out = found if out is None else out.unionByName(found)
    if out is None:
        return questions.sparkSession.createDataFrame([], "item string, id string, score double")
    best = out.groupBy("item", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "id"))  # over k rows of each task
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def business_hits(texts: DataFrame, questions: DataFrame, k: int, level: str = "api", ids: DataFrame | None = None) -> DataFrame:
    """item, id, score: methods of a level among stored texts, under one spelling of their ids. texts: id, level, vector."""
    method = F.col("id").startswith("method://") | F.col("id").startswith("method//")
    spelled = texts.select(F.when(method, method_id(F.col("id"))).otherwise(F.col("id")).alias("id"), F.lower(F.trim("level")).alias("level"), "vector")
    return search_many(spelled, questions, k, (F.col("level") == level) & F.col("id").startswith("method://"), ids)
