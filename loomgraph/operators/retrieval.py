"""Exact vector search, hybrid reranking and lexical scores."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.text import soft_tokens, whole_word
from loomgraph.functions.vectors import cosine, hash_embedding

TEXT_WEIGHT, IDENT_WEIGHT = 0.42, 0.28
SLICE_ROWS = 2048


def fitting(vectors: DataFrame, column: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Vectors of ``dim`` numbers or more, cut to ``dim``; and the rows rejected for being shorter."""
    size = F.coalesce(F.size(column), F.lit(-1))
    return vectors.filter(size >= dim).withColumn(column, F.slice(column, 1, dim)), vectors.filter(size < dim)


def top_k(vectors: DataFrame, query: list[float], k: int, key: str, column: str) -> DataFrame:
    """key, score of the k nearest by exact cosine; ties by key. One pass and a top-k, no sort of all rows."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, F.round(cosine(F.col(column), q), 4).alias("score")).orderBy(F.desc("score"), key).limit(k)


def nearest_to(vectors: DataFrame, asked: object, k: int, key: str, column: str) -> DataFrame:
    """key, score of the k rows nearest to the row whose key is ``asked``; no row where there is none."""
    one = vectors.filter(F.col(key) == asked).select(F.col(column).alias("_q")).limit(1)
    scored = vectors.crossJoin(F.broadcast(one)).select(key, F.round(cosine(F.col(column), F.col("_q")), 4).alias("score"))  # one row
    return scored.orderBy(F.desc("score"), key).limit(k)


def merge_best(*hits: DataFrame, most: int | None = None) -> DataFrame:
    """id, score: the best score of each id over some hit lists, 0 at least."""
    every = hits[0].select("id", "score")
    for more in hits[1:]:
        every = every.union(more.select("id", "score"))
    best = every.groupBy("id").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))
    return best.orderBy(F.desc("score"), "id").limit(most) if most else best


def search_text(texts: DataFrame, query: str, k: int, key: str = "id") -> DataFrame:
    """key, score of the k texts nearest to a query by their hash embeddings. texts: key, text."""
    q = hash_embedding(F.lit(query))
    return texts.select(key, F.round(cosine(hash_embedding(F.col("text")), q), 4).alias("score")).orderBy(F.desc("score"), key).limit(k)


def hybrid_search(hits: list[DataFrame], texts: DataFrame, terms: list[str], k: int, recall: int = 9, pool: int = 160) -> DataFrame:
    """id, score: hit lists merged into a pool of min(max(recall * k, k), pool), then reranked by the terms. texts: id, text, ident."""
    merged = merge_best(*hits, most=min(max(recall * k, k), pool))
    return rerank(merged.join(texts, "id", "left").select("id", "score", "text", "ident"), terms, k)


def _half_up(x: np.ndarray) -> np.ndarray:
    """Four digits, halves away from zero, as the JVM rounds the shortest decimal of a double."""
    scaled = np.abs(x) * 1e4
    out = np.sign(x) * np.floor(scaled + 0.5) / 1e4 + 0.0
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.0001"), ROUND_HALF_UP)) + 0.0
    return out


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sizes) of a list column: doubles, filled up with zeros; size -1 where the list or a component is null."""
    rows = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    sizes = rows.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(int)
    flat = rows.flatten()
    if flat.null_count:
        holes = pc.list_parent_indices(rows).to_numpy()[flat.is_null().to_numpy(zero_copy_only=False)]
    else:
        holes = np.array([], int)
    numbers, width = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(float), max(0, sizes.max(initial=0))
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = numbers
    sizes[holes] = -1
    return out, sizes


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths, added up from the first component to the last as the JVM does; so are the products below."""
    return np.sqrt(np.cumsum(x * x, axis=1)[:, -1]) if x.shape[1] else np.zeros(len(x))


def _nearest_of_task(asked: pa.Table, k: int, key: str, column: str):
    """Keeps the k nearest rows of each question. A product of matrices finds those that may be among them; only their scores are computed exactly."""
    items = np.array(asked.column("item").to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            q, q_sizes = _matrix(asked.column("q"))
            q_norms = _norms(q)
            q_plain = np.isfinite(q_norms) & (q_norms >= 1e-9)
            held: list[list[tuple]] = [[] for _ in items]  # (-score, key), NaN before all others as in Spark
            least, kind = np.full(len(items), -np.inf), None
            for whole in batches:
                kind = whole.schema.field(key).type
                for at in range(0, whole.num_rows, SLICE_ROWS):
                    batch = whole.slice(at, SLICE_ROWS)
                    keys = np.array(batch.column(key).to_pylist())
                    order = np.argsort(keys, kind="stable")
                    keys, (x, x_sizes) = keys[order], _matrix(batch.column(column).take(pa.array(order)))
                    x_norms = _norms(x)
                    x_plain = np.isfinite(x_norms) & (x_norms >= 1e-9)
                    low, high = np.searchsorted(keys, items, "left"), np.searchsorted(keys, items, "right")
                    for size in np.unique(q_sizes):
                        own = np.flatnonzero(q_sizes == size)
                        fit = (x_sizes == size) & (size > 0)
                        width = max(int(size), 0)
                        a, b = q[own, :width], x[:, :width] if x.shape[1] >= width else np.zeros((len(x), width))
                        rough = np.where(q_plain[own, None], a / q_norms[own, None], 0.0) @ np.where((x_plain & fit)[:, None], b / x_norms[:, None], 0.0).T
                        rough[:, fit & ~np.isfinite(x_norms)] = np.inf  # not to be told by the product
                        rough[~np.isfinite(q_norms[own])] = np.inf
                        for i in np.flatnonzero(high[own] > low[own]):
                            rough[i, low[own[i]] : high[own[i]]] = -np.inf
                        floor = least[own]
                        if np.isneginf(floor).any() and len(keys) > k:
                            floor = np.maximum(floor, np.partition(rough, len(keys) - k, axis=1)[:, len(keys) - k])
                        hits = (rough >= (floor - 2e-4)[:, None]) & ~np.isneginf(rough)
                        for i in np.flatnonzero(hits.any(axis=1)):
                            at_, j = own[i], np.flatnonzero(hits[i])
                            exact = np.cumsum(b[j] * a[i], axis=1)[:, -1] / (q_norms[at_] * x_norms[j]) if width else np.zeros(len(j))
                            exact = np.where(fit[j] & ~(x_norms[j] < 1e-9) & ~(q_norms[at_] < 1e-9), exact, 0.0)
                            scores = np.where(np.isnan(exact), np.inf, _half_up(np.where(np.isnan(exact), 0.0, exact)))
                            first = np.argsort(-scores, kind="stable")[:k]
                            held[at_] = sorted(held[at_] + [(-float(scores[f]), keys[j[f]].item() if hasattr(keys[j[f]], "item") else keys[j[f]]) for f in first])[:k]
                            if len(held[at_]) == k:
                                least[at_] = min(-held[at_][-1][0], 2.0)
        rows = [(i, key_, np.nan if np.isinf(score) else -score + 0.0) for i, own in enumerate(held) for score, key_ in own]
        if rows:
            places, found, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays([asked.column("item").combine_chunks().take(pa.array(places)), pa.array(found, kind), pa.array(scores, pa.float64())], names=["item", key, "score"])

    return run


def top_k_of_queries(vectors: DataFrame, asked: DataFrame, k: int, key: str, column: str, at_once: int = 4096) -> DataFrame:
    """item, key, score: the k nearest of every asked row (item, q) among all others, by exact cosine.

    The asked rows are dealt into blocks of about ``at_once``, each of which is sent to all tasks; a task keeps k hits
    of an item, and only those are shuffled. No row is made for a pair.
    """
    asked = asked.filter("item IS NOT NULL").select("item", "q")
    kept = vectors.filter(F.col(key).isNotNull()).select(key, column)
    blocks = max(1, -(-asked.count() // at_once))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    out = None
    for block in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow()  # about at_once vectors
        if some.num_rows or (out is None and block == blocks - 1):
            best = kept.mapInArrow(_nearest_of_task(some, k, key, column), f"item {kind(asked, 'item')}, `{key}` {kind(vectors, key)}, score double")
            out = best if out is None else out.union(best)
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), key))  # over k rows of each task
    return out.withColumn("rn", rank).filter(F.col("rn") <= k).drop("rn")


def rerank(hits: DataFrame, terms: list[str], k: int) -> DataFrame:
    """id, score: vector score plus weighted shares of the terms found as whole words in text and identifier.

    hits: id, score, text, ident.
    """
    def share(column: str):
        flat = soft_tokens(F.coalesce(F.col(column), F.lit("")))
        found = [whole_word(F.lit(t), flat).cast("int") for t in terms]
        return sum(found[1:], found[0]) / len(found) if found else F.lit(0.0)

    score = F.col("score") + TEXT_WEIGHT * share("text") + IDENT_WEIGHT * share("ident")
    return hits.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
