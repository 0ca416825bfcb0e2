"""Embedding near-duplicates by NN-descent.

Vectors of equal bytes form a class, and one of each takes part. A neighbour graph starts from
the leaves of random-hyperplane trees and is refined through neighbours of neighbours: each
class brings its neighbours, and a sample of those that have it as neighbour, together; all
pairs among them are compared (one small matrix product), and each keeps what is nearer than
its furthest neighbour so far. Every compared pair of two components that may reach the
threshold is written before lists are trimmed (pairs that others already connect within the
same group are left out); where the exact cosine reaches it, the pair is a link.

A list that is full of links is saturated and hides further ones. Each class therefore keeps
two lists, the ``k`` nearest of its own component and the ``k`` nearest of others: once a
component is known, its members' lists are free for what lies outside of it. Passes of new
trees and rounds go on until one finds no new link between components. Links within
components are counted, not listed: components are cut into blocks, and pairs of blocks are
compared exactly, in double precision; a block pair yields one count for each of its classes,
never a pair.

Recall is audited against brute force: the vectors of every id divisible by 20 are compared
with all rows, ``audit_queries`` of them at a time, and their true numbers of links with those
found. Recall is a mean over queries, taken apart for each magnitude of the true number, so
that large groups don't hide small ones. There are as many trees as a lone pair at the
threshold needs to share a leaf with a chance of ``least_recall``, and more while the audit
falls short of it; after ``most_passes`` (or twice the passes for those trees, if more), or where
no audited vector has a link, all pairs are compared in blocks.

Between tasks travel 8-bit copies of the vectors, which steer the search only.

Defined cases: null vectors, zero vectors and those with null or non-finite components link
with nothing and are their own components; vectors of different lengths never link; repeated
rows are members of one class and linked with each other; rows of one id count as that id's;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._components import components
from loomgraph.llm._store import dropped, staged

LEAF = 24
BLOCK = 512
SLACK = 0.03  # what an 8-bit copy may hide of a cosine


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row (vec_id, cid), cid null where it can't link; every class (cid, dim, size, least, unit, code). Written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, dims, units, codes = [], [], [], []
            for v in batch.column("embedding").to_pylist():
                x = np.array([np.nan if e is None else e for e in v or []], np.float64)
                norm = np.sqrt(x @ x) if len(x) and np.isfinite(x).all() else 0.0
                if not norm > 0 or not np.isfinite(norm):
                    scale = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
                    norm = scale * np.sqrt((x / scale) @ (x / scale)) if scale > 0 else 0.0
                if not norm > 0 or not np.isfinite(norm):
                    cids.append(None), dims.append(None), units.append(None), codes.append(None)
                    continue
                unit = x / norm
                cids.append(int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True))
                dims.append(len(x))
                units.append(unit.tobytes())
                codes.append(np.round(unit * (127 / np.abs(unit).max())).astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cids, pa.int64()), pa.array(dims, pa.int32()), pa.array(units, pa.binary()), pa.array(codes, pa.binary())], names=["vec_id", "cid", "dim", "unit", "code"]
            )

    parts = staged(rows.select("vec_id", "embedding").mapInArrow(run, "vec_id long, cid long, dim int, unit binary, code binary"), "vectors")
    sizes = parts.filter("cid IS NOT NULL").groupBy("cid").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"))
    one = parts.filter("cid IS NOT NULL").select("cid", "dim", "unit", "code").dropDuplicates(["cid"])
    return parts.select("vec_id", "cid"), staged(one.join(sizes, "cid"), "classes")


def _codes(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.int8).reshape(len(raw), -1).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _depth(n: int) -> int:
    return max(1, int(np.ceil(np.log2(max(2, n / LEAF)))))


def _leaves(rooted: DataFrame, trees: int, depth: int, seed: int) -> DataFrame:
    """tree, leaf, cid, root, code: the leaf of each class in each tree of random hyperplanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = pa.table([batch.column(c) for c in ("cid", "root", "code")], names=["cid", "root", "code"]).filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, trees * depth)).astype(np.float32)
                raw = own.column("code").to_pylist()
                bits = (_codes(raw) @ planes[dim] > 0).reshape(len(raw), trees, depth)
                leaf = bits @ (1 << np.arange(depth, dtype=np.int64)) * 65_536 + dim
                for t in range(trees):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), t, np.int32)), pa.array(leaf[:, t]), *(c.combine_chunks() for c in own.columns)], names=["tree", "leaf", "cid", "root", "code"])

    return rooted.select("cid", "dim", "root", "code").mapInArrow(run, "tree int, leaf long, cid long, root long, code binary")


OWN, OTHER, CANDIDATE = 0, 1, 2  # kinds of compared pairs: for a class's list of its own component, of others, and pairs that may be links


def _connecting(sims: np.ndarray, other: np.ndarray, threshold: float) -> np.ndarray:
    """The pairs (rows of two indices) of two components that may be links. Sure ones that a tree of sure ones connects are left out."""
    near = np.tril(other & (sims >= threshold - SLACK), -1)
    if not near.any():
        return np.empty((0, 2), np.int64)
    sure = near & (sims >= threshold + SLACK)
    up = np.where(sure.any(1), sure.argmax(1), np.arange(len(sims)))  # the first sure partner, always of a smaller index
    child = np.flatnonzero(up != np.arange(len(sims)))
    top = up
    while (top[top] != top).any():
        top = top[top]
    return np.vstack([np.stack([child, up[child]], 1), np.argwhere(near & (top[:, None] != top[None, :]))])


def _compare(groups: DataFrame, k: int, threshold: float) -> DataFrame:
    """cid, nbr, sim, kind: the k best of each member of ``m`` (array of cid, code, root, floor, far) within its group, in its own component above its floor and in others above far; and candidates for links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("m")
            offsets, members = column.offsets.to_numpy() - column.offsets[0].as_py(), column.flatten()
            ids, roots, raw = members.field("cid").to_numpy(), members.field("root").to_numpy(), members.field("code").to_pylist()
            floors = {OWN: members.field("floor").to_numpy(), OTHER: members.field("far").to_numpy()}
            a, b, c, kinds = [], [], [], []
            for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                if e - s < 2:
                    continue
                x, own, root = _codes(raw[s:e]), ids[s:e], roots[s:e]
                sims = x @ x.T
                sims[own[:, None] == own[None, :]] = -2
                other = root[:, None] != root[None, :]
                for kind, among in ((OWN, ~other), (OTHER, other)):
                    if kind == OWN and among.sum() == e - s:
                        continue
                    apart = np.where(among, sims, np.float32(-2))
                    top = np.argsort(-apart, axis=1)[:, : min(k, e - s - 1)]
                    near = np.take_along_axis(apart, top, 1)
                    r, q = np.nonzero(near > floors[kind][s:e, None])
                    a.append(own[r]), b.append(own[top[r, q]]), c.append(near[r, q]), kinds.append(np.full(len(r), kind, np.int8))
                pairs = _connecting(sims, other, threshold)
                a.append(own[pairs[:, 0]]), b.append(own[pairs[:, 1]]), c.append(sims[pairs[:, 0], pairs[:, 1]]), kinds.append(np.full(len(pairs), CANDIDATE, np.int8))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(c).astype(np.float32)), pa.array(np.concatenate(kinds))], names=["cid", "nbr", "sim", "kind"])

    return groups.select("m").mapInArrow(run, "cid long, nbr long, sim float, kind byte")


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each class and kind. A class has at most k entries from each list that it was in."""
    best = edges.groupBy("cid", "nbr", "kind").agg(F.max("sim").alias("sim")).groupBy("cid", "kind").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "nbr")), asc=False), 1, k).alias("best"))
    return best.select("cid", "kind", F.explode("best").alias("x")).select("cid", "x.nbr", "x.sim", "kind")


def _of_kinds(graph: DataFrame, rooted: DataFrame) -> DataFrame:
    """The graph with kinds by the components now known."""
    root = rooted.select("cid", "root")
    both = graph.drop("kind").join(root, "cid").join(root.toDF("nbr", "nbr_root"), "nbr")
    return both.select("cid", "nbr", "sim", F.when(F.col("root") == F.col("nbr_root"), OWN).otherwise(OTHER).cast("byte").alias("kind"))


def _forest_edges(rooted: DataFrame, n: int, k: int, trees: int, seed: int, threshold: float) -> DataFrame:
    leaves = staged(_leaves(rooted, trees, _depth(n), seed), "leaves")
    # A leaf of a dense region is dealt into blocks, anew in each tree.
    sizes = leaves.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (2 * LEAF)).alias("blocks"))
    block = F.pmod(F.xxhash64("cid", "tree", F.lit(seed)), "blocks")
    dealt = leaves.join(sizes, ["tree", "leaf"]).groupBy("tree", "leaf", block.alias("block"))
    floor = F.lit(-1.0).cast("float")
    edges = staged(_compare(dealt.agg(F.collect_list(F.struct("cid", "code", "root", floor.alias("floor"), floor.alias("far"))).alias("m")), k, threshold), "compared")
    dropped(leaves)
    return edges


def _refine(graph: DataFrame, rooted: DataFrame, k: int, seed: int, threshold: float) -> DataFrame:
    """The edges that come up among each class's neighbours and those that have it as neighbour."""
    indegree = graph.groupBy("nbr").agg(F.count("*").alias("indegree"))
    share = (F.pmod(F.xxhash64("cid", "nbr", F.lit(seed)), F.lit(1 << 20)) / (1 << 20)) * F.col("indegree") < k
    back = graph.join(indegree, "nbr").filter(share).select(F.col("nbr").alias("pivot"), F.col("cid").alias("cid"))
    both = graph.select(F.col("cid").alias("pivot"), F.col("nbr").alias("cid")).union(back).union(graph.select(F.col("cid").alias("pivot"), "cid")).distinct()
    none = F.lit(-1.0).cast("float")
    least = lambda kind, name: F.when(F.count_if(F.col("kind") == kind) < k, none).otherwise(F.min(F.when(F.col("kind") == kind, F.col("sim")))).cast("float").alias(name)
    floors = graph.groupBy("cid").agg(least(OWN, "floor"), least(OTHER, "far"))
    codes = rooted.select("cid", "code", "root").join(floors, "cid", "left").withColumns({c: F.coalesce(c, none) for c in ("floor", "far")})
    return staged(_compare(both.join(codes, "cid").groupBy("pivot").agg(F.collect_list(F.struct("cid", "code", "root", "floor", "far")).alias("m")), k, threshold), "compared")


def _exact_links(compared: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """a, b: candidates whose cosine in double precision reaches the threshold."""
    near = compared.filter(F.col("kind") == CANDIDATE).select(F.least("cid", "nbr").alias("a"), F.greatest("cid", "nbr").alias("b")).distinct()
    unit = classes.select("cid", "unit")
    pairs = near.join(unit.withColumnsRenamed({"cid": "a", "unit": "x"}), "a").join(unit.withColumnsRenamed({"cid": "b", "unit": "y"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dots = [np.frombuffer(x, "<f8") @ np.frombuffer(y, "<f8") for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(np.array(dots) >= threshold))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _count_in_components(members: DataFrame, threshold: float) -> DataFrame:
    """cid, links: rows linked to each class, over all classes of its component, by pairs of blocks.

    members: cid, root, size, unit.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("cid"), "blocks"))
    left = dealt.groupBy("root", "block", "blocks").agg(F.collect_list(F.struct("cid", "size", "unit")).alias("m"))
    left = staged(left, "blocks")
    pairs = left.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    right = left.select("root", F.col("block").alias("other"), F.col("m").alias("o"))
    pairs = pairs.join(right, ["root", "other"]).select("m", "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column("m")[i].values, batch.column("o")[i].values
                x, y = (np.frombuffer(b"".join(v.field("unit").to_pylist()), "<f8").reshape(len(v), -1) for v in (a, b))
                ids, others, weights = a.field("cid").to_numpy(), b.field("cid").to_numpy(), b.field("size").to_numpy()
                linked = (x @ y.T >= threshold) & (ids[:, None] != others[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(linked @ weights)], names=["cid", "links"])

    return pairs.mapInArrow(run, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))


def _blocks(queries: DataFrame, at_once: int) -> Iterator[Broadcast]:
    """The query classes (cid, root, unit), at most about ``at_once`` at a time: a broadcast of dim -> cids, roots, units."""
    blocks = -(-queries.count() // at_once)
    dealt = staged(queries.select("cid", "root", "unit", F.pmod(F.xxhash64("cid"), F.lit(max(1, blocks))).alias("block")), "queries")
    for block in range(blocks):
        groups: dict[int, list] = {}
        for r in dealt.filter(F.col("block") == block).select("cid", "root", "unit").collect():  # about at_once vectors
            groups.setdefault(len(r["unit"]) // 8, []).append((r["cid"], r["root"], np.frombuffer(r["unit"], "<f8")))
        table = queries.sparkSession.sparkContext.broadcast({d: tuple(np.array(x) for x in zip(*g)) for d, g in groups.items()})
        yield table
        table.destroy()
    dropped(dealt)


def _chunks(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of ``dim`` in the batch, and their vectors, 1024 at a time."""
    places, raw = np.flatnonzero(batch.column("dim").to_numpy() == dim), batch.column("unit")
    for s in range(0, len(places), 1024):
        at = places[s : s + 1024]
        yield at, np.frombuffer(b"".join(raw.take(pa.array(at)).to_pylist()), "<f8").reshape(len(at), -1)


def _true_links(classes: DataFrame, queries: DataFrame, threshold: float, at_once: int) -> DataFrame:
    """cid, truth of the query classes: rows linked to each, counted over all rows in blocks. Written."""
    parts = []
    for table in _blocks(queries.select("cid", F.col("cid").alias("root"), "unit"), at_once):

        def run(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            counts = {d: np.zeros(len(c), np.int64) for d, (c, _, _) in table.value.items()}
            for batch in batches:
                ids, sizes = batch.column("cid").to_numpy(), batch.column("size").to_numpy()
                for d, (cids, _, units) in table.value.items():
                    for at, x in _chunks(batch, d):
                        counts[d] += ((units @ x.T >= threshold) & (cids[:, None] != ids[at][None, :])) @ sizes[at]
            for d, (cids, _, _) in table.value.items():
                yield pa.RecordBatch.from_arrays([pa.array(cids), pa.array(counts[d])], names=["cid", "truth"])

        counted = classes.select("cid", "dim", "unit", "size").mapInArrow(run, "cid long, truth long")
        parts.append(staged(counted.groupBy("cid").agg(F.sum("truth").alias("truth")), "truth"))
    return reduce(DataFrame.unionByName, parts) if parts else classes.select("cid", F.lit(0).cast("long").alias("truth")).limit(0)


def _links_in_blocks(rooted: DataFrame, threshold: float, at_once: int) -> DataFrame:
    """a, b: links between components, over all pairs of rows (cid, dim, root, unit); of two components one for each chunk that has any. Written."""
    parts = []
    for table in _blocks(rooted, at_once):

        def run(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, roots = batch.column("cid").to_numpy(), batch.column("root").to_numpy()
                for d, (cids, own, units) in table.value.items():
                    for at, x in _chunks(batch, d):
                        q, r = np.nonzero((units @ x.T >= threshold) & (own[:, None] != roots[at][None, :]))
                        if len(q):
                            _, first = np.unique(np.stack([own[q], roots[at][r]]), axis=1, return_index=True)
                            yield pa.RecordBatch.from_arrays([pa.array(cids[q[first]]), pa.array(ids[at][r[first]])], names=["a", "b"])

        parts.append(staged(rooted.select("cid", "dim", "root", "unit").mapInArrow(run, "a long, b long"), "near"))
    return reduce(DataFrame.unionByName, parts)


def _recall(truth: DataFrame, found: DataFrame) -> float | None:
    """Mean over the queries that have links of the share found, in the worst magnitude of their numbers; None without such a query."""
    share = F.coalesce("links", F.lit(0)) / F.col("truth")
    bands = truth.filter("truth > 0").join(found, "cid", "left").groupBy(F.floor(F.log2("truth")).alias("band")).agg(F.avg(share).alias("recall"))
    return bands.agg(F.min("recall")).first()[0]


def _trees_needed(n: int, threshold: float, least_recall: float) -> int:
    """Trees in which a lone pair at the threshold shares a leaf at least once, with a chance of least_recall."""
    shared = (1 - np.arccos(min(1.0, max(-1.0, threshold))) / np.pi) ** _depth(n)
    return 1 if shared >= 1 else int(np.ceil(np.log(max(1e-9, 1 - least_recall)) / np.log1p(-shared)))


def _members(classes: DataFrame, roots: DataFrame) -> DataFrame:
    return classes.join(roots, classes.cid == roots.node).select("cid", "root", "size", "unit")


def _rooted(classes: DataFrame, roots: DataFrame | None, *columns: str) -> DataFrame:
    """The classes with the smallest class of their component, themselves where nothing links to them."""
    if roots is None:
        return classes.select(*columns, F.col("cid").alias("root"))
    return classes.join(roots, classes.cid == roots.node, "left").select(*columns, F.coalesce("root", "cid").alias("root"))


def near_duplicate_vectors(
    rows: DataFrame,
    threshold: float = 0.95,
    k: int = 12,
    trees: int = 6,
    rounds: int = 2,
    audit_queries: int = 2048,
    least_recall: float = 0.98,
    most_passes: int = 3,
    seed: int = 7,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    ids, classes = _classes(rows)
    n = classes.count()
    graph = links = found = roots = truth = None
    passes = -(-_trees_needed(n, threshold, least_recall) // trees)
    attempt = 0
    while n:
        rooted = staged(_rooted(classes, roots, "cid", "dim", "code"), "rooted")
        if graph is not None:
            graph = _of_kinds(graph, rooted)
        compared = [_forest_edges(rooted, n, k, trees, seed + 101 * attempt, threshold)]
        lists = compared[0].filter(F.col("kind") != CANDIDATE)
        graph = staged(_best(lists if graph is None else graph.unionByName(lists), k), "graph")
        for r in range(rounds):
            compared.append(_refine(graph, rooted, k, seed + 101 * attempt + r, threshold))
            graph = staged(_best(graph.unionByName(compared[-1].filter(F.col("kind") != CANDIDATE)), k), "graph")
        more = staged(_exact_links(reduce(DataFrame.unionByName, compared), classes, threshold), "near")
        for table in [*compared, rooted]:
            dropped(table)
        attempt += 1
        changed = attempt == 1 or not more.isEmpty()
        if changed:
            links = more if links is None else links.union(more)
            roots, found = staged(components(links), "roots"), None
        last = attempt >= max(most_passes, 2 * passes)
        if not last and (changed or attempt < passes):
            continue
        if found is None:
            found = staged(_count_in_components(_members(classes, roots), threshold), "found")
        if truth is None:
            asked = ids.filter("cid IS NOT NULL AND vec_id % 20 = 0").select("cid").distinct()
            truth = _true_links(classes, classes.join(asked, "cid", "left_semi"), threshold, audit_queries)
        recall = _recall(truth, found)
        if recall is not None and recall >= least_recall:
            break
        if last or recall is None:
            links = links.union(_links_in_blocks(_rooted(classes, roots, "cid", "dim", "unit"), threshold, audit_queries))
            roots = staged(components(links), "roots")
            found = staged(_count_in_components(_members(classes, roots), threshold), "found")
            break
    if not n:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    named = classes.join(roots, classes.cid == roots.node, "left").join(found, "cid", "left")
    named = named.select("cid", "least", F.coalesce("root", "cid").alias("root"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(named.join(smallest, "root").select("cid", "links", "component_id"), "named")
    out = ids.join(named, "cid", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_nn_descent(spark, sf_dir: str) -> DataFrame:
    """All embeddings linked at a cosine of 0.95."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
