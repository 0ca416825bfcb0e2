"""Similarity self-join of documents on word n-grams, by vertical partitioning.

1. Each text becomes its set of distinct shingle hashes. Texts of equal sets form a class
   (a 64-bit digest names it); the join runs over classes, so exact copies cost nothing.
2. A fixed-size table of shingle counts by hash bucket, over all documents, defines a global
   order of shingles: rare buckets first, then by hash. Any total order is valid; this one
   puts what many documents share last.
3. Two sets of the wanted similarity share a shingle among the first n - ceil(t n) + 1 of each
   (prefix filter). The prefixes travel once, as packed arrays by ranges of hashes; a range
   gives back the entries whose shingle another class has too. A range has a bounded number of
   entries on average, and shingles that the count table calls hot pass it by, so that no shingle
   brings more than HOT entries to one task.
4. Every such shingle is a bucket. In each bucket one class is the hub; all others are compared
   with it only: as many comparisons as there are entries.
5. Pairs that the counts of their shingles by 256 classes of hashes exclude are dropped; the
   other comparisons are counted by vertical partitioning: the global order is cut into fragments of
   equal weight, overlaps of a pair are counted fragment by fragment and summed per pair.
6. Linked classes form components; a component's label is its least (doc_id, class), carried
   through the rounds. Left over are pairs of a bucket in different components, of which one is
   outside the bucket's main component: each is compared, save those that the places of the common
   shingle or the distance to a common hub exclude (Jaccard distance is a metric, so
   |d(x, hub) - d(y, hub)| > 1 - t proves that x and y have no link). Pairs within a component
   need no comparison. No link between components is lost.

Copies of a text are one class: a task emits a class once. A hub's segments are copied once for
every CROWD of its pairs, and the pairs dealt over the copies, so that no hub brings more than
about that many rows to a task. Joins on another class or bucket that holds a large share of the
rows are split by Spark's handling of skewed joins; aggregates are combined before they are
shuffled.

Defined cases: a null text, or one without words, has an empty set, n_shingles 0, links with
nothing and is its own component; repeated rows share a class, hence a component; rows of one
doc_id and different texts are separate documents under one number, and a null doc_id counts as the largest one; hubs and main components that tie are taken by their hash
or class; a very long text is a set like any other, handled in a slice of its own; extra columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm._components import components
from loomgraph.llm._store import dropped, small_batches, staged
from loomgraph.llm._words import mix64, shingle_sets

COUNT_BITS = 20
CHUNKS = 64
FRAGMENTS = 4
OUTLINE = 256
RANGE_ENTRIES = 250_000  # entries of a range of hashes, on average
HOT = 65_536
CROWD = 512  # pairs of a class that share one copy of its segments


def _class_id(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)


def _outline(shingles: np.ndarray) -> bytes | None:
    """How many shingles fall into each of OUTLINE classes of hashes; null for a set too large for bytes."""
    counts = np.bincount(((shingles >> np.uint64(COUNT_BITS)) % np.uint64(OUTLINE)).astype(np.int64), minlength=OUTLINE)
    return counts.astype(np.uint8).tobytes() if len(shingles) and counts.max() < 256 else None


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose outlines allow the wanted similarity: no more shingles are common than the smaller counts add up to."""
    side = lambda key, n, x: classes.select(F.col("sid").alias(key), F.col("n").alias(n), F.col("outline").alias(x))
    both = pairs.hint("merge").join(side("a", "na", "x"), "a").hint("merge").join(side("b", "nb", "y"), "b").select("a", "b", "na", "nb", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            keep = np.array([a is None or b is None for a, b in zip(x, y)], bool)
            sure = np.flatnonzero(~keep)
            for at in np.array_split(sure, max(1, len(sure) // 4096)):
                if len(at):
                    a, b = (np.frombuffer(b"".join(v[i] for i in at), np.uint8).reshape(len(at), OUTLINE) for v in (x, y))
                    most = np.minimum(a, b).sum(1, dtype=np.int64)
                    keep[at] = 100 * most >= percent * (total[at] - most)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    """A row for each document (doc_id, text_hash, n, sid) and each partition's shingle counts (chunk, part, counts): written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, part = np.zeros(1 << COUNT_BITS, np.int32), TaskContext.get().partitionId()
        names = ["doc_id", "text_hash", "n", "sid", "outline", "chunk", "part", "counts"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
        seen: set[int] = set()
        for batch in batches:
            sizes, sids, outlines = [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), k):
                sid = _class_id(s) if len(s) else None
                sizes.append(len(s))
                sids.append(sid)
                outlines.append(_outline(s))
                if sid is not None and sid not in seen:
                    seen.add(sid)
                    np.add.at(counts, _bucket(s), 1)
            none = [None] * len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([batch.column("doc_id"), batch.column("text_hash"), sizes, sids, outlines, none, none, none], types)], names=names)
        if seen:
            none = [None] * CHUNKS
            rows = zip(*_table_rows(counts, part))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([none, none, none, none, none, *rows], types)], names=names)

    schema = "doc_id long, text_hash long, n long, sid long, outline binary, chunk int, part int, counts binary"
    return staged(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, schema), "profiles")


def _add_up(parts: DataFrame, fan_in: int = 64) -> np.ndarray:
    """The sum of all partitions' tables (chunk, part, counts), merged as a tree. Its size is fixed."""

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), "<i8") for x in rows.column("counts"))
        return pa.table({"chunk": rows.column("chunk").slice(0, 1), "part": pa.array([rows.column("part")[0].as_py() // fan_in], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    most = parts.agg(F.max("part")).first()[0]
    if most is None:
        return np.zeros(1 << COUNT_BITS, np.int64)
    while True:
        parts = parts.groupBy("chunk", F.expr(f"part div {fan_in}").alias("up")).applyInArrow(lambda rows: add(rows), "chunk int, part int, counts binary")
        most //= fan_in
        if not most:
            break
        parts = staged(parts, "counts")
    rows = {r["chunk"]: np.frombuffer(r["counts"], "<i8") for r in parts.select("chunk", "counts").collect()}
    return np.concatenate([rows[c] for c in range(CHUNKS)])


def _table_rows(counts: np.ndarray, part: int) -> list[tuple[int, int, bytes]]:
    return [(c, part, row.astype("<i8").tobytes()) for c, row in enumerate(counts.reshape(CHUNKS, -1))]


def _mark(sid: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    return _bucket(mix64(sid.view(np.uint64) ^ mix64(doc_id.view(np.uint64))))


def _marks(wanted: DataFrame) -> np.ndarray:
    """A flag for each hash bucket that holds a class's first document: lets most others be skipped where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            counts[_mark(batch.column("sid").to_numpy(), batch.column("doc_id").fill_null(0).to_numpy())] = 1
        if counts.any():
            rows = zip(*_table_rows(counts, TaskContext.get().partitionId()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int32(), pa.int32(), pa.binary()))], names=["chunk", "part", "counts"])

    return _add_up(staged(wanted.select("sid", "doc_id").mapInArrow(run, "chunk int, part int, counts binary"), "marks")) > 0


def _prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _postings(docs: DataFrame, k: int, percent: int, counts, ranges: int) -> DataFrame:
    """range, and arrays tokens, sids, n, pos: the entries of each class's prefix in the global order, by ranges of token hashes.

    Entries of hot tokens lie in ranges from ``ranges`` on, one for each partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hot_range, seen = counts.value, ranges + TaskContext.get().partitionId(), set()
        held, size = ([], [], [], []), 0

        def rows() -> pa.RecordBatch:
            token, sid, n, pos = (np.concatenate(x) for x in held)
            where = (((token >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
            where[table[_bucket(token)] > HOT] = hot_range
            order = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.diff(where[order])) + 1
            parts = [np.split(x[order], cuts) for x in (token.view(np.int64), sid, n.astype(np.uint32), pos.astype(np.uint32))]
            first = where[order][np.concatenate([[0], cuts])]
            return pa.RecordBatch.from_arrays([pa.array(first), *(pa.array([x.tobytes() for x in part], pa.binary()) for part in parts)], names=["range", "tokens", "sids", "n", "pos"])

        for batch in batches:
            for s in shingle_sets(batch.column("text").to_pylist(), k):
                sid = _class_id(s) if len(s) else None
                if sid is None or sid in seen:
                    continue
                seen.add(sid)
                p = _prefix_length(len(s), percent)
                for x, v in zip(held, (s[np.lexsort((s, table[_bucket(s)]))[:p]], np.full(p, sid), np.full(p, len(s)), np.arange(p))):
                    x.append(v)
                size += p
                if size > 200_000:
                    yield rows()
                    held, size = ([], [], [], []), 0
        if size:
            yield rows()

    return docs.select("text").mapInArrow(run, "range long, tokens binary, sids binary, n binary, pos binary")


def _shared_entries(postings: DataFrame, ranges: int) -> DataFrame:
    """token, sid, n, pos of the entries whose token several classes have (of hot tokens: all)."""

    def run(rows: pa.Table) -> pa.Table:
        token, sid, n, pos = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in rows.column(c)]) for c, t in (("tokens", "<i8"), ("sids", "<i8"), ("n", "<u4"), ("pos", "<u4")))
        order = np.lexsort((sid, token))
        t, c = token[order], sid[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])  # a class comes once from each task that has a copy
        order, t = order[new], t[new]
        if rows.column("range")[0].as_py() < ranges:
            same = t[1:] == t[:-1]
            order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(t) > 1 else order[:0]
        return pa.table({"token": token[order], "sid": sid[order], "n": n[order].astype(np.int32), "pos": pos[order].astype(np.int32)})

    return postings.groupBy("range").applyInArrow(run, "token long, sid long, n int, pos int")


def _segments(docs: DataFrame, wanted: DataFrame, k: int, counts, pivots: np.ndarray) -> DataFrame:
    """sid, fragment, shingles of the wanted classes: each set cut at the pivots of the global order.

    Some classes that nobody wants slip through the marks, and a repeated row gives its class twice.
    """
    marks = np.packbits(_marks(wanted))
    flags = docs.sparkSession.sparkContext.broadcast(marks)  # one bit for each of 2^20 buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, marked, seen = counts.value, np.unpackbits(flags.value), set()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                sids, frags, parts = [], [], []
                docs_at = whole.column("doc_id").slice(at, 512).fill_null(0).to_numpy()
                for i, s in enumerate(shingle_sets(whole.column("text").slice(at, 512).to_pylist(), k)):
                    if not len(s):
                        continue
                    sid = _class_id(s)
                    if sid in seen or not marked[_mark(np.array([sid]), docs_at[i : i + 1])[0]]:
                        continue
                    seen.add(sid)
                    where = np.searchsorted(pivots, table[_bucket(s)], side="right")
                    for f in np.unique(where).tolist():
                        sids.append(sid)
                        frags.append(f)
                        parts.append(s[where == f].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(frags, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], names=["sid", "fragment", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "sid long, fragment int, shingles array<long>")


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, percent: int, counts, pivots: np.ndarray) -> DataFrame:
    """a, b, na, nb, da, db, common for each pair, with the sizes and least documents of both: overlaps counted by fragment and summed per pair. Written."""
    pairs = staged(_possible(pairs.select("a", "b").distinct(), classes, percent), "pairs")
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct().hint("merge").join(classes.select("sid", "doc_id", "n"), "sid")
    wanted = staged(wanted.select("sid", "doc_id", "n"), "wanted")
    segments = staged(_segments(docs, wanted, k, counts, pivots), "segments")
    left = segments.select(F.col("sid").alias("a"), "fragment", F.col("shingles").alias("x"))
    # Classes of many pairs; the table's own size decides whether it is sent to all tasks.
    crowds = staged(pairs.groupBy("b").agg(F.ceil(F.count("*") / CROWD).cast("long").alias("copies")).filter("copies > 1"), "crowds")
    right = segments.select(F.col("sid").alias("b"), "fragment", F.col("shingles").alias("y")).join(crowds, "b", "left")
    right = right.select("b", "fragment", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    dealt = pairs.join(crowds, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("copies", F.lit(1))).alias("copy"))
    # Every side grows with the corpus, so all are shuffled at any size and none is broadcast.
    both = dealt.hint("merge").join(left, "a").hint("merge").join(right, ["b", "fragment", "copy"])
    partial = both.select("a", "b", "fragment", F.size(F.array_intersect("x", "y")).alias("c"))
    once = partial.groupBy("a", "b", "fragment").agg(F.max("c").alias("c"))  # a repeated row's fragments count once
    common = once.groupBy("a", "b").agg(F.sum("c").alias("common"))
    side = lambda c: wanted.toDF(c, f"d{c}", f"n{c}")
    out = staged(common.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b"), "overlaps")
    for table in (segments, wanted, crowds, pairs):
        dropped(table)
    return out


def _fits(percent: int, x: str, y: str):
    """Whether the sizes and places of a common shingle allow the wanted similarity.

    Shingles before it that only one class has can't be common: at most ``rank`` of them are.
    """
    na, nb, ra, rb, pa_, pb = (F.col(f"{side}{c}") for c in ("n", "rank", "pos") for side in (x, y))
    need = F.ceil(percent * (na + nb) / (100 + percent) - 1e-9)
    most = F.least(ra, rb) + F.least(na - pa_, nb - pb)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (most >= need)


def _main_and_rest(postings: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of buckets that span components, with their root; and those outside their bucket's main component."""
    named = postings.hint("merge").join(roots, postings.sid == roots.node, "left").select("token", "sid", "n", "pos", "rank", F.coalesce("root", "sid").alias("root"))
    held = named.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token")
    held = held.agg(F.count("*").alias("roots"), F.max_by("root", F.struct("c", "root")).alias("main")).filter("roots > 1").select("token", "main")
    mixed = staged(named.hint("merge").join(held, "token"), "mixed")
    return mixed, mixed.filter("root <> main")


LAST = (1 << 63) - 1


def _components(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sid, label, root of each linked class: label is the least document of its component and root that document's class; node, root alone)."""
    node = lambda c: F.struct(F.coalesce(f"d{c}", F.lit(LAST)).alias("d"), F.col(c).alias("s"))
    roots = components(links.select(node("a").alias("a"), node("b").alias("b"))).select(F.col("node.s").alias("node"), F.col("root.s").alias("root"), F.col("root.d").alias("label"))
    roots = staged(roots, "roots")
    return roots, roots.select("node", "root")


def near_duplicate_classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, root (the component's class; null without words) for each row: linked where 100 * common >= percent * union."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    with small_batches(docs.sparkSession):  # all that reads texts is written inside
        return _linked(docs.select("doc_id", "text"), k, percent)


def _linked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    profiles = _profiles(docs, k)
    rows = profiles.filter("chunk IS NULL").select("doc_id", "text_hash", "n", "sid", "outline")
    table = _add_up(profiles.filter("chunk IS NOT NULL").select("chunk", "part", "counts"))
    heavy = np.sort(table[table > 0])
    weight = np.cumsum(heavy)
    # Places in the global order that cut the corpus's shingles into fragments of about equal weight.
    pivots = np.unique(heavy[np.searchsorted(weight, weight[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS)]) if len(heavy) else np.empty(0, np.int64)
    counts = spark.sparkContext.broadcast(table)  # 2^20 numbers, whatever the corpus
    classes = rows.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("outline").alias("outline"), F.count("*").alias("copies"))
    classes = staged(classes, "classes")
    total = classes.agg(F.sum(F.expr(f"n - ceil({percent} * n / 100) + 1"))).first()[0] or 0
    ranges = max(1, -(-int(total) // RANGE_ENTRIES))

    found = staged(_shared_entries(_postings(docs, k, percent, counts, ranges), ranges), "shared")
    # A hot token's class comes once from each task that has a copy.
    ranked = found.dropDuplicates(["token", "sid"]).withColumn("rank", F.row_number().over(W.partitionBy("sid").orderBy("pos", "token")) - 1)
    # An entry after too many shingles of its own class alone can't belong to a link.
    entries = staged(ranked.filter(100 * (F.col("rank") + F.col("n") - F.col("pos")) >= percent * F.col("n")), "entries")
    dropped(found)
    # A hub for each bucket: whoever has the fewest shingles of its own before this one.
    early = F.shiftleft((F.col("pos") - F.col("rank")).cast("long"), 40) + F.xxhash64("sid").bitwiseAND(F.lit((1 << 40) - 1))
    hub = [F.min_by(c, early).alias(f"hub_{c}") for c in ("sid", "n", "pos", "rank")]
    shared = entries.hint("merge").join(entries.groupBy("token").agg(*hub), "token")
    pairs = shared.filter((F.col("sid") != F.col("hub_sid")) & _fits(percent, "", "hub_")).select(F.col("sid").alias("a"), F.col("hub_sid").alias("b"))
    overlaps = _verified(docs, pairs, classes, k, percent, counts, pivots)
    linked = f"100 * common >= {percent} * (na + nb - common)"
    links = overlaps.filter(linked).select("a", "b", "da", "db")
    roots, plain = _components(links)

    mixed, rest = _main_and_rest(entries, plain)
    x, y = rest.select("token", *(F.col(c).alias(f"x_{c}") for c in ("sid", "n", "pos", "rank", "root"))), mixed.select("token", *(F.col(c).alias(f"y_{c}") for c in ("sid", "n", "pos", "rank", "root")))
    pairs = x.hint("merge").join(y, "token").filter((F.col("x_root") != F.col("y_root")) & _fits(percent, "x_", "y_"))
    pairs = staged(pairs.select(F.least("x_sid", "y_sid").alias("a"), F.greatest("x_sid", "y_sid").alias("b")).distinct(), "left")
    for table in (mixed, entries):
        dropped(table)
    known = overlaps.select("a", "b", (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("d"))
    known = known.union(known.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).groupBy("a", "b").agg(F.min("d").alias("d"))
    pairs = pairs.hint("merge").join(known.select("a", "b"), ["a", "b"], "left_anti")
    via = known.select("a", F.col("b").alias("hub"), F.col("d").alias("da"))
    apart = pairs.hint("merge").join(via, "a").hint("merge").join(via.select(F.col("a").alias("b"), "hub", F.col("da").alias("db")), ["b", "hub"])
    apart = apart.filter(F.abs(F.col("da") - F.col("db")) > 1 - percent / 100 + 1e-9).select("a", "b").distinct()
    found = _verified(docs, pairs.hint("merge").join(apart, ["a", "b"], "left_anti"), classes, k, percent, counts, pivots)
    more = found.filter(linked).select("a", "b", "da", "db")
    if not more.isEmpty():
        roots, _ = _components(links.union(more))

    named = classes.select("sid", "doc_id").hint("merge").join(roots, classes.sid == roots.node, "left")
    named = named.select("sid", F.coalesce("root", "sid").alias("root"), F.when(F.coalesce("label", "doc_id") != LAST, F.coalesce("label", "doc_id")).alias("component_id"))
    named = staged(named, "members")
    for table in (classes, overlaps, found):
        dropped(table)
    return rows.drop("outline").hint("merge").join(named, "sid", "left").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "root")


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows with the smallest (doc_id, text hash) of each component, once each, with their own columns, whatever their names.

    Texts without words have no component and stay.
    """
    columns = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    doc_id, text = (F.col(f"c{columns.index(c)}") for c in ("doc_id", "text"))
    number = lambda c: F.coalesce(c, F.lit(LAST))
    classes = near_duplicate_classes(docs, k, percent)
    found = classes.select(number(F.col("doc_id")).alias("number"), F.col("text_hash").alias("hash"), "root")
    alone = found.filter("root IS NULL").select("number", "hash")
    first = found.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("number", "hash")).alias("x")).select("x.number", "x.hash")
    stay = staged(alone.union(first).distinct(), "stay")
    keyed = plain.withColumns({"number": number(doc_id), "hash": F.xxhash64(text)})
    kept = keyed.hint("merge").join(stay, ["number", "hash"], "left_semi").dropDuplicates(["number", "hash"])
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))


def op5_ngram_vertical_join(spark, sf_dir: str) -> DataFrame:
    """Components of documents whose distinct 3-word shingles reach a Jaccard similarity of 0.9."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicate_classes(docs, 3, 90).select("doc_id", "n_shingles", "component_id")
