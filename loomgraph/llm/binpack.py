"""Best-fit-decreasing packing of token ids into rows of a fixed capacity.

Documents longer than the capacity are cut losslessly: full pieces fill rows of their own, one
rest remains. Rests and short documents are the pieces to be packed. Best fit decreasing takes
pieces by falling length and puts each into the fullest row with room for it; a segment tree
over capacities finds that row's class in logarithmic time. Which piece goes where depends on
lengths alone, so the search runs over counts of pieces by length (one number for each length,
at most ``capacity`` of them, whatever the corpus): it yields row patterns (a multiset of
lengths, and how many rows have it). Tasks then look up, from a piece's rank among those of its
length, the row and place that the patterns give it. A piece's rank comes from its rank within
its partition of the scan and the counts of that length in the partitions before; these are
joined to the pieces' numbers alone, and the ids follow by a join on the row's own number. No
side of a join is broadcast, and no table of pieces meets in one task or on the driver.

``packed_matrix`` gathers the pieces of each packed row (at most ``capacity`` of them) into a
matrix row: padded ids, cumulative segment lengths, and positions that restart at every segment.

Defined cases: a null text is an empty text with the end id only; repeated rows are packed
each; pieces of equal length are taken in the order of their partitions and rows; a very long
text is cut into full rows and a rest; extra columns are ignored; an empty table gives an empty
result. A packed row is padded to the capacity.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm._store import staged
from loomgraph.llm.packing import SEQUENCE, _encoder, slices


class CapacityTree:
    """For each remaining room, whether some row has it; finds the least room of at least n."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.used = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.used[i] += by
            i //= 2

    def least_from(self, n: int) -> int | None:
        """The smallest room >= n that some row has."""
        i = n + self.leaves
        if self.used[i]:
            return n
        while i > 1:
            if i % 2 == 0 and self.used[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return None
        while i < self.leaves:
            i = 2 * i if self.used[2 * i] else 2 * i + 1
        return i - self.leaves


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a row, number of such rows) of a best-fit-decreasing packing.

    Rows of equal content are kept together, and all pieces of one length are placed by groups
    of such rows, as the piece-by-piece search would place them.
    """
    tree = CapacityTree(capacity)
    rows: dict[int, Counter] = {}

    def put(room: int, content: tuple[int, ...], n: int) -> None:
        rows.setdefault(room, Counter())[content] += n
        tree.add(room, n)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = tree.least_from(length)
            if room is None:
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * length, (length,) * each, full)
                if rest:
                    put(capacity - rest * length, (length,) * rest, 1)
                left = 0
                continue
            content = min(rows[room])
            each = room // length
            fill = min(each, left)
            taken = min(rows[room][content], left // fill)
            rows[room][content] -= taken
            if not rows[room][content]:
                del rows[room][content]
            tree.add(room, -taken)
            put(room - fill * length, content + (length,) * fill, taken)
            left -= fill * taken
    return [(content, n) for room in sorted(rows) for content, n in sorted(rows[room].items())]


class Places:
    """Row and offset of the i-th piece of a length, from the patterns."""

    def __init__(self, found: list[tuple[tuple[int, ...], int]], first_row: int) -> None:
        self.by: dict[int, tuple[list[int], list[tuple[int, int, list[int], int]]]] = {}
        row = first_row
        for content, n in found:
            offsets: dict[int, list[int]] = {}
            at = 0
            for length in content:
                offsets.setdefault(length, []).append(at)
                at += length
            for length, own in offsets.items():
                starts, entries = self.by.setdefault(length, ([], []))
                starts.append(entries[-1][0] + entries[-1][3] * len(entries[-1][2]) if entries else 0)
                entries.append((starts[-1], row, own, n))
            row += n
        self.rows = row

    def __call__(self, length: int, i: int) -> tuple[int, int]:
        starts, entries = self.by[length]
        start, row, own, _ = entries[bisect_right(starts, i) - 1]
        return row + (i - start) // len(own), own[(i - start) % len(own)]


def _tokens(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """part, row, doc_id, n, rest, rank (of the rest among the partition's of equal length), full (rows filled before it in its partition), ids: written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, row, full = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        seen = np.zeros(capacity, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, sizes = encoder.encode_binary(batch.column("text"), end_id)
                rests, fulls = sizes % capacity, sizes // capacity
                order = np.argsort(rests, kind="stable")
                run_start = np.searchsorted(rests[order], rests[order])
                ranks = np.empty(len(sizes), np.int64)
                ranks[order] = seen[rests[order]] + np.arange(len(sizes)) - run_start
                seen += np.bincount(rests, minlength=capacity)
                before = full + np.cumsum(fulls) - fulls
                full += int(fulls.sum())
                columns = [np.full(len(sizes), part, np.int32), np.arange(row, row + len(sizes)), batch.column("doc_id"), sizes, rests.astype(np.int32), ranks, before, ids]
                row += len(sizes)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=["part", "row", "doc_id", "n", "rest", "rank", "full", "ids"])

    return staged(docs.select("doc_id", "text").mapInArrow(run, "part int, row long, doc_id long, n long, rest int, rank long, full long, ids binary"), "tokens")


def best_fit_pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, segment_end, and the ids if asked for.

    The ids are little-endian, of two bytes each where the vocabulary allows it, else of four.

    segment_end is the piece's cumulative length within its row; positions restart at 0 at every
    offset. ``packed_matrix`` turns the rows into id matrices.
    """
    held = _tokens(docs, tokenizer_path, end_id, capacity)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    by_rest = held.filter("rest > 0").groupBy("rest", "part").agg(F.count("*").alias("c"))
    base = staged(by_rest.select("rest", "part", "c", F.coalesce(F.sum("c").over(before.partitionBy("rest")), F.lit(0)).alias("base")), "bases")
    counts = {r["rest"]: r["c"] for r in base.groupBy("rest").agg(F.sum("c").alias("c")).collect()}  # at most ``capacity`` numbers
    by_part = held.groupBy("part").agg(F.sum(F.expr(f"n div {capacity}")).alias("c"))
    # One row for each partition of the scan, in one task.
    filled = staged(by_part.select("part", "c", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("filled")), "filled")
    total = filled.agg(F.sum("c")).first()[0] or 0
    places = Places(patterns(counts, capacity), total)
    numbers = held.select("part", "row", "rest", "rank", "full").hint("merge").join(base.select("rest", "part", "base"), ["rest", "part"], "left")
    numbers = numbers.hint("merge").join(filled.select("part", "filled"), "part")
    numbers = numbers.select("part", "row", (F.col("rank") + F.coalesce("base", F.lit(0))).alias("rank"), (F.col("full") + F.col("filled")).alias("full"))
    placed = held.select("part", "row", "doc_id", "n", "rest", "ids").hint("merge").join(numbers, ["part", "row"]).select("doc_id", "n", "rest", "rank", "full", "ids")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "segment_end", *["ids"] * with_ids]
    types = [*[pa.int64()] * 8, *[pa.binary()] * with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _encoder(tokenizer_path).dtype
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch, rows = whole.slice(at, 2048), []
                for doc, n, rest, rank, full, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "rest", "rank", "full")), batch.column("ids")):
                    ids = np.frombuffer(raw.as_buffer(), width)
                    spots = [(i * capacity, capacity, full + i, 0) for i in range(n // capacity)]
                    if rest:
                        spots.append((n - rest, rest, *places(rest, rank)))
                    for start, length, row, offset in spots:
                        own = ids[start : start + length]
                        rows.append((doc, start, length, zlib.crc32(own.astype("<u4").tobytes()), n, row, offset, offset + length, own.tobytes())[: len(columns)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=columns)

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segment_end long" + ", ids binary" * with_ids)


def packed_matrix(pieces: DataFrame, capacity: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids, segment_ends, positions, doc_ids, starts of each packed row.

    ids and positions are of ``capacity``; segment_ends, doc_ids and starts (the document's ids
    before the segment) have an entry for each segment. Padding has position 0.
    """
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "segment_end", "doc_id", "start", "ids"))).alias("pieces"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, count = pa.list_(pa.int32()), np.arange(capacity, dtype=np.int32)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                lists = batch.column("pieces")
                bounds = lists.offsets.to_numpy()
                p = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
                begin, end = p.field("offset").to_numpy(), p.field("segment_end").to_numpy()
                bounds = bounds - bounds[0]
                row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
                ids, positions = np.full((batch.num_rows, capacity), pad_id, np.int32), np.zeros((batch.num_rows, capacity), np.int32)
                for r, s, e, raw in zip(row.tolist(), begin.tolist(), end.tolist(), p.field("ids")):
                    own = raw.as_buffer()
                    ids[r, s:e] = np.frombuffer(own, "<u2" if len(own) == 2 * (e - s) else "<u4")
                    positions[r, s:e] = count[: e - s]
                matrix = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * capacity), pa.array(x.ravel()))
                segments = lambda x, t: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), x.cast(t))
                columns = [batch.column("sequence_id"), matrix(ids), segments(p.field("segment_end"), pa.int32()), matrix(positions), segments(p.field("doc_id"), pa.int64()), segments(p.field("start"), pa.int64())]
                yield pa.RecordBatch.from_arrays([columns[0], columns[1].cast(one), *columns[2:]], names=["sequence_id", "ids", "segment_ends", "positions", "doc_ids", "starts"])

    return rows.mapInArrow(build, "sequence_id long, ids array<int>, segment_ends array<int>, positions array<int>, doc_ids array<long>, starts array<long>")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """The id matrix of all documents, packed by best fit decreasing into rows of 4096 ids."""
    import public_tokenizers as vocabularies

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed_matrix(best_fit_pack(docs, vocabularies.path("word_bpe_49k.json"), with_ids=True))
