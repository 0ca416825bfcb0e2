"""Prefix trie of conversations that are rebuilt from a base's head and their own rest.

A conversation c is rebuilt from the first h turns of its base (c less c modulo ``modulus``) and its
own turns after its first h; h is the CRC-32 of its number modulo ``heads``. The trie's nodes are
the distinct beginnings of all rebuilt conversations, by (smallest member, depth).

Method: the fingerprint of a run of turns is an element (n, sum of t_i B^i) of a monoid over a
prime field, t_i from the digest of the i-th turn; two runs' product is (n + m, x + B^n y), and the
field lets a beginning be divided off again. Texts are digested where they lie and never move.
Own turns are dealt by ranges of turn numbers and multiplied up within each; then, from one row for
each range and the first few products, the place of a head in front of a rest is found as a linear
map of the range's own products. Applied to them it gives the fingerprint of every beginning of
every rebuilt conversation, none of which is ever put together. A member carries a reference
to the stored turn that it ends with (conversation and place there) and that turn's digest; a node
whose members differ in it or in their parent's fingerprint would hold two texts, and everything is
done again with another B until there is none.

Sums over subtrees follow chains: a node's smallest member stays that of one child, so that the
nodes of a member form a chain, which hangs on a node of a smaller member. Totals of chains are added
to what they hang on by pointer doubling (rounds: the logarithm of how deep chains hang on chains), then summed
along each chain.

Defined cases: a null role or text is empty; null turn numbers come first; turns of equal number
go by their digests; repeated rows are turns like any other; rows without a conv_id belong to no
conversation; a conversation without turns once rebuilt ends at the root; extra columns are
ignored; an empty table gives an empty result. Long texts count whole. A digest is 128 bits of
SHA-256 over the role, with its length, and the text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm._store import dropped, staged
from loomgraph.llm.turn_repair import crc32_sql

PRIME = (1 << 127) - 1
BLOCK = 4096
EMPTY = hashlib.sha256(b"").hexdigest()

Run = tuple[int, int]  #: length and fingerprint


def product(x: Run, y: Run, base: int) -> Run:
    """The fingerprint of one run after the other."""
    return x[0] + y[0], (x[1] + pow(base, x[0], PRIME) * y[1]) % PRIME


def rest_of(whole: Run, first: Run, base: int) -> Run:
    """What follows the run ``first`` in ``whole``."""
    return whole[0] - first[0], (whole[1] - first[1]) * pow(base, -first[0], PRIME) % PRIME


def base_of(seed: int) -> int:
    return int.from_bytes(hashlib.sha256(f"base {seed}".encode()).digest()[:15]) + 2


def _two(x: int) -> tuple[int, int]:
    """A fingerprint as two longs."""
    low = x & 0xFFFFFFFFFFFFFFFF
    return x >> 64, low - (1 << 64) if low >> 63 else low


def _one(high: int, low: int) -> int:
    return (high << 64) + (low & 0xFFFFFFFFFFFFFFFF)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 4096).columns))


def _batches(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]], size: int = 4096) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)], names=[n for n, _ in fields])

    for row in rows:
        out.append(row)
        if len(out) >= size:
            yield made()
            out.clear()
    if out:
        yield made()


def _schema(fields: list[tuple[str, pa.DataType]]) -> str:
    names = {pa.int64(): "long", pa.string(): "string"}
    return ", ".join(f"{n} {names.get(t) or 'array<struct<d1: long, d2: long, n_bytes: long, a1: long, a2: long>>'}" for n, t in fields)


_LONGS = lambda names: [(n, pa.int64()) for n in names.split()]
_FIRST = pa.list_(pa.struct(_LONGS("d1 d2 n_bytes a1 a2")))
_PRODUCTS = [*_LONGS("conv_id segment place d1 d2 n_bytes b1 b2 a1 a2"), ("first", _FIRST)]
_SPLICED = [("kind", pa.string()), *_LONGS("conv_id segment skip depth f1 f2 p1 p2 d1 d2 n_bytes turn_conv_id turn_place")]
_MEMBERS = _LONGS("conv_id depth f1 f2 p1 p2 d1 d2 n_bytes turn_conv_id turn_place")


def _products(turns: DataFrame, heads: int, block: int, seed: int) -> DataFrame:
    """Each turn's place in its range of turn numbers with the products before (b) and after it (a); for each range a row of its length, product and first turns."""
    long = lambda part: F.conv(part, 16, -10).cast("long")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("hex"), F.octet_length(text).cast("long").alias("n_bytes"))
    own = whole.select("conv_id", (F.col("turn") - F.pmod("turn", F.lit(block).cast("long"))).alias("segment"), "turn", long(F.substring("hex", 1, 16)).alias("d1"), long(F.substring("hex", 17, 16)).alias("d2"), "n_bytes")
    top = F.lit(-(1 << 63)).cast("long")
    ordered = own.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "turn", F.col("d1").bitwiseXOR(top), F.col("d2").bitwiseXOR(top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = base_of(seed)

        def out() -> Iterator[tuple]:
            for (conv, segment), rows in groupby(_rows(batches), key=lambda r: r[:2]):
                n, value, power, first = 0, 0, 1, []
                for _, _, _, d1, d2, n_bytes in rows:
                    before, power, n = value, power * base % PRIME, n + 1
                    value = (value + _one(d1 & 0xFFFFFFFFFFFFFFFF, d2) * power) % PRIME
                    if n < heads:
                        first.append(dict(zip(("d1", "d2", "n_bytes", "a1", "a2"), (d1, d2, n_bytes, *_two(value)))))
                    yield conv, segment, n, d1, d2, n_bytes, *_two(before), *_two(value), None
                yield conv, segment, n, None, None, None, None, None, *_two(value), first

        return _batches(out(), _PRODUCTS)

    return staged(ordered.mapInArrow(run, _schema(_PRODUCTS)), "products")


def _spliced(products: DataFrame, modulus: int, heads: int, seed: int) -> DataFrame:
    """Rows of three kinds. rest: for a range of a conversation's turns the linear map that gives the fingerprints of its beginnings (f + p x), how many
    of its turns are skipped, what to add to a place for the depth, and how many turns come before. member: the root and the beginnings in the base's head. end: where the rebuilt conversation ends."""
    ranges = products.filter("first IS NOT NULL").select(F.expr(f"conv_id - conv_id % {modulus}").alias("group"), "conv_id", "segment", "place", "a1", "a2", "first")
    ordered = ranges.repartition("group").sortWithinPartitions("group", F.col("conv_id") != F.col("group"), "conv_id", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, none = base_of(seed), (None,) * 4

        def out() -> Iterator[tuple]:
            for group, of_group in groupby(_rows(batches), key=lambda r: r[0]):
                head: list[tuple] = []  # of the base: digest, bytes, fingerprint up to there
                for conv, rows in groupby(of_group, key=lambda r: r[1]):
                    h = zlib.crc32(str(conv).encode()) % heads
                    at: Run = (0, 0)
                    cut = None  # what the first h own turns are
                    waiting = []
                    for _, _, segment, n, a1, a2, first in rows:
                        if conv == group:
                            for x in first[: heads - 1 - len(head)]:
                                head.append((x["d1"], x["d2"], x["n_bytes"], product(at, (0, _one(x["a1"], x["a2"])), base)[1]))
                        if cut is None and at[0] + n > h:
                            k = h - at[0]
                            cut = product(at, (k, _one(first[k - 1]["a1"], first[k - 1]["a2"]) if k else 0), base)
                        if cut:
                            waiting.append((segment, at))
                        at = product(at, (n, _one(a1, a2)), base)
                    taken = min(h, len(head))
                    begun: Run = (taken, head[taken - 1][3] if taken else 0)
                    for segment, before in waiting:
                        # f + p x is the product of the head, the rest of ``before`` after the cut, and x.
                        n, f = product(begun, rest_of(before, cut, base), base)
                        yield "rest", conv, segment, max(0, h - before[0]), taken - h + before[0], *_two(f), *_two(pow(base, n, PRIME)), *none, before[0]
                    up = 0
                    yield "member", conv, None, None, 0, 0, 0, 0, 0, 0, 0, 0, None, None
                    for k, (d1, d2, n_bytes, value) in enumerate(head[:taken], 1):
                        yield "member", conv, None, None, k, *_two(value), *_two(up), d1, d2, n_bytes, group, k
                        up = value
                    n, f = product(begun, rest_of(at, cut, base), base) if cut else begun
                    yield "end", conv, None, None, n, *_two(f), None, None, *none, None

        return _batches(out(), _SPLICED)

    return staged(ordered.mapInArrow(run, _schema(_SPLICED)), "spliced")


def _members(products: DataFrame, spliced: DataFrame) -> DataFrame:
    """Every beginning of every rebuilt conversation, with the reference to its last turn."""
    t, s = products.filter("first IS NULL").alias("t"), spliced.filter("kind = 'rest'").alias("s")
    same = (F.col("t.conv_id") == F.col("s.conv_id")) & F.col("t.segment").eqNullSafe(F.col("s.segment")) & (F.col("t.place") > F.col("s.skip"))
    mapped = t.join(s, same).select("t.conv_id", (F.col("s.depth") + F.col("t.place")).alias("depth"), *[f"s.{c}" for c in ("f1", "f2", "p1", "p2")], *[f"t.{c}" for c in ("b1", "b2", "a1", "a2", "d1", "d2", "n_bytes")], (F.col("t.place") + F.col("s.turn_place")).alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for conv, depth, f1, f2, p1, p2, b1, b2, a1, a2, d1, d2, n_bytes, place in _rows(batches):
                f, p = _one(f1, f2), _one(p1, p2)
                yield conv, depth, *_two((f + p * _one(a1, a2)) % PRIME), *_two((f + p * _one(b1, b2)) % PRIME), d1, d2, n_bytes, conv, place

        return _batches(out(), _MEMBERS)

    own = mapped.mapInArrow(run, _schema(_MEMBERS))
    return own.unionByName(spliced.filter("kind = 'member'").select(*[n for n, _ in _MEMBERS]))


def _ends(spliced: DataFrame, block: int) -> DataFrame:
    """depth, f1, f2, ends_sha256 of the nodes where rebuilt conversations end; numbers are joined by blocks of ids, so that many equal conversations are no long group."""
    ends = spliced.filter("kind = 'end'").select("depth", "f1", "f2", "conv_id", (F.col("conv_id") - F.pmod("conv_id", F.lit(block).cast("long"))).alias("block"))
    runs = ends.groupBy("depth", "f1", "f2", "block").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))).alias("ids"))
    fields = [*_LONGS("depth f1 f2"), ("ends_sha256", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for key, rows in groupby(_rows(batches), key=lambda r: r[:3]):
                digest = hashlib.sha256()
                for i, row in enumerate(rows):
                    digest.update((b"," if i else b"") + row[3].encode())
                yield *key, digest.hexdigest()

        return _batches(out(), fields)

    ordered = runs.repartition("depth", "f1", "f2").sortWithinPartitions("depth", "f1", "f2", "block")
    return ordered.select("depth", "f1", "f2", "ids").mapInArrow(run, _schema(fields))


def _totals(chains: DataFrame) -> DataFrame:
    """conv_id, saved, leaves of each chain with all that hangs on it, by pointer doubling."""
    now = chains.select("conv_id", "up", "saved", "leaves")
    made: DataFrame | None = None
    while not now.filter("up IS NOT NULL").isEmpty():
        n, u = now.alias("n"), now.filter("up IS NOT NULL").select(F.col("conv_id").alias("id"), F.col("up").alias("next")).alias("u")
        gains = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("saved").alias("more"), F.sum("leaves").alias("more_leaves")).alias("g")
        summed = n.join(gains, F.col("n.conv_id") == F.col("g.id"), "left").select("n.conv_id", "n.up", (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves")).alias("s")
        now = staged(summed.join(u, F.col("s.up") == F.col("u.id"), "left").select("conv_id", F.col("next").alias("up"), "saved", "leaves"), "chains")
        if made is not None:
            dropped(made)
        made = now
    return now


def _along(rows: DataFrame, block: int, deepest: int) -> DataFrame:
    """``saved`` and ``leaves`` of each node with those of the deeper ones of its chain; a long chain is summed by blocks first."""
    down = W.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("block", F.col("depth") - F.col("depth") % F.lit(block).cast("long"))
    summed = rows.select(*[c for c in rows.columns if c not in ("saved", "leaves")], F.sum("saved").over(down).alias("saved"), F.sum("leaves").over(down).alias("leaves"))
    if deepest < block:
        return summed.drop("block")
    later = W.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    after = blocks.select("conv_id", "block", F.coalesce(F.sum("s").over(later), F.lit(0)).alias("s"), F.coalesce(F.sum("l").over(later), F.lit(0)).alias("l"))
    return summed.join(after, ["conv_id", "block"]).withColumns({"saved": F.col("saved") + F.col("s"), "leaves": F.col("leaves") + F.col("l")}).drop("block", "s", "l")


def rebuilt_trie(conversations: DataFrame, modulus: int = 5, heads: int = 9, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn_conv_id, turn_place.

    The last two refer to the stored turn that the node ends with: its conversation and its place
    there. heads: h is below it. block: how many turn numbers, ids or depths are handled as one run.
    """
    key = ["depth", "f1", "f2"]
    while True:
        products = _products(conversations, heads, block, seed)
        spliced = _spliced(products, modulus, heads, seed)
        checked = ["p1", "p2", "d1", "d2"]
        nodes = _members(products, spliced).groupBy(*key).agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), *[F.min(c).alias(c) for c in checked], *[F.max(c).alias(f"{c}_most") for c in checked],
            F.min(F.struct("turn_conv_id", "turn_place")).alias("turn"),
        )
        nodes = staged(nodes.withColumn("mixed", F.expr(" OR ".join(f"{c} <> {c}_most" for c in checked))).drop("d1", "d2", *[f"{c}_most" for c in checked]), "nodes")
        if nodes.filter("mixed").isEmpty():
            break
        seed += 1  # two texts of one fingerprint
    top = nodes.agg(F.min("conv_id").alias("least"), F.max("depth").alias("deepest")).first()
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.filter("depth > 1").join(parents, ["depth", "p1", "p2"])
    # All nodes of one turn hang on the root, whose smallest member is that of the table.
    flat = nodes.filter("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(top["least"]).cast("long")))
    whole = deep.unionByName(flat).join(kids, key, "left").join(_ends(spliced, block), key, "left")
    whole = staged(
        whole.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), F.col("n_children").isNull().cast("long").alias("leaves"),
            F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "turn.turn_conv_id", "turn.turn_place",
        ),
        "trie",
    )
    for used in (products, spliced, nodes):
        dropped(used)
    own = whole.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    hung = whole.filter("parent_conv_id IS NULL OR parent_conv_id <> conv_id").select("conv_id", F.col("parent_conv_id").alias("up"), (F.col("depth") - 1).alias("at"))
    chains = staged(hung.join(own, "conv_id"), "chains")
    totals = _totals(chains)
    added = chains.filter("up IS NOT NULL").select("conv_id", "up", "at").join(totals.select("conv_id", "saved", "leaves"), "conv_id").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    rows = whole.join(added, ["conv_id", "depth"], "left").withColumns({"saved": F.col("saved") + F.coalesce("s", F.lit(0)), "leaves": F.col("leaves") + F.coalesce("l", F.lit(0))}).drop("s", "l")
    summed = _along(rows, block, top["deepest"] or 0)
    return summed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256", "turn_conv_id", "turn_place")


def op13_monoid_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("turn_conv_id", "turn_place")


def op13_sql(modulus: int = 5, heads: int = 9) -> str:
    """The same trie from whole paths, strings of all digests, in SQL."""
    return rf"""
WITH d AS (SELECT conv_id, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS n_bytes FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS i FROM d),
c AS (SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % {heads} AS h, conv_id - conv_id % {modulus} AS base FROM (SELECT DISTINCT conv_id FROM t)),
heads AS (SELECT c.conv_id, i AS depth, digest, n_bytes FROM c JOIN t ON t.conv_id = c.base AND i <= h),
taken AS (SELECT c.conv_id, h, coalesce(n, 0) AS n FROM c LEFT JOIN (SELECT conv_id, count(*) AS n FROM heads GROUP BY conv_id) x USING (conv_id)),
built AS (SELECT * FROM heads UNION ALL SELECT t.conv_id, i - h + n, digest, n_bytes FROM taken JOIN t ON t.conv_id = taken.conv_id AND i > h),
paths AS (SELECT conv_id, depth, n_bytes, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM built UNION ALL SELECT conv_id, 0, 0, '' FROM c),
last AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
ends AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM paths JOIN last USING (conv_id, depth) GROUP BY path),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n_bytes) AS saved FROM paths GROUP BY path, depth),
kids AS (SELECT path[1:length(path) - 64] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (SELECT a.path, sum(b.saved)::BIGINT AS saved, count(*) FILTER (b.path NOT IN (SELECT path FROM kids)) AS leaves FROM nodes a JOIN nodes b ON starts_with(b.path, a.path) GROUP BY a.path)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(k.n, 0) AS n_children, leaves AS n_leaves, below.saved AS saved_tokens, coalesce(ends_sha256, '{EMPTY}') AS ends_sha256
FROM nodes x LEFT JOIN nodes p ON x.depth > 0 AND p.path = x.path[1:length(x.path) - 64] LEFT JOIN kids k ON k.path = x.path JOIN below ON below.path = x.path LEFT JOIN ends ON ends.path = x.path
"""
