"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds (assign, access, hex) are reported wherever they match. Three weak kinds are only
candidates: an account name or client id (``weak_id``), a mixed-case token with digits that
nothing labels (``weak_secret``), and a service address (``endpoint``). Parts of a credential
have roles: identifier (access, weak_id), secret (assign, hex, weak_secret), address
(endpoint). A candidate is reported only if complementary parts lie in its scope, that is
within ``scope`` characters of it in the same text: a secret for an identifier, an identifier
for a secret, both for an address.

Scopes are joined as intervals: every part is filed in the bins of ``scope`` characters that it
touches, every candidate and identifier looks into the bins that its scope touches, and a join on
(text, bin) with the distance as condition finds its complements. Of each role the nearest one is
linked to it (of equally near ones the first), which makes a credential: identifier, secret and
address with their places. A bin holds no more parts of a kind than characters, so that a part
meets a bounded number of others.

A match's place comes from the pieces between matches: their lengths and the matches' lengths
add up, as a running sum over the text's matches.

Defined cases: a null text is empty (no spans); repeated rows get equal spans each; matches of
one kind don't overlap, those of different kinds may; offsets count code points, the end is
exclusive; a very long text is scanned whole; spans of equal start come in the order of the kinds
above; extra columns are carried along, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm._store import staged

SCOPE = 300

_KEYS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_IDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("user", "username", "login", "account", "client_id", "access_key_id"))

#: kind -> (pattern, group whose length counts, least length); the first three are the base kinds, in the order listed.
KINDS = {
    "assign": (rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
    "weak_id": (rf"(?:{_IDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]+)", 1, 4),
    "weak_secret": (r"[A-Za-z0-9+/]{24,}", 0, 24),
    "endpoint": (r"(?:https?|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\s\x22'<>]+", 0, 10),
}
#: What a text must hold for the pattern to be tried at all.
GATES = {"assign": r"[:=]", "access": "AKIA", "hex": "[0-9a-f]{32}", "weak_id": r"[:=]", "weak_secret": KINDS["weak_secret"][0], "endpoint": "://"}
BASE = ("assign", "access", "hex")
ROLES = {"access": "id", "weak_id": "id", "assign": "secret", "hex": "secret", "weak_secret": "secret", "endpoint": "address"}

#: What a candidate of each weak kind needs within its scope: the roles of a credential that it hasn't itself, the address aside.
NEEDS = {"weak_id": ("secret",), "weak_secret": ("id",), "endpoint": ("id", "secret")}


def _found(text: Column, kind: str) -> Column:
    """The pieces between matches and the matches themselves, or null if there is none."""
    pattern, group, _ = KINDS[kind]
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    mixed = [F.transform(whole, lambda x: x.rlike("[a-z]") & x.rlike("[A-Z]") & x.rlike("[0-9]")) if kind == "weak_secret" else F.transform(whole, lambda x: F.lit(True))]
    entries = F.zip_with(
        F.arrays_zip(pieces.alias("gap"), F.transform(whole, lambda x: F.length(x)).alias("size")),
        F.arrays_zip(F.transform(part, lambda x: F.length(x)).alias("counted"), mixed[0].alias("fit")),
        lambda a, b: F.struct(a["gap"].alias("gap"), a["size"].alias("size"), b["counted"].alias("counted"), b["fit"].alias("fit")),
    )
    hit = text.rlike(GATES[kind])
    if kind in ("assign", "weak_id"):
        hit = hit & text.rlike(pattern)
    return F.when(hit, entries)


def find_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, text_hash, kind, start, end, parts: every base span, and the candidates whose complements co-occur.

    parts: the credential (structs part_id, secret, address of kind, start, end) that an identifier
    or a candidate is linked to, else null. A text that occurs in several rows of one doc_id is
    scanned once.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    per_kind = F.array(*(F.struct(F.lit(kind).alias("kind"), _found(F.col("text"), kind).alias("found")) for kind in KINDS))
    held = text.select("doc_id", "text_hash", F.filter(per_kind, lambda x: F.size(x["found"]) > 1).alias("kinds")).filter(F.size("kinds") > 0)
    held = held.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.explode("kinds").alias("x"))
    each = held.select("doc_id", "text_hash", "x.kind", F.posexplode("x.found").alias("at", "m"))
    within = W.partitionBy("doc_id", "text_hash", "kind").orderBy("at")
    # Up to this match's end: its own and all earlier pieces and matches.
    end = F.sum(F.col("m.gap") + F.coalesce("m.size", F.lit(0))).over(within)
    least = F.coalesce(*(F.when(F.col("kind") == kind, F.lit(n)) for kind, (_, _, n) in KINDS.items()))
    spans = each.select("doc_id", "text_hash", "kind", "m", end.alias("end")).filter(F.col("m.size").isNotNull() & F.col("m.fit") & (F.col("m.counted") >= least))
    spans = staged(spans.select("doc_id", "text_hash", "kind", (F.col("end") - F.col("m.size")).alias("start"), "end"), "spans")
    linked = _linked(spans, scope)
    own = spans.filter(F.col("kind").isin(*BASE) & (F.col("kind") != "access")).withColumn("parts", F.lit(None).cast(linked.schema["parts"].dataType))
    return own.unionByName(linked)


def _linked(spans: DataFrame, scope: int) -> DataFrame:
    """The identifiers of base kind, and the candidates of weak kinds that have every complement within their scope, with the parts linked to them."""
    role = F.coalesce(*(F.when(F.col("kind") == kind, F.lit(r)) for kind, r in ROLES.items()))
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope)))
    base, weak = spans.filter(F.col("kind").isin(*BASE)), spans.filter(~F.col("kind").isin(*BASE))
    # A weak part that a base span covers is that span, and no further part.
    covers = base.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("start").alias("s"), F.col("end").alias("e"), bins(F.col("start"), F.col("end") - 1).alias("bin"))
    weak = weak.withColumn("bin", F.floor(F.col("start") / scope)).join(
        covers, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")) & (covers.bin == F.floor(F.col("start") / scope)) & (F.col("s") < F.col("end")) & (F.col("start") < F.col("e")), "left_anti"
    ).drop("bin")
    parts = base.unionByName(weak).withColumn("role", role)
    parts = staged(parts, "parts")
    filed = parts.select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("role").alias("its_role"), F.struct("kind", "start", "end").alias("it"), bins(F.col("start"), F.col("end") - 1).alias("bin")
    )
    asking = parts.filter(~F.col("kind").isin("assign", "hex"))
    looked = asking.withColumn("look", bins(F.greatest(F.lit(0), F.col("start") - scope), F.col("end") - 1 + scope))
    near = (F.col("it.start") < F.col("end") + scope) & (F.col("start") < F.col("it.end") + scope) & (F.col("role") != F.col("its_role"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")) & (F.col("look") == F.col("bin"))
    gap = F.greatest(F.lit(0), F.col("it.start") - F.col("end"), F.col("start") - F.col("it.end"))
    nearest = lambda r: F.min(F.when(F.col("its_role") == r, F.struct(gap.alias("gap"), F.col("it.start"), F.col("it.kind"), F.col("it.end")))).alias(r)
    key = ["doc_id", "text_hash", "kind", "start", "end", "role"]
    met = looked.join(filed, same & near).groupBy(*key).agg(*(nearest(r) for r in ("id", "secret", "address")))
    itself = F.struct("kind", "start", "end")
    part = lambda r: F.when(F.col("role") == r, itself).otherwise(F.when(F.col(r).isNotNull(), F.struct(F.col(f"{r}.kind"), F.col(f"{r}.start"), F.col(f"{r}.end"))))
    met = met.select(*key, F.struct(part("id").alias("part_id"), part("secret").alias("secret"), part("address").alias("address")).alias("parts"))
    met = met.filter("parts.part_id IS NOT NULL AND parts.secret IS NOT NULL").drop("role")
    alone = base.filter("kind = 'access'").join(met.select("doc_id", "text_hash", "kind", "start", "end", "parts").filter("kind = 'access'").toDF("d", "h", "k", "s", "e", "parts"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")) & (F.col("start") == F.col("s")), "left")
    return met.filter("kind <> 'access'").unionByName(alone.select("doc_id", "text_hash", "kind", "start", "end", "parts"))


def _order(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, F.lit(i)) for i, k in enumerate(KINDS)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


SPANS = "array<struct<start: bigint, rank: int, kind: string, end: bigint>>"


def _scanned(docs: DataFrame, scope: int) -> DataFrame:
    """The input's columns as c0, c1, ..., then found and credentials."""
    columns = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*columns)
    doc_id, text = (F.col(columns[docs.columns.index(c)]) for c in ("doc_id", "text"))
    place = lambda c: F.when(F.col(f"parts.{c}").isNotNull(), F.concat_ws(":", f"parts.{c}.kind", F.col(f"parts.{c}.start").cast("string"), F.col(f"parts.{c}.end").cast("string"))).otherwise("-")
    credential = F.when(F.col("parts").isNotNull(), F.concat_ws("+", place("part_id"), place("secret"), place("address")))
    spans = find_spans(docs.select("doc_id", "text"), scope).groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("start", _order(F.col("kind")).alias("rank"), "kind", "end"))).alias("found"), F.sort_array(F.collect_set(credential)).alias("credentials")
    )
    spans = spans.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    joined = plain.join(spans, doc_id.eqNullSafe(F.col("d")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("h")), "left")
    return joined.select(*columns, F.coalesce(F.col("found").cast(SPANS), F.array().cast(SPANS)).alias("found"), F.coalesce("credentials", F.array().cast("array<string>")).alias("credentials"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The input's columns, then ``found`` (all spans as structs start, rank of the kind, kind, end, in order) and ``credentials``.

    A credential reads identifier+secret+address, each as kind:start:end or - where none is near.
    Rows are joined with the spans of their text; texts without spans (most) have none there.
    """
    return _scanned(docs, scope).toDF(*docs.columns, "found", "credentials")


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = "[redacted]") -> DataFrame:
    """The input's rows and columns with every reported span replaced, and n_chars brought up to date."""
    text = F.col(f"c{docs.columns.index('text')}")
    found = _scanned(docs, scope)
    # Overlapping spans merge: a piece of text is kept from the furthest end so far to the next start.
    starts = F.concat(F.transform("found", lambda x: x["start"]), F.array(F.length(text).cast("long")))
    reach = F.aggregate(
        "found", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.greatest(F.element_at(a, -1), x["end"])))
    )
    found = found.withColumn("starts", starts).withColumn("reach", reach)
    gap = lambda i: F.get("starts", i) - F.get("reach", i)
    piece = lambda i: F.substring(text, (F.get("reach", i) + 1).cast("int"), gap(i).cast("int"))
    edge = lambda i: (i == 0) | (i == F.size("starts") - 1)
    kept = F.transform(F.sequence(F.lit(0), F.size("starts") - 1), lambda i: F.when(gap(i) > 0, piece(i)).when(edge(i), F.lit("")))
    clean = F.when(F.size("found") > 0, F.array_join(F.array_compact(kept), mark)).otherwise(text)
    found = found.withColumn("clean", clean)
    own = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return found.select(*(own.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)))


def op2_multipart_credentials(spark, sf_dir: str) -> DataFrame:
    """The spans of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), F.array_join("credentials", ",").alias("credentials"))
