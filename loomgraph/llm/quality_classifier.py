"""Quality classifier: multiple-instance learning with gated attention.

A document is a bag of passages of 64 words. Every passage is encoded as shares of byte
classes, word shapes, repetition within the passage and within the whole text, and hashed
word frequencies. A small network embeds each passage, weighs it against the document's other
passages by a learned gate, and scores the weighted mean: labels are given for documents
only, the weights of passages are learned from them.

The network is fitted on the driver from a bounded sample: at most ``train_documents``
labelled rows (those of the lowest hash of doc_id), with all passages of each.
Scoring covers every passage of every document, where the rows lie.

Only the text enters a score. Defined cases: a null or empty text, or one without words, is
one empty passage and gets that passage's score; a very long text has as many passages as it
needs; a null doc_id is hashed as the empty string;
several labels of one doc_id count as the lowest; of several texts of one labelled doc_id the one
of the least features trains; ids of equal hash are taken in order; without any label every score is
0.5; repeated rows score alike; extra columns are carried along by ``score_documents`` and
``keep_documents``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgraph.llm._words import _word_hashes, mix64

PASSAGE = 64
TRAIN_DOCUMENTS = 6000
THRESHOLD = 0.3
HASHED = 48
FEATURES = 18 + HASHED
HIDDEN = 16

_CLASS = np.full(256, 5, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 3
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 4
_CLASS[128:192], _CLASS[192:] = 6, 7


def _first_in(groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether an entry is the first of its value within its group."""
    order = np.lexsort((np.arange(len(values)), values, groups))
    g, v = groups[order], values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    out = np.empty(len(values), bool)
    out[order] = fresh
    return out


def _encode_group(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, number of passages of each text)."""
    data = b" ".join(group)
    hashes, starts = _word_hashes(data)
    b = np.frombuffer(data, np.uint8)
    ends = np.cumsum([len(x) + 1 for x in group])
    upto = np.searchsorted(starts, ends)
    words = np.diff(np.concatenate([[0], upto]))
    passages = np.maximum(1, -(-words // PASSAGE))
    first = np.concatenate([[0], np.cumsum(passages)[:-1]])
    doc = np.repeat(np.arange(len(group)), words)
    at = np.arange(len(hashes)) - np.repeat(np.concatenate([[0], upto[:-1]]), words)
    p = first[doc] + at // PASSAGE
    n = int(passages.sum())
    x = np.zeros((n, FEATURES), np.float32)
    if not len(hashes):
        return x, passages
    space = (b == 32) | ((b >= 9) & (b <= 13))
    stops = np.flatnonzero(np.diff(np.concatenate([space, [True]]).astype(np.int8)) == 1) + 1
    size = stops - starts
    kinds = _CLASS[b[~space]].astype(np.int64)
    owner = np.repeat(p, size)
    x[:, :8] = np.bincount(owner * 8 + kinds, minlength=n * 8).reshape(n, 8)
    total, count = np.maximum(1, x[:, :8].sum(1)), np.maximum(1, np.bincount(p, minlength=n))
    x[:, :8] /= total[:, None]
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    upper, sign = np.add.reduceat(kinds == 1, begin, dtype=np.int64), _CLASS[b[stops - 1]] == 4
    mean = lambda v: np.bincount(p, v, minlength=n) / count
    x[:, 8] = mean(size) / 10
    x[:, 9] = np.sqrt(np.maximum(0, mean(size.astype(float) ** 2) - mean(size) ** 2)) / 10
    x[:, 10] = mean(_first_in(p, hashes))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    x[:, 11] = mean(again)
    x[:, 12], x[:, 13], x[:, 14] = mean(sign), mean(2 * upper > size), mean(size == 1)
    x[:, 15] = count / PASSAGE
    x[:, 16] = mean(_first_in(doc, hashes))
    three = np.zeros(len(hashes), np.uint64)
    for j in range(3):
        three[: len(hashes) - j] = mix64(three[: len(hashes) - j] + hashes[j:]) if len(hashes) > j else three[:0]
    x[:, 17] = mean(_first_in(doc, three))
    bucket = (hashes >> np.uint64(40)).astype(np.int64) % HASHED
    x[:, 18:] = np.bincount(p * HASHED + bucket, minlength=n * HASHED).reshape(n, HASHED) / count[:, None]
    return x, passages


def encode_passages(texts: list[str | None], slice_bytes: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of all passages of some texts, and their number by text, slice by slice."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        group.append((text or "").encode())
        size += len(group[-1]) + 1
        if size >= slice_bytes:
            yield _encode_group(group)
            group, size = [], 0
    if group:
        yield _encode_group(group)


class AttentionScorer:
    """Embedding, gated attention over passages, and a logistic score."""

    def __init__(self, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        w = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.shift, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.p = {"E": w(FEATURES, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": w(HIDDEN, HIDDEN), "U": w(HIDDEN, HIDDEN), "a": w(HIDDEN), "c": w(HIDDEN), "b": np.zeros(1, np.float32)}

    def _forward(self, x: np.ndarray, counts: np.ndarray) -> tuple:
        q, begin = self.p, np.concatenate([[0], np.cumsum(counts)[:-1]])
        h = np.tanh(x @ q["E"] + q["e"])
        t, g = np.tanh(h @ q["V"]), 1 / (1 + np.exp(-(h @ q["U"])))
        s = (t * g) @ q["a"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, begin), counts))
        s /= np.repeat(np.add.reduceat(s, begin), counts)
        z = np.add.reduceat(s[:, None] * h, begin)
        return h, t, g, s, z, 1 / (1 + np.exp(-np.clip(z @ q["c"] + q["b"][0], -30, 30)))

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self._forward(np.clip((x - self.shift) / self.scale, -8, 8), counts)[-1]

    def attention(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The weight of each passage within its document."""
        return self._forward(np.clip((x - self.shift) / self.scale, -8, 8), counts)[3]

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> AttentionScorer:
        every = np.concatenate(bags)
        self.shift, self.scale = every.mean(0), every.std(0) + 1e-3
        bags = [np.clip((x - self.shift) / self.scale, -8, 8) for x in bags]
        m, v, step = {k: np.zeros_like(w) for k, w in self.p.items()}, {k: np.zeros_like(w) for k, w in self.p.items()}, 0
        r = np.random.default_rng(seed)
        for epoch in range(epochs):
            order = r.permutation(len(bags))
            for at in range(0, len(bags), batch):
                own = order[at : at + batch]
                grads = self._gradients(np.concatenate([bags[i] for i in own]), np.array([len(bags[i]) for i in own]), y[own])
                step += 1
                for k, d in grads.items():
                    d = d + decay * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                    pace = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
                    self.p[k] = (self.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def _gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        q, begin = self.p, np.concatenate([[0], np.cumsum(counts)[:-1]])
        h, t, g, s, z, out = self._forward(x, counts)
        d = ((out - y) / len(y)).astype(np.float32)
        dz = np.repeat(d[:, None] * q["c"], counts, axis=0)
        ds = (dz * h).sum(1)
        ds = s * (ds - np.repeat(np.add.reduceat(s * ds, begin), counts))
        dt, dg = ds[:, None] * q["a"] * g * (1 - t * t), ds[:, None] * q["a"] * t * g * (1 - g)
        dh = (dz * s[:, None] + dt @ q["V"].T + dg @ q["U"].T) * (1 - h * h)
        return {"c": z.T @ d, "b": d.sum(keepdims=True), "a": (t * g).T @ ds, "V": h.T @ dt, "U": h.T @ dg, "E": x.T @ dh, "e": dh.sum(0)}


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from training: crc32 of the id's decimal text divides by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_classifier(docs: DataFrame, labels: DataFrame, train_documents: int = TRAIN_DOCUMENTS) -> AttentionScorer | None:
    """The network fitted on labelled rows outside the held-out fold, or None without any."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sample = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_documents)
    # At most train_documents rows of two numbers.
    chosen = {r["doc_id"]: r["quality"] for r in sample.collect()}
    if not chosen:
        return None
    wanted = docs.sparkSession.createDataFrame(list(chosen.items()), "doc_id long, quality int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [own.tobytes() for x, counts in encode_passages(batch.column("text").to_pylist()) for own in np.split(x, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bags, pa.binary())], names=["doc_id", "bag"])

    texts = docs.select("doc_id", "text").join(F.broadcast(wanted.select("doc_id")), "doc_id", "left_semi").mapInArrow(run, "doc_id long, bag binary")
    rows = sorted((r["doc_id"], bytes(r["bag"])) for r in texts.groupBy("doc_id").agg(F.min("bag").alias("bag")).collect())
    bags = [np.frombuffer(bag, np.float32).reshape(-1, FEATURES) for _, bag in rows]
    return AttentionScorer().fit(bags, np.array([chosen[i] for i, _ in rows], np.float32))


def score_documents(docs: DataFrame, model: AttentionScorer | None, threshold: float = THRESHOLD) -> DataFrame:
    """The input's columns with score and predicted."""
    columns = docs.columns
    names = [f"c{i}" for i in range(len(columns))]
    plain = docs.toDF(*names)
    text = names[columns.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                scores = np.full(batch.num_rows, 0.5)
            else:
                scores = [model.score(x, counts) for x, counts in encode_passages(batch.column(text).to_pylist())]
                scores = np.concatenate(scores).astype(np.float64) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*names, "s", "p"])

    schema = StructType([*plain.schema.fields]).add("s", "double").add("p", "integer")
    return plain.mapInArrow(run, schema).toDF(*columns, "score", "predicted")


def keep_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier keeps, with their own columns."""
    columns = docs.columns
    scored = score_documents(docs, fit_classifier(docs, labels))
    kept = scored.toDF(*(f"c{i}" for i in range(len(columns) + 2))).filter(F.col(f"c{len(columns) + 1}") == 1)
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))


def op10_attention_mil(spark, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
