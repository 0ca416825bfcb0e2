"""Best-fit-decreasing packing against the piece-by-piece search, and as a lossless layout."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as vocabularies
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import binpack
from loomgraph.llm.packing import WordEncoder

TOKENIZER = vocabularies.path("word_bpe_49k.json")


def one_by_one(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return Counter(rooms)


def test_patterns_equal_the_search_piece_by_piece():
    rng = np.random.default_rng(4)
    for _ in range(60):
        capacity = int(rng.integers(8, 60))
        lengths = rng.integers(1, capacity, int(rng.integers(1, 200))).tolist()
        found = binpack.patterns(Counter(lengths), capacity)
        assert Counter(x for content, n in found for x in content * n) == Counter(lengths)
        assert Counter({r: c for r, c in one_by_one(lengths, capacity).items()}) == sum((Counter({capacity - sum(c): n}) for c, n in found), Counter())


def test_layout_is_lossless(spark, small):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "long " * 700)], docs.schema))
    library = Tokenizer.from_file(TOKENIZER)
    want = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    pieces = binpack.best_fit_pack(docs, TOKENIZER, capacity=256, with_ids=True)
    by, rows = defaultdict(list), defaultdict(list)
    for r in pieces.collect():
        ids = np.frombuffer(r["ids"], "<u2").astype("<u4")
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"] and r["segment_end"] == r["offset"] + r["length"] and r["doc_tokens"] == len(want[r["doc_id"]])
        by[r["doc_id"]].append((r["start"], ids.tolist()))
        rows[r["sequence_id"]].append((r["offset"], r["segment_end"]))
    assert {d: [i for _, x in sorted(parts) for i in x] for d, parts in by.items()} == want
    assert sorted(rows) == list(range(len(rows)))
    for own in rows.values():
        at = 0
        for start, end in sorted(own):
            assert start == at
            at = end
        assert at <= 256
    total = sum(map(len, want.values()))
    assert len(rows) <= 1.05 * total / 256 + 1
    matrix = {r["sequence_id"]: r for r in binpack.packed_matrix(pieces, 256).collect()}
    for row, own in rows.items():
        assert matrix[row]["segment_ends"] == [e for _, e in sorted(own)] and len(matrix[row]["ids"]) == 256
        assert all(matrix[row]["positions"][s:e] == list(range(e - s)) for s, e in own)
        for (s, e), d, start in zip(sorted(own), matrix[row]["doc_ids"], matrix[row]["starts"]):
            assert matrix[row]["ids"][s:e] == want[d][start : start + e - s]
        assert not any(matrix[row]["ids"][max(e for _, e in own) :])


def test_empty_table(spark):
    none = binpack.best_fit_pack(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER, with_ids=True)
    assert none.collect() == [] and binpack.packed_matrix(none).collect() == []


ENCODER = None


@given(st.lists(st.sampled_from(["a", "The", "ß", "É", "é", "ſ", "K", "İ", "Σ", "ς", " ", " ", "\x0b", "\x1c", "\x85", " ", "　", "\xa0", "'s", "'", "’", ".", ",", "!!", "-", "1", "٢", "²", "ª", "µ", "́", "ﬁ", "日", "😀", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "<|ENDOFTEXT|>", "H", "\u0331", "_", "$"]), max_size=30))
@settings(max_examples=600, deadline=None)
def test_cached_words_encode_as_the_library_does(parts):
    global ENCODER
    ENCODER = ENCODER or WordEncoder(TOKENIZER)
    text = "".join(parts)
    want = np.array(ENCODER.library.encode(text, add_special_tokens=False).ids, ENCODER.dtype).tobytes()
    # Alone, and among other texts.
    texts = pa.array([text, None, "plain " + text, text.upper()], pa.string())
    alone = np.array([*ENCODER.library.encode(text, add_special_tokens=False).ids, 2], ENCODER.dtype).tobytes()
    assert alone[: -ENCODER.dtype.itemsize] == want and ENCODER.encode_binary(texts.slice(0, 1), 2)[0].to_pylist() == [alone]
    ids = [np.array([*ENCODER.library.encode(t or "", add_special_tokens=False).ids, 2], ENCODER.dtype).tobytes() for t in texts.to_pylist()]
    found, sizes = ENCODER.encode_binary(texts.slice(1), 2)
    assert found.to_pylist() == ids[1:] and sizes.tolist() == [len(x) // ENCODER.dtype.itemsize for x in ids[1:]]
