"""BPE encoding and decoding of whole texts by tree concatenation.

A long text is halved until a leaf is short; all leaves of a text are encoded in one batch, by
``THREADS`` threads of the libraries (which don't hold Python's lock). Two neighbours are then joined bottom-up: a window
of tokens around the join is encoded again, and grows until its first token equals the left
side's and its last token the right side's, at edges where that proves the whole join exact:

* an edge between a visible character and a space that a visible character follows is a
  split point of the pre-tokenizer whatever stands around it, or
* an edge within a run of letters, digits, signs or spaces lies in one unsplit piece on both
  sides; there BPE is locally determined: a token sequence in which every neighbouring pair
  occurs in some valid encoding of its own surroundings is the encoding.

When no window qualifies, the window ends up as the whole text, so the result is always that
of the library. Documents are spread over tasks; a task holds an Arrow batch of texts and the ids of one of them.

Defined cases: a null text is an empty text (0 tokens, hash of the empty string); the special
token's string in a text becomes the special id and decodes to itself; repeated rows are
encoded alike; a very long text is a tree of many leaves; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

LEAF_CHARS = 8_192
THREADS = 4
SPECIAL = "<|endoftext|>"


class Codec:
    """The tokenizer file's encoder and decoder, with a faster twin of the same vocabulary.

    Texts of Latin-1 characters go through the rank-based library (same merges, same split
    pattern, equal ids); any other text goes through the tokenizers library itself, whose
    tables of character classes may be of another Unicode version.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path)
        self.library.no_truncation()
        self.library.no_padding()
        self.ranked = None
        if ranks_path and pattern:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.special = {SPECIAL: self.library.token_to_id(SPECIAL)}
            self.ranked = tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        size = self.library.get_vocab_size(with_added_tokens=True)
        to_byte = _byte_alphabet()
        added = self.library.get_added_tokens_decoder()
        self.pieces = [
            added[i].content.encode() if i in added else bytes(to_byte[c] for c in self.library.id_to_token(i)) for i in range(size)
        ]
        self.decimal = [str(i) for i in range(size)]

    def encode_leaf(self, text: str) -> list[int]:
        if self.ranked is not None:
            try:
                text.encode("latin-1")
                return self.ranked.encode(text, allowed_special={SPECIAL})
            except UnicodeEncodeError:
                pass
        return self.library.encode(text, add_special_tokens=False).ids

    def encode_leaves(self, texts: list[str]) -> list[list[int]]:
        """The ids of some texts, encoded in parallel."""
        if len(texts) == 1:
            return [self.encode_leaf(texts[0])]
        ranked = [self.ranked is not None and (t.isascii() or max(t) < "\u0100") for t in texts]
        fast, other = [t for t, r in zip(texts, ranked) if r], [t for t, r in zip(texts, ranked) if not r]
        found = iter(self.ranked.encode_batch(fast, num_threads=THREADS, allowed_special={SPECIAL})) if fast else iter(())
        rest = iter([e.ids for e in self.library.encode_batch(other, add_special_tokens=False)])
        return [next(found) if r else next(rest) for r in ranked]

    def encode(self, text: str, leaf: int = LEAF_CHARS) -> list[int]:
        return encode_tree(text, self.encode_leaves, self.pieces, leaf)

    def decode(self, ids: list[int]) -> str:
        """As the library's decode with skip_special_tokens=False."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def _byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _kind(c: str) -> str:
    if c.isalpha():
        return "letter"
    if c.isnumeric():
        return "digit"
    if c.isspace():
        return "space"
    return "mark" if c in "'<|>" else "sign"


def _sure(text: str, at: int) -> bool:
    """Whether an edge at ``at`` is one of the two sorts that the module names."""
    if not 2 <= at <= len(text) - 2:
        return False
    before, after, beyond = text[at - 1], text[at], text[at + 1]
    if after == " " and not before.isspace() and not beyond.isspace():
        return True
    kinds = {_kind(text[at - 2]), _kind(before), _kind(after), _kind(beyond)}
    return len(kinds) == 1 and "mark" not in kinds


def encode_tree(text: str, encode: Callable[[list[str]], list[list[int]]], pieces: list[bytes], leaf: int = LEAF_CHARS) -> list[int]:
    """``encode([text])[0]``, computed from leaves of at most ``leaf`` characters."""
    spans = [(0, len(text))]
    while max(e - s for s, e in spans) > leaf:
        spans = [x for s, e in spans for x in (((s, (s + e) // 2), ((s + e) // 2, e)) if e - s > leaf else ((s, e),))]
    if len(spans) == 1:
        return encode([text])[0]
    parts = [(s, e, ids) for (s, e), ids in zip(spans, encode([text[s:e] for s, e in spans]))]
    while len(parts) > 1:
        joined = [_join(text, a, b, encode, pieces) for a, b in zip(parts[::2], parts[1::2])]
        parts = joined + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0][2]


def _edges(text: str, ids: list[int], pieces: list[bytes], start: int, backwards: bool) -> Iterator[tuple[int, int]]:
    """(number of tokens from the join, character place) of token edges at whole characters, from the join outwards."""
    size, at = 0, start
    for n, i in enumerate(reversed(ids) if backwards else ids, 1):
        piece = pieces[i]
        # A character begins at every byte that isn't a continuation byte.
        at += (-1 if backwards else 1) * sum((b & 0xC0) != 0x80 for b in piece)
        size += len(piece)
        edge = n == len(ids)
        if not edge:
            follows = piece if backwards else pieces[ids[n]]
            edge = (follows[0] & 0xC0) != 0x80
        if edge:
            yield n, at


def _join(text: str, left: tuple, right: tuple, encode: Callable, pieces: list[bytes]) -> tuple:
    (start, middle, a), (_, end, b) = left, right
    before, after = _edges(text, a, pieces, middle, True), _edges(text, b, pieces, middle, False)
    want = 8
    na = nb = 0
    while True:
        while na < len(a):
            na, from_char = next(before)
            if na >= min(want, len(a)) and (na == len(a) or _sure(text[:end], from_char) and from_char - start >= 2):
                break
        while nb < len(b):
            nb, to_char = next(after)
            if nb >= min(want, len(b)) and (nb == len(b) or _sure(text[:end], to_char)):
                break
        from_char = start if na == len(a) else from_char
        to_char = end if nb == len(b) else to_char
        window = encode([text[from_char:to_char]])[0]
        whole_left, whole_right = na == len(a), nb == len(b)
        agrees = (whole_left or window[:1] == a[-na : len(a) - na + 1]) and (whole_right or window[-1:] == b[nb - 1 : nb])
        if agrees:
            return start, end, a[: len(a) - na] + window + b[nb:]
        want = 2 * max(na, nb)


@lru_cache(maxsize=2)
def _codec(tokenizer_path: str, ranks_path: str | None, pattern: str | None) -> Codec:
    return Codec(tokenizer_path, ranks_path, pattern)


def encode_documents(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, and the ids and decoded text if asked for.

    The paths name files that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokenizer_path, ranks_path, pattern)
        for batch in batches:
            counts, id_hashes, text_hashes, all_ids, texts = [], [], [], [], []
            for text in batch.column("text"):
                ids = codec.encode(text.as_py() or "")
                decoded = codec.decode(ids)
                counts.append(len(ids))
                id_hashes.append(hashlib.sha256(",".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest())
                text_hashes.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                    texts.append(decoded)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>, decoded string" if with_ids else ""))


def op9_bpe_tree_encode(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the byte-level vocabulary."""
    import public_tokenizers as vocabularies

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, vocabularies.path("byte_bpe_50k.json"), vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)
