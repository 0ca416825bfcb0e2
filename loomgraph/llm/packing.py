"""Mixture-controlled packing of tokenized documents.

Each source is a queue of its documents' token ids. Windows of ``window_sequences`` sequences
are filled by deficit round-robin: in every window a source earns its quantum, the window's
length times its target share, sends the whole tokens of its credit, and carries what it could
not send, its deficit, to the next window. After k windows the sources up to and including j
have sent ``floor(k * window * share(1..j))`` tokens together: quanta and carried deficits in
closed form, so that any document can be cut and placed from its source's running token count
alone, in any partition, without walking the windows before it. When a source runs dry, the rest go on with their shares scaled up from that
token on. Sources too small for two tokens a window share queues.

Targets: ``shares`` names a weight for each source, or they follow from the sources' token
counts to the power of ``temperature``: 1 is the corpus's own mixture, 0 the same share for all.

Steps: tokenize where the rows lie, with running counts per partition and source (written
once, compressed); add up a table of one row for each partition and source; place and cut
each document where it lies. No step sorts or gathers the ids of a source. The driver holds
the schedule: for each phase between two sources' ends, a number for each live source.

Defined cases: a null text is an empty text and has the end id only; a null source is a queue
of its own; repeated rows are packed each; queues of equal length end in the order of their
names; a very long text is cut like any other and tokenized in a batch of its own; extra
columns are ignored; an empty table gives an empty result. Sequences are filled to the last,
only the very last one can need padding (``padded_length``). There may be any number of sources.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm._store import dropped, staged

SEQUENCE = 4096
WINDOW_SEQUENCES = 16
TEMPERATURE = 0.7
CACHED_WORDS = 400_000  # about 80 MB in each Python worker
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, column: str, most_rows: int = 8192, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``most_bytes``; a longer text is a run of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most_bytes, side="right"))
        end = min(max(end, at + 1), at + most_rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def _offsets(strings: pa.Array) -> np.ndarray:
    return np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)


def _bytes(strings: pa.Array) -> np.ndarray:
    return np.frombuffer(strings.buffers()[2] or b"", np.uint8)


def _latin_1(strings: pa.Array) -> np.ndarray:
    """Whether all of a string's characters are below U+0100 (of which none is a combining mark, nor turns into one when lowered)."""
    high = np.concatenate([[0], np.cumsum(_bytes(strings) >= 0xC4)])
    return np.diff(high[_offsets(strings)]) == 0


class WordEncoder:
    """Token ids of many texts at once for a tokenizer that drops white space, with a bounded cache of words.

    Such a tokenizer never joins characters across white space, nor a letter with a sign, so a
    text's ids are those of its words, and a word's those of its letters and of the signs after
    them. Words are told apart in Arrow; each distinct one is looked up or encoded once, and the
    texts' ids are gathered from those. New words of Latin letters are encoded by the library as
    one text, whose ids are told apart by their end-of-word marks; any other new word is encoded
    alone. Letters A-Z are lowered first, as the tokenizer does, save in words with characters
    from U+0100 on (they could compose, or turn into several) or with the opening of a special token.
    """

    SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, cached_words: int = CACHED_WORDS) -> None:
        from tokenizers import Tokenizer

        self.cached_words = cached_words
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2") if size < 65_536 else np.dtype("<u4")
        self.ends = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.words: dict[str, bytes] = {"": b""}

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, fresh: list[tuple[str, bool]]) -> None:
        """Adds new units to the cache; the flag tells those of Latin letters."""
        known = self.words
        letters, others = [w for w, plain in fresh if plain], [w for w, plain in fresh if not plain]
        known.update(zip(others, self._alone(others)))
        parts = [letters[i : i + 5000] for i in range(0, len(letters), 5000)]
        for part, e in zip(parts, self.library.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                known.update(zip(part, self._alone(part)))
                continue
            width, raw, begin = self.dtype.itemsize, ids.tobytes(), 0
            for w, end in zip(part, (cuts * width).tolist()):
                known[w] = raw[begin:end]
                begin = end

    def _units(self, distinct: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Units to look up, and for each distinct word the unit of its letters (or all of it) and that of its trailing signs."""
        stems = pc.utf8_rtrim(distinct, characters=self.SIGNS)
        plain = pa.array(pc.utf8_is_alpha(stems).to_numpy(zero_copy_only=False) & _latin_1(distinct))
        first = pc.if_else(plain, stems, distinct)
        begin = _offsets(distinct)
        kept = pc.binary_length(first).to_numpy().astype(np.int64)
        sizes = np.diff(begin) - kept
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        data = _bytes(distinct)[np.repeat(begin[:-1] + kept - offsets[:-1], sizes) + np.arange(offsets[-1])]
        tails = pa.LargeStringArray.from_buffers(len(distinct), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
        coded = pa.concat_arrays([first, tails]).dictionary_encode()
        codes = coded.indices.to_numpy()
        return coded.dictionary, codes[: len(distinct)], codes[len(distinct) :]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts one after another, each followed by ``end_id``; number of ids of each text)."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        of_text = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(of_text[0], of_text[-1] - of_text[0]).dictionary_encode()
        words = coded.dictionary
        as_is = pc.match_substring(words, "<|").to_numpy(zero_copy_only=False) | ~_latin_1(words)
        again = pc.if_else(pa.array(as_is), words, pc.ascii_lower(words)).dictionary_encode()
        distinct, first, second = self._units(again.dictionary)
        units, plain = distinct.to_numpy(zero_copy_only=False).tolist(), pc.utf8_is_alpha(distinct).to_numpy(zero_copy_only=False) & _latin_1(distinct)
        if len(self.words) > self.cached_words:  # the words of these texts stay
            self.words = {w: self.words[w] for w in units if w in self.words} | {"": b""}
        self._learn([(w, p) for w, p in zip(units, plain.tolist()) if w not in self.words])
        own = list(map(self.words.__getitem__, units))
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
        ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(np.concatenate([[0], ends]).tobytes()), pa.py_buffer(b"".join(own))])
        place = again.indices.to_numpy()[coded.indices.to_numpy()]
        taken = ids.take(pa.array(np.stack([first[place], second[place]], 1).ravel()))
        if len(taken):
            ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] // self.dtype.itemsize
            flat = np.frombuffer(taken.buffers()[2] or b"", self.dtype)[: ends[-1]]
        else:
            ends, flat = np.zeros(1, np.int64), np.empty(0, self.dtype)
        upto = ends[2 * (of_text - of_text[0])]
        return np.insert(flat, upto[1:], self.dtype.type(end_id)), np.diff(upto) + 1

    def encode_binary(self, texts: pa.Array, end_id: int) -> tuple[pa.Array, np.ndarray]:
        """(little-endian ids of each text; their number)."""
        flat, sizes = self.encode(texts, end_id)
        offsets = np.concatenate([[0], np.cumsum(sizes * self.dtype.itemsize)])
        if offsets[-1] >= 1 << 31:
            raise ValueError("a text's ids exceed two gigabytes")
        return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())]), sizes


@lru_cache(maxsize=2)
def _encoder(path: str, cached_words: int = CACHED_WORDS) -> WordEncoder:
    return WordEncoder(path, cached_words)


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, cached_words: int = CACHED_WORDS) -> DataFrame:
    """part, source, doc_id, begin (tokens of that source before it in its partition), n, ids: written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, sent = _encoder(tokenizer_path, cached_words), TaskContext.get().partitionId(), {}
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, sizes = encoder.encode_binary(batch.column("text"), end_id)
                begins = []
                for source, n in zip(batch.column("source").to_pylist(), sizes.tolist()):
                    begins.append(sent.get(source, 0))
                    sent[source] = begins[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(sizes), part, np.int32)), batch.column("source"), batch.column("doc_id"), pa.array(begins, pa.int64()), pa.array(sizes, pa.int64()), ids],
                    names=["part", "source", "doc_id", "begin", "n", "ids"],
                )

    return staged(docs.select("doc_id", "source", "text").mapInArrow(run, "part int, source string, doc_id long, begin long, n long, ids binary"), "tokens")


class Schedule:
    """Which token of a source's queue lies in which window, in closed form.

    sizes: tokens of each source; shares: its weight in every window (its size by default). A source
    that would earn less than two tokens a window shares a queue with others of that kind, one after another in the
    order in which they would end, so that every queue earns a token in each window. A queue of s tokens and weight w ends when s / w has been
    earned for each unit of weight. In the order of those ends, the queues up to and including i have
    sent after k windows what the ended ones held and, rounded down, their share of the rest. So a number for each queue's
    end and sums along that order tell everything: what is held is linear in the sources.
    """

    def __init__(self, sizes: list[int], shares: list[int] | None, window: int) -> None:
        self.window = window
        weights = [max(w, 1) for w in shares or sizes]
        live = [j for j, n in enumerate(sizes) if n]
        least = -(-2 * sum(weights[j] for j in live) // window)
        by_end = sorted(live, key=lambda j: (Fraction(sizes[j], weights[j]), j))
        queues: list[list[int]] = [[j] for j in by_end if weights[j] >= least]
        small: list[list[int]] = [[]]
        for j in (j for j in by_end if weights[j] < least):
            if sum(weights[i] for i in small[-1]) >= least:
                small.append([])
            small[-1].append(j)
        if len(small) > 1 and sum(weights[i] for i in small[-1]) < least:
            rest = small.pop()
            small[-1] += rest
        held = [(sum(sizes[j] for j in q), max(least, sum(weights[j] for j in q)), q) for q in [*queues, *small] if q]
        held.sort(key=lambda x: (Fraction(x[0], x[1]), x[2][0]))
        self.weights = [w for _, w, _ in held]
        self.sent, self.weighed = list(accumulate(n for n, _, _ in held)), list(accumulate(self.weights))
        total = self.weighed[-1] if held else 0
        self.total, self.windows = total, -(-self.sent[-1] // window) if held else 0
        #: By queue: windows after which it has ended, and what has been earned for a unit of weight by then.
        self.ended = [-(-(sent * w + n * (total - upto)) // (w * window)) for (n, w, _), sent, upto in zip(held, self.sent, self.weighed)]
        self.ends_at = [n / w for n, w, _ in held]
        self.place_of: dict[int, tuple[int, int]] = {}  # by source: its queue and how many tokens come before it there
        for i, (_, _, q) in enumerate(held):
            before = 0
            for j in q:
                self.place_of[j] = i, before
                before += sizes[j]

    def _upto(self, i: int, k: int) -> int:
        """Tokens of the queues 0..i in the first k windows."""
        if i < 0:
            return 0
        ended = bisect_right(self.ended, k)
        if i < ended:
            return self.sent[i]
        sent, weighed = (self.sent[ended - 1], self.weighed[ended - 1]) if ended else (0, 0)
        return sent + (k * self.window - sent) * (self.weighed[i] - weighed) // (self.total - weighed)

    def _sent(self, i: int, k: int) -> int:
        return self._upto(i, k) - self._upto(i - 1, k)

    def _window(self, i: int, token: int) -> int:
        """The window in which a queue's token is sent: near where the queue has earned that much."""
        earned = token / self.weights[i]
        ended = bisect_right(self.ends_at, earned)
        sent, weighed = (self.sent[ended - 1], self.weighed[ended - 1]) if ended else (0, 0)
        k = max(0, min(self.windows - 1, int((sent + earned * (self.total - weighed)) / self.window)))
        while self._sent(i, k) > token:
            k -= 1
        while self._sent(i, k + 1) <= token:
            k += 1
        return k

    def pieces(self, j: int, begin: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(window, place in the window, length) of the source's tokens begin..begin+n, in order."""
        if not n:
            return
        i, before = self.place_of[j]
        token = before + begin
        while n:
            k = self._window(i, token)
            place = self._upto(i - 1, k + 1) - self._upto(i - 1, k)
            done, end = self._sent(i, k), self._sent(i, k + 1)
            length = min(n, end - token)
            yield k, place + token - done, length
            token, n = token + length, n - length


def padded_length(used: int, sequence: int = SEQUENCE) -> int:
    """Length of a sequence with so many tokens: its own if a power of two, else the full one."""
    return used if used and not used & (used - 1) else sequence


def target_weights(sizes: list[int], temperature: float) -> list[int]:
    """Weights in proportion to the sizes to the power of ``temperature``, the largest a billion."""
    most = max(sizes, default=1)
    return [max(1, round(1e9 * (n / most) ** temperature)) if n else 0 for n in sizes]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    sequence: int = SEQUENCE,
    window_sequences: int = WINDOW_SEQUENCES,
    shares: dict[str | None, int] | None = None,
    temperature: float = TEMPERATURE,
    with_ids: bool = False,
    cached_words: int = CACHED_WORDS,
) -> DataFrame:
    """One row for each piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, window_id, and the piece's ids if asked for.

    shares: weight of each source in every window; sources that aren't named get weight 1. By
    default a weight is the source's token count to the power of ``temperature``. cached_words:
    how many encoded words a Python worker keeps, its memory against its time.
    """
    spark = docs.sparkSession
    tokens = tokenize(docs, tokenizer_path, end_id, cached_words)
    parts = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = staged(parts.select("source", "part", "n", before.alias("base")), "bases")
    sizes = {r["source"]: r["n"] for r in bases.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    sources = sorted(sizes, key=lambda s: (s is not None, s or ""))
    window = sequence * window_sequences
    weights = [shares.get(s, 1) for s in sources] if shares else target_weights([sizes[s] for s in sources], temperature)
    schedule = Schedule([sizes[s] for s in sources], weights, window)
    number = {s: j for j, s in enumerate(sources)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _encoder(tokenizer_path, cached_words).dtype
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                rows: list[tuple] = []
                names = batch.column("source").to_pylist()
                for doc, source, begin, n, raw in zip(batch.column("doc_id").to_pylist(), names, batch.column("place").to_pylist(), batch.column("n").to_pylist(), batch.column("ids")):
                    ids, start = np.frombuffer(raw.as_buffer(), width).astype("<u4"), 0
                    for k, place, length in schedule.pieces(number[source], begin, n):
                        while length:  # the sequences of the window
                            step = min(length, sequence - place % sequence)
                            own = ids[start : start + step].tobytes()
                            rows.append((doc, source, start, step, zlib.crc32(own), n, k * (window // sequence) + place // sequence, place % sequence, k, own if with_ids else None))
                            start, place, length = start + step, place + step, length - step
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=columns)

    columns = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window_id", *["ids"] * with_ids]
    types = [pa.int64(), pa.string(), *[pa.int64()] * 7, *[pa.binary()] * with_ids]
    # The sums of each partition: the join's own size estimate decides whether they are broadcast.
    placed = tokens.join(bases.withColumnRenamed("n", "_n"), (tokens.part == bases.part) & tokens.source.eqNullSafe(bases.source)).select(
        tokens.source, "doc_id", (F.col("begin") + F.col("base")).alias("place"), tokens.n, "ids"
    )
    schema = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window_id long"
    return placed.mapInArrow(cut, schema + ", ids binary" * with_ids)


def op3_mixture_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into 4096-token sequences; small sources are raised in every window by the temperature."""
    import public_tokenizers as vocabularies

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabularies.path("word_bpe_49k.json"))
