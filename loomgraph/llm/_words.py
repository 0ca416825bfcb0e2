"""Words and word n-grams of many texts at once, as 64-bit hashes, in numpy.

A word is a run of bytes other than space and \\x09-\\x0D (in UTF-8 those bytes never lie
inside another character). Hashes are of 64 bits; within one document of a million n-grams
two different ones meet with a chance of 3e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_M1, _M2, _BASE = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B185EBCA87), np.uint64(0x100000001B3)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, place of its first byte)."""
    b = np.frombuffer(data, np.uint8)
    b = b + ((b >= 65) & (b <= 90)) * np.uint8(32)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lengths = ends - starts
    solid = b[~space].astype(np.uint64) + np.uint64(1)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    powers = np.cumprod(np.concatenate([[1], np.full(int(lengths.max()) - 1, _BASE, np.uint64)]).astype(np.uint64))
    within = np.arange(len(solid)) - np.repeat(first, lengths)
    h = np.add.reduceat(solid * powers[within], first)
    return mix64(h ^ (lengths.astype(np.uint64) * _M2)), starts


def shingle_sets(texts: list[str | None], k: int, slice_bytes: int = 1 << 20) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each lower-cased text.

    A text of fewer than k words has its whole sequence as one shingle; one without words has none.
    """
    group: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode()
        group.append(data)
        size += len(data) + 1
        if size >= slice_bytes:
            yield from _sets(group, k)
            group, size = [], 0
    if group:
        yield from _sets(group, k)


def _sets(group: list[bytes], k: int) -> Iterator[np.ndarray]:
    words, starts = _word_hashes(b" ".join(group))
    ends = np.cumsum([len(x) + 1 for x in group])
    upto = np.searchsorted(starts, ends)
    acc = np.zeros(len(words), np.uint64)
    for j in range(k):
        if len(words) > j:
            acc[: len(words) - j] = mix64(acc[: len(words) - j] * _M1 + words[j:])
    begin = 0
    for end in upto.tolist():
        n = end - begin
        if n >= k:
            yield np.unique(acc[begin : end - k + 1])
        elif n:
            short = np.array([n], np.uint64)
            for j in range(begin, end):
                short = mix64(short * _M1 + words[j : j + 1] + np.uint64(1))
            yield short
        else:
            yield np.empty(0, np.uint64)
        begin = end
