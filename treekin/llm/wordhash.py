"""Words of whole Arrow string columns and their 64-bit hashes, vectorised with NumPy.

A word is a longest run of bytes outside a delimiter set.  Every delimiter is an ASCII byte, so cutting UTF-8 text at
bytes never splits a code point.  A word's hash is the sum, over its bytes, of mixed 64-bit values of the byte and its place in the word,
taken from prefix sums over a whole block, and then finalised; equal words have equal hashes in every process.  Mixing is not
linear in the place, so that regular words (repeated or mirrored patterns) have no more collisions than others.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Python workers live on after a task.  With glibc, arrays of 4 MB or more get pages of their own, which go back when the array does;
# the C library would otherwise raise that limit by itself and keep what was freed.  Elsewhere nothing changes.
with contextlib.suppress(OSError, AttributeError):
    for _option in (-3, -1):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
        ctypes.CDLL(None).mallopt(_option, 4 << 20)

#: Bytes of text handled at once; a longer document is cut at a delimiter, a longer word is kept whole.
BLOCK = 1 << 19
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _table(delimiters: str) -> np.ndarray:
    """Of each byte: whether it is part of a word."""
    word = np.ones(256, bool)
    word[[ord(c) for c in delimiters]] = False
    return word


#: Everything but space and \x09-\x0D.
SPACED = _table(" \t\n\x0b\x0c\r")
#: ASCII letters and digits, and everything beyond ASCII.
ALNUM = _table("".join(chr(c) for c in range(128) if not chr(c).isalnum()))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of consecutive texts: byte offsets from the first text's start, hashes, and where each text's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # len(texts) + 1


def words_of(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = SPACED, lower: bool = False) -> Words:
    """data: the bytes of texts one after the other; offsets: where each begins, and the end of the last."""
    total, at, edges = int(offsets[-1]), 0, offsets
    starts, ends, hashes = [], [], []
    while at < total:
        stop = min(total, at + BLOCK)
        if stop < total:  # cut where a text begins or at a delimiter
            k = int(np.searchsorted(edges, stop, "right")) - 1
            if edges[k] > at:
                stop = int(edges[k])
            else:
                back = np.flatnonzero(~word[data[max(at, stop - 4096) : stop]])
                if len(back):
                    stop = max(at, stop - 4096) + int(back[-1]) + 1
                else:
                    limit = int(edges[k + 1])
                    while stop < limit and word[data[stop]]:
                        ahead = np.flatnonzero(~word[data[stop : stop + 65536]])
                        stop = min(limit, stop + (int(ahead[0]) if len(ahead) else 65536))
        part = data[at:stop]
        inside = word[part]
        if lower:
            part = _LOWER[part]
        n = len(part)
        border = np.zeros(n + 1, bool)
        lo, hi = np.searchsorted(edges, [at, stop])
        border[edges[lo : hi + 1][edges[lo : hi + 1] <= stop] - at] = True
        border[0] = border[n] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        s = np.flatnonzero(inside & (~before | border[:n]))
        after = np.empty(n, bool)
        after[n - 1] = False
        after[:-1] = inside[1:]
        e = np.flatnonzero(inside & (~after | border[1:])) + 1
        begin = np.zeros(n, np.int64)
        begin[s] = s
        np.maximum.accumulate(begin, out=begin)
        hashes.append(_sum_hashes(part, s, e, begin))
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    if not starts:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    s = np.concatenate(starts)
    return Words(s, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(s, offsets))


def _sum_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hashes of words: begin tells each byte where its word begins."""
    each = (np.arange(len(data)) - begin).astype(np.uint64)
    each *= np.uint64(0x9E3779B97F4A7C15)
    each += _VALUES[data]
    each ^= each >> np.uint64(32)
    each *= np.uint64(0xD6E8FEB86659FD93)
    each ^= each >> np.uint64(29)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(each, out=sums[1:])
    return mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def array_hashes(words: pa.Array) -> np.ndarray:
    """The hashes of whole strings (large_string), as words_of gives them to words."""
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    return _sum_hashes(data, starts, ends, np.repeat(starts, ends - starts))


def distinct_words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of consecutive texts: where each one's words begin (and the end of the last), each word's place in the distinct words, and these.

    Words are compared as they are, by Arrow.
    """
    inside = word[data]
    n = len(inside)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | border[:n]))
    sizes = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    # the words one after the other, without what lies between
    ends = np.concatenate([sizes[starts], sizes[-1:]])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
    coded = words.dictionary_encode()
    return np.searchsorted(starts, offsets), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def text_groups(column: pa.Array, size: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of groups of rows with about `size` bytes of text; null is empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count or column.type != pa.large_string() else column
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, len(column))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles (all words as one where there are fewer), and where each text's begin."""
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(counts)])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    at = np.repeat(first[:-1] - begin[:-1], counts) + np.arange(begin[-1])
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    short = np.repeat(n < k, counts)
    out = np.zeros(begin[-1], np.uint64)
    length = np.repeat(np.minimum(n, k), counts)
    for j in range(k):
        term = padded[at + j]
        if short.any():
            term = np.where(j < length, term, np.uint64(0))
        out = mix(out + term + np.uint64(0x9E3779B97F4A7C15))
    return mix(out + length.astype(np.uint64)), begin
