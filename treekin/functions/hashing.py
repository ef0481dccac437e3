"""Polynomial hashes and winnowing, in NumPy over Arrow batches.

The hash is h -> (h * 1000003 + x) mod (2^61 - 1).  The product needs more than 64 bits; as the modulus is a Mersenne prime, the
halves of h are multiplied on their own and put together without an overflow.  A batch's distinct tokens are hashed once, and all
its sequences are handled at once: k-grams by k steps over all positions, windows by a minimum over shifted views.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

LONGS = ArrayType(LongType())

# Fixed values of the hash.
BASE = 1_000_003
MODULUS = (1 << 61) - 1

_U = np.uint64
_LOW31, _LOW30 = _U((1 << 31) - 1), _U((1 << 30) - 1)
#: Elements of the lists that are handled together; a longer list is handled alone.
TOGETHER = 1 << 17
#: Characters of a token that are hashed for all tokens together; what is left of longer ones follows one by one.
_TOGETHER = 64


def _step(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(h * BASE + x) mod MODULUS for h, x < MODULUS."""
    high = (h >> _U(31)) * _U(BASE)
    return ((high >> _U(30)) + ((high & _LOW30) << _U(31)) + (h & _LOW31) * _U(BASE) + x) % _U(MODULUS)


def hashes_of(values: pa.Array) -> np.ndarray:
    """Of strings: a hash over the code points of each; null and empty have 0."""
    if not len(values):
        return np.zeros(0, _U)
    coded = values.cast(pa.large_string()).fill_null("").dictionary_encode()
    words = coded.dictionary.to_pylist()
    by = sorted(range(len(words)), key=lambda i: -len(words[i]))
    sizes = np.array([len(words[i]) for i in by])
    points = np.frombuffer("".join(words[i][:_TOGETHER] for i in by).encode("utf-32-le", "surrogatepass"), "<u4").astype(_U)
    starts = np.concatenate([[0], np.cumsum(np.minimum(sizes, _TOGETHER))])
    h = np.zeros(len(by), _U)
    for j in range(min(_TOGETHER, int(sizes[0]))):
        n = int(np.searchsorted(-sizes, -j, "left"))  # tokens of more than j characters
        h[:n] = _step(h[:n], points[starts[:n] + j])
    for k in range(int(np.searchsorted(-sizes, -_TOGETHER, "left"))):
        x = int(h[k])
        for c in words[by[k]][_TOGETHER:]:
            x = (x * BASE + ord(c)) % MODULUS
        h[k] = x
    out = np.empty(len(by), _U)
    out[by] = h
    return out[coded.indices.to_numpy()]


def _ragged(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of all lists one after the other, and where each list begins; null is an empty list."""
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _spread(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of elements: the places at which `width` of them begin, the first one where there are fewer, and each run's share."""
    n = np.diff(first)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(counts)])
    return np.repeat(first[:-1] - begin[:-1], counts) + np.arange(begin[-1]), begin


def grams_of(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    at, begin = _spread(first, k)
    if not len(at):
        return np.zeros(0, _U), begin
    out, stop = hashes[at], np.repeat(first[1:], np.diff(begin))
    for j in range(1, k):
        more = at + j < stop
        out = np.where(more, _step(out, hashes[np.minimum(at + j, len(hashes) - 1)]), out)
    return out, begin


def minima_of(grams: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct minima of all windows of each run, in ascending order."""
    at, begin = _spread(first, window)
    run = np.repeat(np.arange(len(first) - 1), np.diff(begin))
    if not len(at):
        return np.zeros(0, _U), begin
    out, last = grams[at], first[1:][run] - 1
    for j in range(1, window):
        out = np.minimum(out, grams[np.minimum(at + j, last)])
    new = np.concatenate([[True], (out[1:] != out[:-1]) | (run[1:] != run[:-1])])  # neighbours often share their minimum
    out, run = out[new], run[new]
    order = np.lexsort((out, run))
    out, run = out[order], run[order]
    new = np.concatenate([[True], (out[1:] != out[:-1]) | (run[1:] != run[:-1])])
    return out[new], np.searchsorted(run[new], np.arange(len(first)))


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.astype(np.int64)))


def _longs(values: pa.Array) -> np.ndarray:
    return values.cast(pa.int64()).to_numpy(zero_copy_only=False).astype(np.int64).view(_U)


def _in_parts(run: Callable[[pa.Array], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """run over parts of a column of lists, of TOGETHER elements each or one list: what it needs for each element does not grow with the batch."""

    def whole(column: pa.Array) -> pa.Array:
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        out, i = [], 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(first, first[i] + TOGETHER, "right")) - 1)
            out.append(run(column[i:j]))
            i = j
        return pa.concat_arrays(out) if out else run(column)

    return whole


def _positive(**sizes: int) -> None:
    for name, value in sizes.items():
        if value < 1:
            raise ValueError(f"{name} must be at least 1")


@F.arrow_udf(LongType())
def token_hash(token: pa.Array) -> pa.Array:
    """Over the code points of a token; an empty one has 0, null none."""
    return pa.array(hashes_of(token).astype(np.int64), mask=token.is_null().to_numpy(zero_copy_only=False))


def _token_hashes(tokens: pa.Array) -> pa.Array:
    values, first = _ragged(tokens)
    return _lists(hashes_of(values), first)


token_hashes = F.arrow_udf(_in_parts(_token_hashes), LONGS)


def kgram_hashes(hashes: Column, k: int) -> Column:
    """hashes: token hashes in order.  Of each k tokens in a row; of all, where there are fewer; none of none."""
    _positive(k=k)

    def run(column: pa.Array) -> pa.Array:
        values, first = _ragged(column)
        return _lists(*grams_of(_longs(values), first, k))

    return F.arrow_udf(_in_parts(run), LONGS)(hashes)


def winnow(grams: Column, window: int) -> Column:
    """The distinct minima of all windows of that many k-gram hashes; the minimum of all, where there are fewer.  Sorted."""
    _positive(window=window)

    def run(column: pa.Array) -> pa.Array:
        values, first = _ragged(column)
        return _lists(*minima_of(_longs(values), first, window))

    return F.arrow_udf(_in_parts(run), LONGS)(grams)


def winnower(k: int = 5, window: int = 4):
    """The function of fingerprints(), for columns and SQL names."""
    _positive(k=k, window=window)

    def run(tokens: pa.Array) -> pa.Array:
        values, first = _ragged(tokens)
        return _lists(*minima_of(*grams_of(hashes_of(values), first, k), window))

    return F.arrow_udf(_in_parts(run), LONGS)


def fingerprints(tokens: Column, k: int = 5, window: int = 4) -> Column:
    """Winnowing fingerprints of a token sequence, as a sorted array; null has none."""
    return winnower(k, window)(tokens)


def fingerprint_count(prints: Column) -> Column:
    return F.coalesce(F.size(prints), F.lit(0))


def signature(node: Column) -> Column:
    """label, or label:value, of a tree node."""
    return F.concat_ws(":", node["label"], node["value"])


def token_stream(ast: Column) -> Column:
    """Signatures in preorder."""
    return F.transform(ast, signature)
