"""Phrase collocation mining (operator 11): phrases of two and three words whose parts rarely stand without each other.

Method.  Phrases that occur ``least`` times are found level by level, as every part of such a phrase occurs as often (Apriori).  For words, then
pairs, then triples, each batch of texts gives the hashes of the phrases whose parts may be frequent, with their counts; the hashes are
dealt into shards, and a shard keeps those with a count that is high enough.  Equal hashes of different phrases can only raise a count, so no
phrase is lost.  What the next level asks is a bitmap of the hashes, of ``MOST_BITS`` bits at most: where it is too small for the data
it lets more through, never less.

The candidates with the highest counts, ``SLOTS`` of them at most, get a minimal perfect hash.  In a last pass each task counts its
texts' candidates into a NumPy array with one place for each slot (bincount) and keeps the phrase that a slot stands for; words are compared with it
as they are, so a phrase that has another one's hash is told apart.  The tasks' arrays are added up in a tree.  Phrases beyond the
slots, or in another one's slot, are counted by name with groupBy, which is the exact way for the rest at any size.  Cuts are then
read by slot from the summed array; those that have none of their own by a join.

Memory.  Tasks hold a batch of texts, the bitmaps, 22 bytes or so for each slot and ``HELD_BYTES`` of phrases: with more of them they write what they
have counted and begin anew.  Phrases are named ``NAMED`` at a time, and a row that is written has ``ROW_BYTES`` of them or so; such rows are
read ``ROWS`` at a time.  Shards grow in number with the text, not in size.

Edge cases.  Null text is empty; a null language is ``und``.  Languages are kept apart and may be any strings.  Words are bytes
outside the delimiters, so NUL and other control characters are part of words.  Repeated rows count as often as they occur.  Phrases
of equal score and count are ordered by their UTF-8 bytes.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treekin.llm.wordhash import _LOWER, _table, mix, text_groups, words_of
from treekin.shared import drop_stage, setting, small_batches, spread, stage, table

LEAST, TOP = 10, 2000
#: Candidates that tasks count in arrays; slots of one piece of an array.
SLOTS, PIECE = 1 << 22, 1 << 16
#: Bits of a level's map, and bytes of text for one shard and for one batch.
MOST_BITS, SHARD_BYTES, BATCH_BYTES = 1 << 28, 16 << 20, 8 << 20
#: Parts of a batch that are read one after another: what is made of a text is many times its size.
PARTS = 4
#: Bytes of the phrases of slots that a task holds before it writes its counts and begins anew.
HELD_BYTES = 32 << 20
#: Phrases of a batch that are named at once, bytes of phrases in a row of ARRAYS, and rows that are read at once where rows are long.
NAMED, ROW_BYTES, ROWS = 1 << 17, 1 << 19, 16
_PIECES = ".,;:!?\n\x0b\x0c\r"
_WORD = _table(" \t" + _PIECES)
_BREAK = ~_table(_PIECES)


# --- texts as words


def _lang_hashes(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)


@dataclass
class Texts:
    """Words of consecutive texts: hashes that differ between languages, whether the next word follows in the same piece, and what words are."""

    hashes: np.ndarray
    follows: np.ndarray
    lang: np.ndarray  # of each word, a number into langs
    langs: list[str]
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def pairs(self) -> np.ndarray:
        return mix(mix(self.hashes[:-1] + np.uint64(0x632BE59BD9B4E019)) + self.hashes[1:])

    def triples(self) -> np.ndarray:
        return mix(mix(mix(self.hashes[:-2] + np.uint64(0xC2B2AE3D27D4EB4F)) + self.hashes[1:-1]) + self.hashes[2:])

    def dictionary(self) -> tuple[np.ndarray, pa.Array]:
        """Of each word its place in the distinct words, and these."""
        inside = _WORD[self.data]
        sizes = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        words = pa.Array.from_buffers(pa.large_string(), len(self.starts), [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(_LOWER[self.data[inside]])])
        coded = words.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _texts(data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, langs: list[str]) -> Texts:
    w = words_of(data, offsets, _WORD, lower=True)
    of = np.repeat(lang, np.diff(w.first))
    text = np.repeat(np.arange(len(lang)), np.diff(w.first))
    breaks = np.cumsum(_BREAK[data], dtype=np.int32)
    follows = (breaks[w.starts[1:]] == breaks[w.ends[:-1] - 1]) & (text[1:] == text[:-1]) if len(of) else np.zeros(0, bool)
    return Texts(mix(w.hashes ^ _lang_hashes(langs)[of]) if len(of) else w.hashes, follows, of, langs, data, w.starts, w.ends)


def _read(batches, most: int) -> Iterator[Texts]:
    """Batches (lang, text), put together to `most` bytes of text or so."""

    def made(rows: pa.Table) -> Iterator[Texts]:
        coded = rows.column(0).combine_chunks().cast(pa.string()).dictionary_encode()
        lang, langs = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        for i, j, data, offsets in text_groups(rows.column(1).combine_chunks().cast(pa.large_string()), most):
            yield _texts(data, offsets, lang[i:j], langs)

    held, size = [], 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size += batch.nbytes
        if size >= most:
            yield from made(pa.concat_tables(held))
            held, size = [], 0
    if held:
        yield from made(pa.concat_tables(held))


# --- candidates


@dataclass
class Bits:
    """A map of hashes: their low bits are places."""

    bits: int  # as a power of two
    data: np.ndarray

    @staticmethod
    def of(bits: int, pieces: list[bytes | None]) -> Bits:
        size = (1 << bits) // 8 // len(pieces)
        data = np.zeros(size * len(pieces), np.uint8)
        for k, piece in enumerate(pieces):
            if piece is not None:
                data[k * size : (k + 1) * size] = np.frombuffer(zlib.decompress(piece), np.uint8)
        return Bits(bits, data)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64((1 << self.bits) - 1)
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _level(t: Texts, maps: list[Bits]) -> np.ndarray:
    """Hashes of the phrases of one level, of len(maps) + 1 words, whose parts may be frequent."""
    if not maps:
        return t.hashes
    good = maps[0].has(t.hashes)
    pair = t.follows & good[:-1] & good[1:] if len(good) else t.follows
    if len(maps) == 1:
        return t.pairs()[pair]
    if len(maps[1:]) and len(pair):
        pair[pair] = maps[1].has(t.pairs()[pair])
    return t.triples()[pair[:-1] & pair[1:]] if len(pair) > 1 else np.zeros(0, np.uint64)


def _emit(maps, shards: int, bits: int, most: int):
    """Of texts: (shard, lang, n, hashes, counts) for each batch and shard, and for the first level the words of each language."""
    shift = np.uint64(bits - (shards.bit_length() - 1))

    def run(batches):
        known = [Bits.of(bits, x) for x in maps.value]

        def row(shard, lang=None, n=None, hashes=None, counts=None):
            return (shard, lang, n, hashes, counts)

        def made(words: dict[str, int], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            out = [row(-1, lang, n) for lang, n in words.items()]
            hashes, counts = np.unique(np.concatenate(parts), return_counts=True)
            shard = ((hashes & np.uint64((1 << bits) - 1)) >> shift).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            hashes, counts, shard = hashes[order], np.minimum(counts[order], 65535).astype(np.uint16), shard[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]) if len(shard) else np.zeros(1, np.int64)
            out += [row(int(shard[a]), None, None, hashes[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "lang", "n", "hashes", "counts"])

        words, parts, size = Counter(), [], 0
        for t in _read(batches, most // PARTS):
            if not known:
                words.update({t.langs[k]: int(n) for k, n in enumerate(np.bincount(t.lang, minlength=len(t.langs))) if n})
            parts.append(_level(t, known))
            size += len(t.data)
            if size >= most:
                yield from made(words, parts)
                words, parts, size = Counter(), [], 0
        if parts:
            yield from made(words, parts)

    return run


def _frequent(least: int, shards: int, bits: int):
    """Of rows (shard, hashes, counts), sorted: (shard, hashes, counts, map) of the hashes with `least` occurrences."""
    places = 1 << (bits - (shards.bit_length() - 1))

    def summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        h, n = np.concatenate(hashes), np.concatenate(counts)
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        return h[first], np.add.reduceat(n[order], first) if len(h) else n

    def run(batches):
        shard, held, counts, size, limit = None, [], [], 0, 1 << 20

        def done():
            h, n = summed(held, counts)
            h, n = h[n >= least], n[n >= least]
            flags = np.zeros(max(8, places), np.uint8)
            flags[(h & np.uint64(places - 1)).astype(np.int64)] = 1
            packed = zlib.compress(np.packbits(flags, bitorder="little").tobytes(), 1)
            return pa.record_batch([pa.array([shard], pa.int32()), pa.array([h.tobytes()]), pa.array([n.tobytes()]), pa.array([packed])], ["shard", "hashes", "counts", "map"])

        for batch in batches:
            for s, h, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if s != shard:
                    if shard is not None:
                        yield done()
                    shard, held, counts, size, limit = s, [], [], 0, 1 << 20
                held.append(np.frombuffer(h.as_buffer(), np.uint64))
                counts.append(np.frombuffer(n.as_buffer(), np.uint16).astype(np.int64))
                size += len(held[-1])
                if size > limit:
                    h, n = summed(held, counts)
                    held, counts, size, limit = [h], [n], len(h), max(1 << 20, 2 * len(h))
        if shard is not None:
            yield done()

    return run


def _map_of(found: DataFrame, shards: int) -> list[bytes | None]:
    """The level's map in pieces as shards have made them, compressed: a few bytes for each bit that is set."""
    out: list[bytes | None] = [None] * shards
    for r in found.select("shard", "map").toLocalIterator():
        out[r[0]] = bytes(r[1])
    return out


# --- the minimal perfect hash


class PerfectHash:
    """Distinct 64-bit keys to 0 .. n - 1 without gaps.  Each level has a bit array; keys that meet no other there get a bit, and the rest go on to the
    next level.  A key's number is the number of bits before its own: those in earlier words of 64, which are stored, and those in its word.  Keys
    are stored by number, so that others are known to be others."""

    def __init__(self, keys: np.ndarray, gamma: float = 2.0):
        left, self.sizes, flags = keys, [], []
        while len(left):
            if len(self.sizes) == 64:
                raise ValueError("the keys are not distinct")
            m = max(64, int(gamma * len(left)))
            at = self._at(left, len(self.sizes), m)
            alone = np.bincount(at, minlength=m) == 1
            self.sizes.append(m)
            flags.append(alone)
            left = left[~alone[at]]
        every = np.concatenate([*flags, np.zeros(-sum(self.sizes) % 64, bool)])
        self.words = np.packbits(every, bitorder="little").view(np.dtype("<u8")).astype(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1]]).astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.keys = np.zeros(len(keys), np.uint64)
        self.keys[self._number(keys)] = keys

    @staticmethod
    def _at(keys: np.ndarray, level: int, m: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(m)).astype(np.int64)

    def _number(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            at = self._at(keys[left], level, m) + self.starts[level]
            word, bit = self.words[at >> 6], np.uint64(1) << (at & 63).astype(np.uint64)
            hit = word & bit != 0
            out[left[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(word[hit] & (bit[hit] - np.uint64(1)))
            left = left[~hit]
            if not len(left):
                break
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of keys; -1 for a key that is none of those stored."""
        n = self._number(keys)
        known = n >= 0
        known[known] = self.keys[n[known]] == keys[known]
        return np.where(known, n, -1)


def _head(levels: list[DataFrame], slots: int) -> tuple[np.ndarray, bool]:
    """The hashes with the highest counts, `slots` of them at most: all whose count is in the same eighth of a power of two, or none; and whether
    these are all hashes."""

    def bins(n: np.ndarray) -> np.ndarray:
        return np.floor(8 * np.log2(n)).astype(np.int64)

    def spread_out(batches):
        for batch in batches:
            for n in batch.column(0):
                count = np.bincount(bins(np.frombuffer(n.as_buffer(), np.int64)))
                at = np.flatnonzero(count)
                yield pa.record_batch([pa.array(at), pa.array(count[at].astype(np.int64))], ["bin", "n"])

    def taken(least: int):
        def run(batches):
            for batch in batches:
                for h, n in zip(batch.column(0), batch.column(1), strict=True):
                    keep = bins(np.frombuffer(n.as_buffer(), np.int64)) >= least
                    yield pa.record_batch([pa.array([np.frombuffer(h.as_buffer(), np.uint64)[keep].tobytes()])], ["h"])

        return run

    every = levels[0].select("hashes", "counts")
    for df in levels[1:]:
        every = every.union(df.select("hashes", "counts"))
    sizes = dict(tuple(r) for r in every.select("counts").mapInArrow(spread_out, "bin long, n long").groupBy("bin").agg(F.sum("n")).collect())
    least, total = 1 << 20, 0
    for b in sorted(sizes, reverse=True):
        if total + sizes[b] > slots:
            break
        least, total = b, total + sizes[b]
    found = [np.frombuffer(r[0], np.uint64) for r in every.mapInArrow(taken(least), "h binary").toLocalIterator()]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64), total == sum(sizes.values())


# --- counts by slot

ARRAYS = "task long, piece int, counts binary, seen binary, names array<string>, other array<string>, n array<long>, slot array<int>"
_KINDS = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()))
_NAMES = [c.split(" ")[0] for c in ARRAYS.split(", ")]


class SlotCounts:
    """Counts by slot, and the phrase that each slot stands for."""

    def __init__(self, n: int):
        self.counts, self.where, self.held = np.zeros(n, np.int64), np.full(n, -1, np.int32), pa.array([], pa.large_string())

    def own(self, slots: np.ndarray, names: pa.Array) -> np.ndarray:
        """Whether each phrase is the one that its slot stands for; a free slot takes the first that comes."""
        first = np.zeros(len(slots), bool)
        first[np.unique(slots, return_index=True)[1]] = True
        new = first & (self.where[slots] < 0)
        if new.any():
            self.where[slots[new]] = len(self.held) + np.arange(int(new.sum()))
            self.held = pa.concat_arrays([self.held, names.filter(pa.array(new))])
        if not len(slots):
            return first
        return pc.equal(self.held.take(pa.array(self.where[slots])), names).to_numpy(zero_copy_only=False)

    def pieces(self, task: int, first: int, piece: int) -> Iterator[pa.RecordBatch]:
        """Rows of ARRAYS, one or more for each `piece` slots that have a phrase: the counts of these slots, as many rows as names ask for.
        first: the number of the first piece."""
        for k in range(0, len(self.counts), piece):
            where = self.where[k : k + piece]
            at = np.flatnonzero(where >= 0)
            names = self.held.take(pa.array(where[at]))
            for a, b in _spans(names):
                seen = np.zeros(len(where), bool)
                seen[at[a:b]] = True
                yield _batch((task, first + k // piece, self.counts[k + at[a:b]].tobytes(), np.packbits(seen).tobytes(), names[a:b], None, None, None))


def _spans(names: pa.Array) -> Iterator[tuple[int, int]]:
    """Consecutive names, of ROW_BYTES or so."""
    part = np.cumsum(pc.binary_length(names).to_numpy(zero_copy_only=False).astype(np.int64) + 16) // ROW_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(names)]
    return ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def _batch(row: tuple) -> pa.RecordBatch:
    """One row of ARRAYS."""

    def column(x, kind: pa.DataType) -> pa.Array:
        if x is None or not pa.types.is_list(kind):
            return pa.array([x], kind)
        return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x).cast(kind.value_type))

    return pa.record_batch([column(x, kind) for x, kind in zip(row, _KINDS, strict=True)], _NAMES)


def _others(task: int, names: pa.Array, n: np.ndarray, slots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ARRAYS of phrases that are counted by name."""
    for a, b in _spans(names):
        yield _batch((task, -1, None, None, None, names[a:b], n[a:b], slots[a:b]))


def _phrases(t: Texts, maps: list[Bits]) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """For one, two and three words: hashes, names and numbers of occurrences of the distinct phrases that may be frequent, NAMED at a time.

    Distinct means distinct words, whatever their hashes.  A name begins with the length and the name of the language.
    """
    if not len(t.hashes):
        return
    code, words = t.dictionary()
    prefix = pa.array([f"{len(x)}:{x}" for x in t.langs], pa.large_string())
    n = len(words) * len(t.langs)
    own = t.lang.astype(np.int64) * len(words) + code
    good = maps[0].has(t.hashes)
    pair = t.follows & good[:-1] & good[1:]
    pairs = t.pairs() if len(good) > 1 else np.zeros(0, np.uint64)
    if len(pair):
        pair[pair] = maps[1].has(pairs[pair])
    triple = pair[:-1] & pair[1:] if len(pair) > 1 else np.zeros(0, bool)
    triples = t.triples() if len(triple) else np.zeros(0, np.uint64)
    if len(triple):
        triple[triple] = maps[2].has(triples[triple])
    for size, flags, hashes in ((1, good, t.hashes), (2, pair, pairs), (3, triple, triples)):
        at = np.flatnonzero(flags)
        if not len(at):
            continue
        key = own[at]
        for k in range(1, size):
            key = (np.unique(key, return_inverse=True)[1] if k > 1 else key) * n + own[at + k]
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        every = at[first]
        del key, first
        for k in range(0, len(every), NAMED):
            at = every[k : k + NAMED]
            parts = [words.take(pa.array(code[at + i])) for i in range(size)]
            joined = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if size > 1 else parts[0]
            yield hashes[at], pc.binary_join_element_wise(prefix.take(pa.array(t.lang[at])), joined, pa.scalar("", pa.large_string())), counts[k : k + NAMED]


def _count(maps, table_of, bits: int, piece: int, most: int, complete: bool, held: int):
    """Of texts: rows of ARRAYS, the task's counts by slot and the phrases that have no slot of their own.

    complete: whether all candidates have slots, so that a phrase without one is none.  held: bytes of phrases after which counts are written.
    """

    def run(batches):
        from pyspark import TaskContext

        known, mph = [Bits.of(bits, x) for x in maps.value], table_of.value
        task, sums = TaskContext.get().partitionId(), SlotCounts(len(mph.keys))
        for t in _read(batches, most // PARTS):
            for hashes, names, counts in _phrases(t, known):
                slots = mph.slots(hashes)
                inside = slots >= 0
                mine = np.zeros(len(slots), bool)
                mine[inside] = sums.own(slots[inside], names.filter(pa.array(inside)))
                sums.counts[slots[mine]] += counts[mine]  # a batch's phrases are distinct, and so are the slots of their own
                rest = inside & ~mine if complete else ~mine
                if rest.any():
                    yield from _others(task, names.filter(pa.array(rest)), counts[rest], slots[rest])
                del slots, inside, mine, rest, names
            if sums.held.nbytes > held:
                yield from sums.pieces(task, 0, piece)
                sums = SlotCounts(len(mph.keys))
        yield from sums.pieces(task, 0, piece)

    return run


def _seen(bits) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))


def _add(size: int):
    """Of rows (task, piece, ...) of ARRAYS, sorted: one row for each (task, piece) of `size` slots, the sum.  One row is held at a time."""

    def run(batches):
        key, sums = None, None
        for batch in batches:
            tasks, pieces = batch.column("task").to_pylist(), batch.column("piece").to_pylist()
            for k, here in enumerate(zip(tasks, pieces, strict=True)):
                if here != key:
                    if key is not None:
                        yield from sums.pieces(*key, size)
                    key, sums = here, SlotCounts(size)
                slots, counts = _seen(batch.column("seen")[k].as_buffer()), np.frombuffer(batch.column("counts")[k].as_buffer(), np.int64)
                names = batch.column("names")[k].values.cast(pa.large_string())
                same = sums.own(slots, names)
                sums.counts[slots[same]] += counts[same]
                if not same.all():
                    yield from _others(key[0], names.filter(pa.array(~same)), counts[~same], slots[~same] + key[1] * size)
        if key is not None:
            yield from sums.pieces(*key, size)

    return run


def _tree_sum(arrays: DataFrame, tasks: int, piece: int) -> DataFrame:
    """The arrays of all tasks added up: groups of tasks first, as many as the root of their number, and then these."""
    for tasks in (max(4, math.isqrt(tasks)), 1):
        mine = arrays.where("piece >= 0").withColumn("task", F.col("task") % tasks).repartition("task", "piece").sortWithinPartitions("task", "piece").mapInArrow(_add(piece), ARRAYS)
        new = stage(mine.union(arrays.where("piece < 0")), "slot-arrays")
        drop_stage(arrays)
        arrays = new
    return arrays


def _named(batches):
    """Of rows of ARRAYS: (name, a), the phrases and their counts."""
    for batch in batches:
        for k in range(batch.num_rows):
            if batch.column("piece")[k].as_py() < 0:
                yield pa.record_batch([batch.column("other")[k].values, batch.column("n")[k].values], ["name", "a"])
            else:
                yield pa.record_batch([batch.column("names")[k].values, pa.array(np.frombuffer(batch.column("counts")[k].as_buffer(), np.int64))], ["name", "a"])


# --- cuts

CUTS = ("l1", "r1", "l2", "r2")


def _cuts(tables):
    """Of candidates (lang, phrase, words, a): with the counts of the parts of both cuts, null where a part has no slot of its own."""

    def run(batches):
        mph, counts, shared = tables.value
        for batch in batches:
            lang = batch.column("lang").cast(pa.string()).dictionary_encode()
            langs = lang.dictionary.to_pylist()
            out = {c: np.full(batch.num_rows, -1, np.int64) for c in CUTS}
            for i, j, data, offsets in text_groups(batch.column("phrase").cast(pa.large_string()), BATCH_BYTES):
                t = _texts(data, offsets, lang.indices.to_numpy(zero_copy_only=False)[i:j], langs)
                size = batch.column("words").to_numpy(zero_copy_only=False)[i:j]
                first = np.concatenate([[0], np.cumsum(size)[:-1]])

                def read(hashes):
                    slots = mph.slots(hashes)
                    ok = slots >= 0
                    ok[ok] = ~shared[slots[ok]]
                    return np.where(ok, counts[np.maximum(slots, 0)] if len(counts) else -1, -1)

                one, pairs = read(t.hashes), read(t.pairs()) if len(t.hashes) > 1 else np.zeros(0, np.int64)
                two, three = np.flatnonzero(size == 2), np.flatnonzero(size == 3)
                out["l1"][i + two], out["r1"][i + two] = one[first[two]], one[first[two] + 1]
                out["l1"][i + three], out["r1"][i + three] = one[first[three]], pairs[first[three] + 1]
                out["l2"][i + three], out["r2"][i + three] = pairs[first[three]], one[first[three] + 2]
            yield pa.record_batch([*batch.columns, *(pa.array(out[c], mask=out[c] < 0) for c in CUTS)], [*batch.schema.names, *CUTS])

    return run


def _parts(size: Column) -> dict[str, Column]:
    """The phrases that the cuts of a phrase leave, null where there is no such cut."""
    w = F.split("phrase", " ")
    two = lambda i: F.concat_ws(" ", w[i], w[i + 1])
    three = size == 3
    return {"l1": w[0], "r1": F.when(three, two(1)).otherwise(w[1]), "l2": F.when(three, two(0)), "r2": F.when(three, F.get(w, F.lit(2)))}


def _by_join(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows (lang, phrase, words, a) with the counts of their cuts, read by name."""
    part = F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), p.alias("part")) for c, p in _parts(F.col("words")).items()])).alias("x")
    asked = rows.select("lang", "phrase", "words", "a", part).select("lang", "phrase", "words", "a", "x.cut", "x.part").where("part IS NOT NULL")
    known = counts.select(F.col("lang").alias("lang"), F.col("phrase").alias("part"), F.col("a").alias("f"))
    found = asked.join(known, ["lang", "part"])
    return found.groupBy("lang", "phrase", "words", "a").agg(*[F.max(F.when(F.col("cut") == c, F.col("f"))).alias(c) for c in CUTS])


def _score(left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)) in decimals of 38 digits; exact for counts under 10^15."""
    d = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"(cast(1000000 as decimal(7,0)) * ({d('a')} * {d('a')})) div ({d(left)} * {d(right)})")


def scored(candidates: DataFrame) -> DataFrame:
    """candidates: (lang, phrase, words, a, l1, r1, l2, r2).  Adds l, r and score of the cut with the lowest one, the first of equal ones."""
    rows = candidates.withColumn("s1", _score("l1", "r1")).withColumn("s2", _score("l2", "r2"))
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    pick = lambda x, y: F.when(second, F.col(y)).otherwise(F.col(x))
    return rows.select("lang", "phrase", "words", "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score"))


def _loose(rows: DataFrame) -> DataFrame:
    """Without the pairs that a triple holds at least half of whose occurrences."""
    parts = _parts(F.col("words"))
    inside = rows.where("words = 3").select("lang", F.explode(F.array(parts["l2"], parts["r1"])).alias("phrase"), F.col("a").alias("longer"))
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return rows.join(most, ["lang", "phrase"], "left").where("words = 3 OR longer IS NULL OR 100 * longer < 50 * a").drop("longer")


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` of each language: of each part of its phrases first, so that no task sorts a language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = rows.withColumn("deal", F.pmod(F.hash("phrase"), F.lit(parts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "deal")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def phrase_collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, slots: int = SLOTS, lang_col: str = "lang", text_col: str = "text", piece: int = PIECE, most: int = BATCH_BYTES, held: int = HELD_BYTES) -> DataFrame:
    """Per language its best phrases: (lang, rank, phrase, a, l, r, n, score)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = spread(docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    shards = 1 << max(3, (size // SHARD_BYTES).bit_length())
    bits = max(shards.bit_length() + 5, min(MOST_BITS.bit_length() - 1, (4 * size + 1024).bit_length()))
    few = lambda: setting(spark, "spark.sql.parquet.columnarReaderBatchSize", str(ROWS))  # noqa: E731  # rows with long arrays
    maps, levels, totals = [], [], None
    for words in (1, 2, 3):
        made = rows.mapInArrow(_emit(spark.sparkContext.broadcast(list(maps)), shards, bits, most), "shard int, lang string, n long, hashes binary, counts binary")
        if words == 1:
            made = stage(made, "word-hashes")
            totals = stage(made.where("shard < 0").groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
        dealt = made.where("shard >= 0").select("shard", "hashes", "counts").repartition("shard").sortWithinPartitions("shard")
        found = stage(dealt.mapInArrow(_frequent(least, shards, bits), "shard int, hashes binary, counts binary, map binary"), "frequent-hashes")
        if words == 1:
            drop_stage(made)
        with few():
            maps.append(_map_of(found, shards))
        levels.append(found)
    with few():
        head, complete = _head(levels, slots)
    mph = PerfectHash(head)
    known = spark.sparkContext.broadcast(maps)
    arrays = stage(rows.mapInArrow(_count(known, spark.sparkContext.broadcast(mph), bits, piece, most, complete, held), ARRAYS), "slot-arrays")
    with few():
        arrays = _tree_sum(arrays, rows._jdf.queryExecution().toRdd().getNumPartitions(), piece)
    for df in levels:
        drop_stage(df)
    # the summed array, 8 bytes a slot, and the slots that more than one phrase fell on
    counts, shared = np.zeros(len(mph.keys), np.int64), np.zeros(len(mph.keys), bool)
    with few():
        for r in arrays.where("piece >= 0").select("piece", "counts", "seen").toLocalIterator():
            counts[_seen(r[2]) + r[0] * piece] = np.frombuffer(r[1], np.int64)
        for r in arrays.where("piece < 0").select(F.explode(F.filter("slot", lambda x: x >= 0)).alias("s")).distinct().toLocalIterator():
            shared[r[0]] = True
    names = arrays.mapInArrow(_named, "name string, a long").groupBy("name").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    at = F.instr("name", ":")
    length = F.substring_index("name", ":", 1).cast("int")
    named = names.select(F.substring("name", at + 1, length).alias("lang"), F.expr("substring(name, instr(name, ':') + 1 + cast(substring_index(name, ':', 1) as int))").alias("phrase"), "a")
    with few():
        named = stage(named.withColumn("words", F.size(F.split("phrase", " "))), "phrases")
    drop_stage(arrays)
    read = stage(named.where("words > 1").select("lang", "phrase", "words", "a").mapInArrow(_cuts(spark.sparkContext.broadcast((mph, counts, shared))), "lang string, phrase string, words int, a long, l1 long, r1 long, l2 long, r2 long"), "cuts")
    lacking = "l1 IS NULL OR r1 IS NULL OR (words = 3 AND (l2 IS NULL OR r2 IS NULL))"
    both = read.where(f"NOT ({lacking})").union(_by_join(read.where(lacking).select("lang", "phrase", "words", "a"), named).select(*read.columns))
    best = _best(_loose(scored(both)), top).join(totals, "lang")
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)::INT), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w)::INT - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w
), c AS (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang
), f AS (
  SELECT *, string_split(phrase, ' ') AS v FROM c WHERE f >= 10
), cuts AS (
  SELECT lang, k, phrase, f AS a, 1 AS cut, v[1] AS x, array_to_string(v[2:], ' ') AS y FROM f WHERE k > 1
  UNION ALL SELECT lang, k, phrase, f, 2, v[1] || ' ' || v[2], v[3] FROM f WHERE k = 3
), s AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, cut, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = cuts.x JOIN f r ON r.lang = cuts.lang AND r.phrase = cuts.y
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([x, y]) AS phrase FROM cuts WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT b.* FROM b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase AND b.k = 2 WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
