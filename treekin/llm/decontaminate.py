"""Operator 6: benchmark decontamination by a BM25 index of the test items.

Method.  The test items, cut into segments of at most ``SEGMENT_WORDS`` words, make an inverted index; a posting's impact is its
BM25 weight divided by the segment's score against itself, so one threshold serves segments of all lengths.  Every passage
of every document (windows of twice that length, half overlapping, so that each segment lies within one) is a query, and is
answered by block-max WAND:

* each term of the passage has a cursor on its list of segments.  With the cursors sorted by segment, the pivot is the first
  one at which the lists' greatest impacts add up to the threshold; no segment before it can reach it;
* lists are held in blocks of ``BLOCK`` postings with the greatest impact and the last segment of each.  If the blocks around the
  pivot cannot reach the threshold together, the cursors go on to the first segment after the nearest end of these blocks;
* else, once all cursors before the pivot stand on it, the segment is scored in full.  What reaches the threshold is retrieved.

Segments are numbered by length and cut into ranges, ``RANGES`` at most, so that impacts are alike in a range.  A passage is searched in
those ranges only where its lists' greatest impacts add up to the threshold.  Many passages are answered in step: a cursor is a cell of a
NumPy array with a row for each passage and range, and rows leave as they finish.

A retrieved item is verified on the whole document: of the question's five-word shingles, and of those of the answer (the last
line, where an item has several), at least ``overlap`` must occur in it.  A question or an answer of under five words is one
shingle of that length, and is compared with the document's runs of as many words.

The index is a broadcast.  Its size is checked: items are dealt into shards of at most ``SHARD_CHARS`` characters, and the
documents are read once for each shard.  Frequencies and lengths are those of all items in every shard, so scores do not depend on
the number of shards.

Edge cases.  Null or empty text, of documents or items, matches nothing.  Items of under five words count as one shingle, and
so are found wherever their words stand one after the other.
Equal items are reported each; repeated documents too.  An empty table on either side gives an empty result.  Other columns
are ignored by ``contaminated`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treekin.llm.wordhash import ALNUM, shingle_hashes, text_groups, words_of
from treekin.shared import small_batches, table

SEGMENT_WORDS = 64
STRIDE = SEGMENT_WORDS
BLOCK, RANGES = 8, 64
#: Cells of the arrays in which passages are answered in step, and what sums of impacts may be off by.
CELLS, SLACK = 1 << 16, 1e-9
SHARD_CHARS = 8_000_000
SHINGLE = 5
K1, B = 1.2, 0.75


def _words(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for i, j, data, offsets in text_groups(pa.array(texts, pa.large_string())):
        w = words_of(data, offsets, ALNUM, lower=True)
        out += [w.hashes[w.first[x] : w.first[x + 1]] for x in range(j - i)]
    return out


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(words, np.array([0, len(words)]), k)[0])


def _part(words: np.ndarray) -> tuple[int, np.ndarray]:
    """The length of a part's shingles, under SHINGLE where the part is shorter, and the shingles."""
    k = max(1, min(SHINGLE, len(words)))
    return k, _shingles(words, k)


def _segments(items: list[tuple[int, str]]) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
    """Words of each item, the segments, and the item of each segment."""
    words, segments, owner = _words([t for _, t in items]), [], []
    for k, w in enumerate(words):
        cuts = np.linspace(0, len(w), -(-len(w) // SEGMENT_WORDS) + 1).astype(int)
        for a, b in zip(cuts, cuts[1:], strict=False):
            segments.append(w[a:b])
            owner.append(k)
    return words, segments, owner


@dataclass
class Statistics:
    """Of all segments, of whatever shard: their number and words, and the terms in ascending order with the segments of each."""

    n: int = 0
    words: int = 0
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    df: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def add(self, segments: list[np.ndarray]) -> Statistics:
        if not segments:
            return self
        mine, df = np.unique(np.concatenate([np.unique(s) for s in segments]), return_counts=True)
        terms, at = np.unique(np.concatenate([self.terms, mine]), return_inverse=True)
        return Statistics(self.n + len(segments), self.words + sum(map(len, segments)), terms, np.bincount(at, np.concatenate([self.df, df]), len(terms)).astype(np.int64))


class Index:
    """Postings of segments, ordered by term and segment, with the maxima and the ends of their blocks."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, overlap: float, of: Statistics | None = None):
        self.threshold, self.overlap, self.ids = threshold, overlap, [name for name, _ in items]
        words, segments, owner = _segments(items)
        of = Statistics().add(segments) if of is None else of
        self.parts: list[tuple[tuple[int, np.ndarray], tuple[int, np.ndarray]]] = []
        for (_, text), w in zip(items, words, strict=True):
            lines = [x for x in text.split("\n") if x.strip()] if len(w) else [""]
            question, answer = _words(["\n".join(lines[:-1] if len(lines) > 1 else lines), lines[-1] if len(lines) > 1 else ""])
            self.parts.append((_part(question), _part(answer)))
        by = sorted(range(len(segments)), key=lambda i: len(segments[i]))
        segments, self.owner, n = [segments[i] for i in by], np.array([owner[i] for i in by], np.int64), len(segments)
        if not n:
            self.terms = np.zeros(0, np.uint64)
            return
        term = np.concatenate(segments)
        seg = np.repeat(np.arange(n), [len(s) for s in segments])
        self.terms, at = np.unique(term, return_inverse=True)
        self.posting, tf = np.unique(at * n + seg, return_counts=True)  # term * segments + segment
        t, self.segment = self.posting // n, self.posting % n
        df = of.df[np.searchsorted(of.terms, self.terms)]
        size = np.array([len(x) for x in segments], float)
        idf = np.log(1 + (of.n - df + 0.5) / (df + 0.5))
        self.impact = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.segment] / (of.words / of.n)))
        self.impact /= np.bincount(self.segment, self.impact, n)[self.segment]
        self.begin = np.searchsorted(t, np.arange(len(self.terms) + 1))
        # stretches of a list: its postings in one range of segments, and the greatest impact there
        self.ranges = min(RANGES, -(-n // BLOCK))
        key = t * self.ranges + self.segment * self.ranges // n
        self.stretch = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
        self.stretch_range = key[self.stretch[:-1]] % self.ranges
        self.stretch_top = np.maximum.reduceat(self.impact, self.stretch[:-1])
        self.first_stretch = np.searchsorted(key[self.stretch[:-1]], np.arange(len(self.terms) + 1) * self.ranges)
        # blocks: BLOCK postings of one list each
        inside = np.arange(len(t)) - self.begin[t]
        first = np.flatnonzero(inside % BLOCK == 0)
        self.block = np.cumsum(inside % BLOCK == 0) - 1
        self.block_top = np.maximum.reduceat(self.impact, first)
        self.block_end = self.segment[np.append(first[1:], len(t)) - 1]

    def __len__(self):
        return len(self.owner)

    def retrieve(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float]]:
        """(text, item, score) of every item with a segment that some passage of the text reaches; the best score of each."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        place = np.flatnonzero(self.terms[at] == hashes)
        at = at[place]
        text = np.searchsorted(first, place, "right") - 1
        inside = place - first[text]
        windows = np.maximum(1, -(-(np.diff(first) - STRIDE) // STRIDE))  # of STRIDE * 2 words, each STRIDE on
        base = np.concatenate([[0], np.cumsum(windows)])
        own = inside // STRIDE
        passage = np.concatenate([base[text] + np.minimum(own, windows[text] - 1), base[text] + own - 1])
        ok = np.concatenate([np.ones(len(own), bool), (own > 0) & (own < windows[text])])
        key = np.unique(passage[ok] * len(self.terms) + np.concatenate([at, at])[ok])
        passage, term = key // len(self.terms), key % len(self.terms)
        # a row for each passage and range whose lists can reach the threshold there, a cell for each list
        many = self.first_stretch[term + 1] - self.first_stretch[term]
        cell = np.repeat(self.first_stretch[term] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(many) else many
        row = np.repeat(passage, many) * self.ranges + self.stretch_range[cell]
        live = np.bincount(row, self.stretch_top[cell], base[-1] * self.ranges) >= self.threshold - SLACK
        cell, row = cell[live[row]], row[live[row]]
        best: dict[tuple[int, int], float] = {}
        if len(row):
            order = np.argsort(row, kind="stable")
            cell, row = cell[order], row[order]
            begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            counts = np.diff(np.append(begin, len(row)))
            by = np.argsort(counts, kind="stable")
            at = 0
            while at < len(by):  # rows with about as many cells share an array of about CELLS cells
                some = by[at : at + max(1, CELLS // int(counts[by[at]]))]
                at += len(some)
                width = int(counts[some[-1]])
                cells = np.where(np.arange(width) < counts[some][:, None], cell[np.minimum(begin[some][:, None] + np.arange(width), len(cell) - 1)], -1)
                for r, segment, score in zip(*self._wand(cells), strict=True):
                    k = (int(np.searchsorted(base, row[begin[some[r]]] // self.ranges, "right")) - 1, int(self.owner[segment]))
                    best[k] = max(score, best.get(k, 0.0))
        return [(t, i, v) for (t, i), v in sorted(best.items())]

    def _wand(self, cells: np.ndarray) -> tuple[list[int], list[int], list[float]]:
        """cells: a row of stretches of one range for each passage, -1 where it has fewer.  (row, segment, score) of all that reach the
        threshold."""
        n, least = len(self.owner), self.threshold - SLACK
        row = np.arange(len(cells))
        none = cells < 0
        at, end = np.where(none, 0, self.stretch[cells]), np.where(none, 0, self.stretch[cells + 1])
        lists = self.posting[at] - self.segment[at]
        top = np.where(none, 0.0, self.stretch_top[cells])
        now = np.where(none, n, self.segment[at])
        out: tuple[list, list, list] = ([], [], [])
        while len(row):
            order = np.argsort(now, axis=1)
            sorted_ = np.take_along_axis(now, order, 1)
            reach = np.cumsum(np.where(sorted_ < n, np.take_along_axis(top, order, 1), 0.0), axis=1) >= least
            go = reach[:, -1]
            if not go.all():
                row, lists, at, end, now, top, sorted_, reach = (x[go] for x in (row, lists, at, end, now, top, sorted_, reach))
                if not len(row):
                    break
            pivot = np.take_along_axis(sorted_, reach.argmax(1)[:, None], 1)
            on = now == pivot
            # where the lists up to the pivot would stand on or after it, and their blocks there
            there = at.copy()
            r, c = np.nonzero(now < pivot)
            there[r, c] = np.searchsorted(self.posting, lists[r, c] + pivot[r, 0])
            r, c = np.nonzero((now <= pivot) & (there < end))
            block = self.block[there[r, c]]
            fits = (np.bincount(r, self.block_top[block], len(row)) >= least)[:, None]
            ends = np.full(len(row), n)
            np.minimum.at(ends, r, self.block_end[block] + 1)
            full = fits & (sorted_[:, :1] == pivot)
            r, c = np.nonzero(on & full)
            if len(r):
                score = np.bincount(r, self.impact[at[r, c]], len(row))
                good = np.flatnonzero(score >= self.threshold)
                out[0].extend(row[good].tolist())
                out[1].extend(pivot[good, 0].tolist())
                out[2].extend(score[good].tolist())
            # the next segment that can matter: the pivot for cursors before it, the one after a scored pivot, or the one after the blocks
            beyond = np.where(now > pivot, now, n).min(1)
            target = np.where(full, pivot + 1, np.where(fits, pivot, np.maximum(np.minimum(ends, beyond)[:, None], pivot + 1)))
            r, c = np.nonzero(now < target)
            at[r, c] = np.searchsorted(self.posting, lists[r, c] + target[r, 0])
            now[r, c] = np.where(at[r, c] < end[r, c], self.segment[np.minimum(at[r, c], len(self.segment) - 1)], n)
        return out

    def verify(self, words: np.ndarray, item: int) -> tuple[float, float]:
        """Shares of the question's and the answer's shingles in the text; an item without an answer has it in full."""
        (k, question), (m, answer) = self.parts[item]
        mine = {length: _shingles(words, length) for length in {k, m}}
        share = lambda x, length: float(np.isin(x, mine[length]).mean()) if len(x) else 1.0
        return share(question, k), share(answer, m)

    def find(self, texts: pa.Array):
        """(row, item id, score, question share, answer share) of verified items."""
        for i, _, data, offsets in text_groups(texts, 2 << 20):
            w = words_of(data, offsets, ALNUM, lower=True)
            if not len(self) or not len(w.hashes):
                continue
            for t, item, score in self.retrieve(w.hashes, w.first):
                q, a = self.verify(w.hashes[w.first[t] : w.first[t + 1]], item)
                if q >= self.overlap and a >= self.overlap:
                    yield i + t, self.ids[item], score, q, a


def indexes(items: DataFrame, threshold: float, overlap: float, shard_chars: int = SHARD_CHARS):
    """Broadcast indexes of (item_id, text), each of about shard_chars characters at most."""
    spark = items.sparkSession
    small_batches(spark)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, math.ceil(chars / shard_chars)) if chars else 0

    def shard(k: int) -> list[tuple[int, str]]:
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).orderBy("item_id", "text")
        return [(r[0], r[1]) for r in part.collect()]

    of = None
    if shards > 1:
        of = Statistics()
        for k in range(shards):
            of = of.add(_segments(shard(k))[1])
    for k in range(shards):
        yield spark.sparkContext.broadcast(Index(shard(k), threshold, overlap, of))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every item found in a document."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(items, threshold, overlap):

        def run(batches, index=index):
            for batch in batches:
                found = list(index.value.find(batch.column(1)))
                if found:
                    ids = batch.column(0)
                    yield pa.record_batch(
                        [ids.take(pa.array([x[0] for x in found])), *(pa.array([x[k] for x in found], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64())))],
                        ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                    )

        out = out.union(rows.mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """The documents in which no item is found, with the columns they had; no shuffle."""
    at = docs.columns.index(text_col)
    for index in indexes(items, threshold, overlap):

        def run(batches, index=index):
            for batch in batches:
                bad = {x[0] for x in index.value.find(batch.column(at))}
                keep = np.ones(batch.num_rows, bool)
                keep[list(bad)] = False
                yield batch.filter(pa.array(keep))

        # by place, as names may hold dots
        names = docs.columns
        plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
        docs = plain.mapInArrow(run, plain.schema).toDF(*names)
    return docs


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
