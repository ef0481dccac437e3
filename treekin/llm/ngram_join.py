"""Operator 1: n-gram Jaccard join by prefix trees.

Method.  A document's set is its distinct five-word shingles, as 64-bit hashes in one global order: shingles known to be
frequent come last, and within each half the hash decides.  Documents with a Jaccard similarity of ``percent`` or more
share a shingle among the first n - ceil(percent * n / 100) + 1 of each, so each document is dealt to the buckets of its
prefix shingles.  A bucket's sets are stored in a trie with compressed edges; each set traverses it, sharing partial
overlaps, and a subtree is left as soon as the overlap so far plus the remaining lengths cannot reach the bound.

Two passes over the buckets keep the work linear where groups of near copies are huge:

1. each document visits only the first bucket it shares with another one; the links found there give provisional
   components.  Where a shingle of more than ``BLOCK_DOCS`` rows still has several, one document of each goes on to a round among these, and so on
   as long as components grow together: the rows of a group of near copies fall ``ROUND_DOCS`` times with each round;
2. buckets that still hold several components are joined in full, block against block; pairs that are known to be in one
   component are skipped, since another link between them changes no component.  Before texts are dealt out, the prefixes
   (16 bits a shingle) tell which rows cannot have a partner in their block.

No bucket is capped.  A frequent bucket is dealt out by salt in pass 1 and by pairs of blocks in pass 2.  Which shingles are frequent is told by
counts within partitions, and by counts over all partitions of a sample of ``SAMPLE`` texts, so a group that is spread one copy a partition
is seen as well; this decides the order and the salts only, never a link.

With ``count_links`` pass 2 is run once more over all buckets without skipping any pair, and each document's links are counted.

Edge cases.  Null or empty text, or white space only: n_shingles 0, linked with nothing.  Fewer than five words: the whole
sequence is one shingle.  Rows that share a doc_id count as one node; each keeps its own n_shingles.  A null doc_id cannot
be named: its component is null and it links nothing.  Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treekin.llm.wordhash import SPACED, mix, shingle_hashes, text_groups, words_of
from treekin.operators.components import connected_components
from treekin.operators.prefilter import anti_join
from treekin.shared import drop_stage, small_batches, stage, table

#: Shingles of a partition that are counted at once (4 bytes each).
COUNTED = 4_000_000
#: At most so many shingles are held as frequent (12 bytes each, broadcast), and half as many come from one partition; the rest
#: of the order is by hash.  Which shingles are held changes the order and the time, never the links.
FREQUENT = 1 << 18
#: Texts in which shingles are counted over all partitions, and the least count that tells a frequent one.
SAMPLE, SEEN = 1 << 14, 4
#: A trie holds at most so many documents in pass 1, and about so many in each block of pass 2.
BLOCK_DOCS = 512
#: Components that meet in a group of a round.
ROUND_DOCS = 256
BLOCK_SHINGLES = 2_000_000
#: Buckets of more rows are not tested for possible partners; all their rows go on.
LARGE = 4096


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row."""
    for i, j, data, offsets in text_groups(column):
        words = words_of(data, offsets, SPACED, lower=True)
        h, begin = shingle_hashes(words.hashes, words.first, k)
        for r in range(i, j):
            yield r, np.unique(h[begin[r - i] : begin[r - i + 1]])


def _digest(s: np.ndarray) -> tuple[int, int]:
    a, b = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _describe(k: int):
    """Rows (doc_id, n, d1, d2, times): a document's set size and digest, then the partition's frequent shingles with
    doc_id null, d1 the upper 32 bits of the shingle and times its count among the partition's different sets."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        store, held, texts = np.empty(COUNTED, np.uint32), 0, 0
        frequent: dict[int, int] = {}

        def fold():
            nonlocal held
            part = store[:held]
            part.sort()  # in place
            begin = np.flatnonzero(np.concatenate([part[:1] == part[:1], part[1:] != part[:-1]])).astype(np.int32)
            c = np.diff(np.append(begin, np.int32(held)))
            for t, x in zip(part[begin[c > 1]].tolist(), c[c > 1].tolist(), strict=True):
                frequent[t] = frequent.get(t, 0) + x
            held = 0

        for batch in batches:
            n, d1, d2 = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for r, s in _sets(batch.column(1), k):
                n[r] = len(s)
                if len(s):
                    d1[r], d2[r] = _digest(s)
                    if (key := (int(d1[r]), int(d2[r]))) not in seen:
                        seen.add(key)
                        texts += 1
                        for k0 in range(0, len(s), COUNTED):
                            part = (s[k0 : k0 + COUNTED] >> np.uint64(32)).astype(np.uint32)
                            if held + len(part) > COUNTED:
                                fold()
                            store[held : held + len(part)] = part
                            held += len(part)
            yield pa.record_batch([batch.column(0), pa.array(n), pa.array(d1), pa.array(d2), pa.array(np.zeros(batch.num_rows, np.int64))], ["doc_id", "n", "d1", "d2", "times"])
        fold()
        least = max(2, texts // 4000)
        out = sorted(((t, x) for t, x in frequent.items() if x >= least), key=lambda y: (-y[1], y[0]))[: FREQUENT // 2]
        if out:
            t = np.array([x[0] for x in out], np.int64)
            z = np.zeros(len(t), np.int64)
            yield pa.record_batch([pa.nulls(len(t), pa.int64()), pa.array(z), pa.array(t), pa.array(z), pa.array(np.array([x[1] for x in out], np.int64))], ["doc_id", "n", "d1", "d2", "times"])

    return run


def _known(frequent: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each shingle its place among the frequent ones (by its upper 32 bits), and whether it is there."""
    high = (s >> np.uint64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(frequent, high), len(frequent) - 1)
    return at, frequent[at] == high


def _ordered(s: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """The set in the global order, and how many of it are not frequent."""
    if not len(frequent) or not len(s):
        return s, len(s)
    late = _known(frequent, s)[1]
    return np.concatenate([s[~late], s[late]]), int((~late).sum())


def _prefixes(k: int, percent: int, hot):
    """Rows (bucket, shingle, doc_id, n, pos): a bucket is a shingle, or a shingle and a salt where it is frequent.

    The column shingle is null where the bucket is the shingle itself.  Of equal sets, one is left out only after one of the
    same doc_id or a smaller one: rows come in any order, and the smallest doc_id stands for its class.
    """

    def run(batches):
        tokens, counts = hot.value
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for r, s in _sets(batch.column(1), k):
                if not len(s) or not known[r] or seen.get(key := _digest(s), ids[r] + 1) <= ids[r]:
                    continue
                seen[key] = int(ids[r])
                n = len(s)
                s, _ = _ordered(s, tokens)
                p = n - (-(-n * percent // 100)) + 1
                t = s[:p]
                bucket, salted = t, np.zeros(p, bool)
                if len(tokens):
                    at, there = _known(tokens, t)
                    salts = np.where(there, counts[at] // BLOCK_DOCS, 0).astype(np.uint64) + np.uint64(1)
                    salt = mix(np.full(p, ids[r], np.int64).view(np.uint64)) % salts
                    salted = salts > 1
                    bucket = np.where(salted, mix(t + salt), t)
                for c, x in zip(out, (bucket.view(np.int64), np.ma.array(t.view(np.int64), mask=~salted), np.full(p, ids[r], np.int64), np.full(p, n, np.int32), np.arange(p, dtype=np.int32)), strict=True):
                    c.append(x)
            if out[0]:
                shingle = np.ma.concatenate(out[1])
                columns = [pa.array(np.concatenate(c)) for c in (out[0], *out[2:])]
                columns.insert(1, pa.array(shingle.data, mask=np.ma.getmaskarray(shingle)))
                yield pa.record_batch(columns, ["bucket", "shingle", "doc_id", "n", "pos"])

    return run


def _partners(n: np.ndarray, pos: np.ndarray, label: np.ndarray | None, percent: int) -> np.ndarray:
    """Of the rows of one bucket: whether another row can be a partner, by size, position and label."""
    n, rest = n.astype(np.int64), (n - pos).astype(np.int64)
    out = np.zeros(len(n), bool)
    for i in range(0, len(n), 1024):
        a = slice(i, i + 1024)
        ok = (100 * np.minimum(n[a, None], n) >= percent * np.maximum(n[a, None], n)) & ((100 + percent) * np.minimum(rest[a, None], rest) >= percent * (n[a, None] + n))
        ok[np.arange(len(ok)), np.arange(i, i + len(ok))] = False
        if label is not None:
            ok &= label[a, None] != label
        out[a] = ok.any(1)
    return out


def _with_partners(percent: int):
    """Of rows sorted by bucket: those with a possible partner in it.

    A salted bucket (its shingle is given) is only a part of the rows of its shingle, and is passed on as it is; so is one of
    more than LARGE rows, whose test would be quadratic.
    """

    def keep(b: pa.Table) -> pa.Table:
        bucket, n, pos = (b.column(c).to_numpy() for c in ("bucket", "n", "pos"))
        label = b.column("label").to_numpy() if "label" in b.column_names else None
        salted = b.column("shingle").is_valid().to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        sizes = np.diff(np.concatenate([begin, [len(bucket)]]))
        ok = salted.copy()
        x = begin[(sizes == 2) & ~salted[begin]]
        near = 100 * np.minimum(n[x], n[x + 1]).astype(np.int64) >= percent * np.maximum(n[x], n[x + 1]).astype(np.int64)
        near &= (100 + percent) * np.minimum(n[x] - pos[x], n[x + 1] - pos[x + 1]).astype(np.int64) >= percent * (n[x].astype(np.int64) + n[x + 1])
        if label is not None:
            near &= label[x] != label[x + 1]
        ok[x] = ok[x + 1] = near
        for i, m in zip(begin[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            if not salted[i]:
                ok[i : i + m] = m > LARGE or _partners(n[i : i + m], pos[i : i + m], None if label is None else label[i : i + m], percent)
        return b.filter(pa.array(ok))

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            bucket = t.column("bucket").to_numpy()
            cut = int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1 if bucket[0] != bucket[-1] else 0
            if cut == 0 and t.num_rows > 64 * LARGE:  # the rest of a very large bucket may follow: it is passed on whole
                yield from t.slice(0, t.num_rows - LARGE - 1).to_batches()
                rest = t.slice(t.num_rows - LARGE - 1)
                continue
            if cut:
                yield from keep(t.slice(0, cut)).to_batches()
            rest = t.slice(cut)
        if rest is not None:
            yield from keep(rest).to_batches()

    return run


def _pack(batches):
    """(doc_id, text compressed)."""
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = batch.column(1)
        yield pa.record_batch([batch.column(0), pa.array([z.compress((x.as_py() or "").encode()) for x in texts], pa.binary())], ["doc_id", "packed"])


def _with_prefix(k: int, percent: int, hot):
    """(grp, doc_id, packed) -> the same with n and prefix, 16 bits of each shingle of the prefix."""

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = pa.array([z.decompress(x.as_py()).decode() for x in batch.column(2)], pa.large_string())
            n, prefix = [], []
            for _, s in _sets(texts, k):
                n.append(len(s))
                s, _ = _ordered(s, hot.value[0])
                prefix.append(mix(s[: len(s) - (-(-len(s) * percent // 100)) + 1]).astype("<u2").tobytes())
            yield pa.record_batch([*batch.columns, pa.array(n, pa.int32()), pa.array(prefix, pa.binary())], ["grp", "doc_id", "packed", "n", "prefix"])

    return run


def _plausible(percent: int):
    """Rows sorted by grp, (grp, doc_id, label, n, prefix) -> (grp, doc_id, label) of those with a plausible partner there.

    Of two sets, let the one whose prefix ends first have n shingles and a prefix of p: what they share beyond it is at most
    n - p, so a link needs the rest among the prefixes.  Equal 16-bit values only raise that count: no link is lost.
    """

    def keep(rows: pa.Table) -> pa.Table:
        label, n = rows.column("label").to_numpy(), rows.column("n").to_numpy().astype(np.int64)
        codes = [np.frombuffer(x.as_py(), "<u2") for x in rows.column("prefix")]
        flat, owner = np.concatenate(codes), np.repeat(np.arange(len(n)), [len(c) for c in codes])
        beyond = -(-n * percent // 100) - 1
        member, ok = np.zeros(1 << 16, bool), np.zeros(len(n), bool)
        for i in range(len(n)):
            member[codes[i]] = True
            shared = np.bincount(owner[member[flat]], minlength=len(n))
            member[codes[i]] = False
            need = -(-(n + n[i]) * percent // (100 + percent))
            fit = (label != label[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & (shared + np.maximum(beyond, beyond[i]) >= need)
            ok[i] |= bool(fit.any())
            ok |= fit
        return rows.filter(pa.array(ok)).select(["grp", "doc_id", "label"])

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            grp = t.column("grp").to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]])).tolist()
            for a, b in zip(begin, begin[1:], strict=False):
                if b - a > 1:
                    yield from keep(t.slice(a, b - a)).to_batches()
            rest = t.slice(begin[-1])
        if rest is not None and rest.num_rows > 1:
            yield from keep(rest).to_batches()

    return run


class Trie:
    """A trie with compressed edges over ordered sets of small integers.

    The sets are sorted, so that a node is a range of sets with a common beginning: its edge holds the shingles from the
    depth of the parent to the end of that beginning.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
        self.sets = [sets[i] for i in self.order]
        common = []
        for a, b in zip(self.sets, self.sets[1:], strict=False):
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            common.append(int(differ[0]) if len(differ) else m)
        self.common = common
        self.sizes = [len(s) for s in self.sets]

    def children(self, lo: int, hi: int, depth: int) -> list[tuple[int, int]]:
        """Ranges below the node of sets lo..hi-1 that agree up to depth."""
        out, start = [], lo
        for i in range(lo, hi - 1):
            if self.common[i] <= depth:
                out.append((start, i + 1))
                start = i + 1
        out.append((start, hi))
        return out


def linked(sets: list[np.ndarray], labels: list[int], percent: int, every: bool = False) -> list[tuple[int, int]]:
    """Pairs (i, j) of linked sets that join everything linked, directly or not, and not yet of one label; or every linked pair.

    sets: ordered alike; labels: sets with one label are known to be connected.
    """
    parent = {x: x for x in labels}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if len(parent) < 2:
        return []
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    # small integers in the order of the sets' shingles: a shingle's rank is its place in the global order
    inverse = inverse.astype(">i4")
    ends = np.cumsum([len(s) for s in sets])
    coded = [inverse[e - len(s) : e] for s, e in zip(sets, ends, strict=True)]
    trie = Trie(coded)
    # nodes in preorder: (lo, hi, from, to); the node after a subtree is found by its `after`
    nodes: list[list] = []

    def build(lo, hi, depth):
        todo = [(lo, hi, depth)]
        while todo:
            lo, hi, depth = todo.pop()
            end = min(trie.common[lo : hi - 1]) if hi - lo > 1 else trie.sizes[lo]
            sizes = trie.sizes[lo:hi]
            nodes.append([lo, hi, depth, end, min(sizes), max(sizes)])
            if hi - lo > 1:
                for a, b in reversed(trie.children(lo, hi, end)):
                    todo.append((a, b, end))

    for a, b in trie.children(0, len(trie.sets), 0):
        build(a, b, 0)
    after = [0] * len(nodes)
    open_: list[int] = []
    for i, node in enumerate(nodes):
        while open_ and nodes[open_[-1]][1] <= node[0]:
            after[open_.pop()] = i
        open_.append(i)
    for i in open_:
        after[i] = len(nodes)
    member = np.zeros(len(values), bool)
    out: list[tuple[int, int]] = []
    for me in range(len(trie.sets)):
        mine = trie.sets[me]
        n = len(mine)
        member[mine] = True
        own = root(labels[trie.order[me]])
        i = 0
        path: list[tuple[int, int, int]] = []  # (hi, overlap, my shingles at or before)
        while i < len(nodes):
            lo, hi, start, end, small, large = nodes[i]
            while path and path[-1][0] <= lo:
                path.pop()
            overlap, used = (path[-1][1], path[-1][2]) if path else (0, 0)
            if lo > me:
                break
            if 100 * large < percent * n or 100 * n < percent * small:
                i = after[i]
                continue
            if hi - lo == 1 and (lo == me or not every and root(labels[trie.order[lo]]) == own):
                i = after[i]
                continue
            if end > start:
                edge = trie.sets[lo][start:end]
                overlap += int(np.count_nonzero(member[edge]))
                used = int(np.searchsorted(mine, edge[-1], "right"))
            need = -(-percent * (n + max(small, -(-percent * n // 100))) // (100 + percent))
            if overlap + min(n - used, large - end) < need:
                i = after[i]
                continue
            if hi - lo == 1:
                if 100 * overlap >= percent * (n + small - overlap):
                    other = root(labels[trie.order[lo]])
                    out.append((trie.order[me], trie.order[lo]))
                    if other != own:
                        parent[max(own, other)] = min(own, other)
                        own = min(own, other)
            else:
                path.append((hi, overlap, used))
            i += 1
        member[mine] = False
    return out


def _join_groups(k: int, percent: int, hot, whole: bool, every: bool = False):
    """Rows sorted by (grp): (grp, doc_id, label, packed) -> links (src, dst).

    whole: a group is joined as a whole; else in runs of BLOCK_DOCS, each with the group's first document.  every: see linked.
    """

    def run(batches):
        frequent = hot.value[0]
        z = zstandard.ZstdDecompressor()

        def solve(ids, labels, packed):
            texts = pa.array([z.decompress(x).decode() for x in packed], pa.large_string())
            sets = [_ordered(s, frequent) for _, s in _sets(texts, k)]
            # frequent shingles come last: move them above the others by their rank
            coded = []
            for s, rare in sets:
                coded.append((s[:rare], s[rare:]))
            low = np.unique(np.concatenate([c[0] for c in coded]))
            high = np.unique(np.concatenate([c[1] for c in coded]))
            whole_sets = [np.concatenate([np.searchsorted(low, a), len(low) + np.searchsorted(high, b)]) for a, b in coded]
            return [(ids[i], ids[j]) for i, j in linked(whole_sets, labels, percent, every)]

        group, ids, labels, packed, size = None, [], [], [], 0

        def done():
            return solve(ids, labels, packed) if len(set(labels)) > 1 else []

        for batch in batches:
            found = []
            grp = batch.column(0).to_numpy(zero_copy_only=False)
            doc = batch.column(1).to_pylist()
            lab = batch.column(2).to_pylist()
            for r in range(batch.num_rows):
                text = batch.column(3)[r].as_py()
                if group is not None and (grp[r] != group or not whole and (len(ids) >= BLOCK_DOCS or size > BLOCK_SHINGLES)):
                    found += done()
                    if grp[r] == group:
                        ids, labels, packed, size = ids[:1], labels[:1], packed[:1], len(packed[0])
                    else:
                        ids, labels, packed, size = [], [], [], 0
                group = grp[r]
                ids.append(doc[r])
                labels.append(lab[r])
                packed.append(text)
                size += len(text)
            if found:
                yield pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["src", "dst"])
        found = done() if ids else []
        if found:
            yield pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["src", "dst"])

    return run


def _most_frequent(counts: DataFrame) -> list:
    """Rows (shingle, times) of the highest counts, FREQUENT at most: a histogram of the counts gives the least one to take.

    So no more rows than that come to the driver, however many partitions hold them.
    """
    counts = stage(counts, "ngram-frequent")
    grade = F.floor(F.log2("times") * 8)
    least, rows = None, 0
    for g, n in sorted(((r[0], r[1]) for r in counts.groupBy(grade.alias("g")).count().collect()), reverse=True):
        rows += n
        if rows > FREQUENT:
            break
        least = g
    out = counts.where(grade >= least).select("d1", "times").collect() if least is not None else []
    drop_stage(counts)
    return out


def _sampled(k: int):
    """(hash, text) -> (hash, the upper 32 bits of the text's shingles), each text once a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            hashes, ids, out = batch.column(0).to_pylist(), [], []
            new = [r for r, h in enumerate(hashes) if h not in seen and not seen.add(h)]
            for r, s in _sets(batch.column(1).take(pa.array(new, pa.int64())), k) if new else ():
                ids.append(hashes[new[r]])
                out.append(np.unique((s >> np.uint64(32)).astype(np.int64)))
            if ids:
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["h", "shingles"])

    return run


def _frequent(base: DataFrame, described: DataFrame, k: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles (upper 32 bits, ascending) and about how many different sets have them."""
    found = {r[0]: r[1] for r in _most_frequent(described.where("times > 0").groupBy("d1").agg(F.sum("times").alias("times")))}
    share = min(1.0, SAMPLE / max(1, total))
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    cut = ((1 << 64) - 1) * SAMPLE // max(SAMPLE, total) - (1 << 63)
    some = base.select(h.alias("h"), "text").where(F.col("h") <= cut).mapInArrow(_sampled(k), "h long, shingles array<long>").dropDuplicates(["h"])
    counts = some.select(F.explode("shingles").alias("d1")).groupBy("d1").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= SEEN)
    for token, times in _most_frequent(counts):
        found[token] = max(found.get(token, 0), int(times / share))
    tokens = np.array(list(found), np.uint32)
    by = np.argsort(tokens)
    return tokens[by], np.array(list(found.values()), np.int64)[by]


def _representatives(rows: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets, (n, d1, d2, rep, c); and (src, dst), each other document with the one that stands for its class.

    Classes that hold a ten-thousandth of all rows or more, so ten thousand at most, are broadcast to their documents instead of meeting them in
    one task.
    """
    named = rows.where("n > 0 AND doc_id IS NOT NULL")
    reps = stage(named.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")), "ngram-classes")
    huge = F.col("c") >= max(1000, total // 10_000)
    many = reps.where("c > 1").withColumnRenamed("rep", "dst")
    known = named.join(F.broadcast(many.where(huge).drop("c")), ["n", "d1", "d2"], "left")
    rest = known.where("dst IS NULL").drop("dst").join(many.where(~huge).drop("c"), ["n", "d1", "d2"])
    edges = known.where("dst IS NOT NULL").select(F.col("doc_id").alias("src"), "dst").union(rest.select(F.col("doc_id").alias("src"), "dst"))
    return reps, edges.where("src != dst")


def _blocks_joined(members: DataFrame, packed: DataFrame, hot, k: int, percent: int, every: bool) -> DataFrame:
    """Pass 2.  members: (shingle, doc_id, n, label).  Links (src, dst) between documents of one shingle and different labels."""
    parts = members.groupBy("shingle", "label").agg(
        F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("sig")
    )
    several = parts.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("labels"), F.max(F.struct("c", "label")).alias("big"), F.sum("c").alias("c"), F.sum("w").alias("w"),
        F.max_by("w", F.struct("c", "label")).alias("big_w"), F.sum("sig").alias("sig"),
    ).where("labels > 1")
    blocks = lambda c, w: F.greatest(F.ceil(c / BLOCK_DOCS), F.ceil(w / BLOCK_SHINGLES), F.lit(1)).cast("int")
    # buckets with the same members need one of them
    several = several.groupBy("sig", "c", "w").agg(F.min_by(F.struct("shingle", "big", "big_w"), "shingle").alias("b")).select(
        "b.shingle", F.col("b.big.label").alias("big"), blocks(F.col("b.big.c"), F.col("b.big_w")).alias("nd"),
        blocks(F.col("c") - F.col("b.big.c"), F.col("w") - F.col("b.big_w")).alias("nr"),
        (blocks(F.col("c"), F.col("w")) == 1).alias("small"),
    )
    mine = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    dealt = members.join(several, "shingle").select(
        "shingle", "doc_id", "label",
        F.when(F.col("small"), F.array(F.lit("a")))
        .when(
            F.col("label") == F.col("big"),
            F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda i: F.concat_ws(":", F.lit("d"), i, mine(F.col("nd")))),
        )
        .otherwise(
            F.concat(
                F.transform(F.sequence(F.lit(0), F.col("nd") - 1), lambda j: F.concat_ws(":", F.lit("d"), mine(F.col("nr")), j)),
                F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda j: F.concat_ws(":", F.lit("r"), F.least(mine(F.col("nr")), j), F.greatest(mine(F.col("nr")), j))),
            )
        ).alias("cells"),
    )
    dealt = dealt.select(F.explode("cells").alias("cell"), "shingle", "doc_id", "label").select(F.xxhash64("shingle", "cell").alias("grp"), "doc_id", "label")
    dealt = dealt.join(packed.select("doc_id", "n", "prefix"), "doc_id").select("grp", "doc_id", "label", "n", "prefix")
    # ranges of cells: tasks get about as many rows, where hashes would give some of them several large cells
    dealt = dealt.repartitionByRange("grp").sortWithinPartitions("grp").mapInArrow(_plausible(percent), "grp long, doc_id long, label long")
    dealt = stage(dealt, "ngram-dealt")
    # what is left of a block is often the same few rows under many shingles: one of these blocks is joined
    alike = dealt.groupBy("grp").agg(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("doc_id", F.lit(1)).cast("decimal(38,0)")).alias("t"))
    one = alike.groupBy("c", "s", "t").agg(F.min("grp").alias("grp")).select("grp")
    left = stage(dealt.join(one, "grp", "left_semi").select("grp", "doc_id", "label"), "ngram-left")
    texts = left.join(packed.select("doc_id", "packed"), "doc_id").select("grp", "doc_id", "label", "packed")
    links = stage(texts.repartitionByRange("grp").sortWithinPartitions("grp", "label").mapInArrow(_join_groups(k, percent, hot, True, every), "src long, dst long"), "ngram-links")
    drop_stage(dealt)
    drop_stage(left)
    return links


def _labelled(buckets: DataFrame, near: DataFrame) -> DataFrame:
    """The rows of buckets with the component that is known for their document."""
    rows = buckets.join(near, buckets.doc_id == near.node, "left")
    return stage(rows.select("bucket", "shingle", buckets.doc_id, "n", "pos", F.coalesce("component", "doc_id").alias("label")), "ngram-members")


def _grown(members: DataFrame, near: DataFrame, packed: DataFrame, buckets: DataFrame, hot, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rounds among one document of each component, while some shingle of many rows has several components and they grow together.

    Rounds handle (shingle, component) only; the documents learn their components once, at the end.
    """
    every = members.groupBy(F.coalesce("shingle", "bucket").alias("of"), "label").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("c"))
    large = every.groupBy("of").agg(F.count(F.lit(1)).alias("labels"), F.sum("c").alias("rows")).where((F.col("labels") > 1) & (F.col("rows") > BLOCK_DOCS))
    reps, known, before = stage(every.join(large, "of", "left_semi").select("of", "label", "doc_id"), "ngram-reps"), [], None
    for turn in range(8):
        labels = reps.groupBy("of").agg(F.count(F.lit(1)).alias("labels")).where("labels > 1")
        # a component takes part under the shingle that has most of them
        mine = reps.join(labels, "of").groupBy("label").agg(F.max_by(F.struct("of", "doc_id", "labels"), F.struct("labels", "of")).alias("x")).select("label", "x.*")
        mine = stage(mine, "ngram-large")
        count = mine.count()
        if not count or before is not None and count > 0.9 * before:
            drop_stage(mine)
            break
        before = count
        grp = F.xxhash64("of", F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.ceil(F.col("labels") / ROUND_DOCS)))
        rows = mine.select(grp.alias("grp"), "doc_id", "label").join(packed.select("doc_id", "packed"), "doc_id").select("grp", "doc_id", "label", "packed")
        found = rows.repartition("grp").sortWithinPartitions("grp", "doc_id").mapInArrow(_join_groups(k, percent, hot, False), "src long, dst long")
        names = [mine.select(F.col("doc_id").alias(end), F.col("label").alias(to)) for end, to in (("src", "a"), ("dst", "b"))]
        links = stage(stage(found, "ngram-links").join(names[0], "src").join(names[1], "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")), "ngram-links")
        known.append(links)
        to = connected_components(links)
        moved = reps.join(to, reps.label == to.node, "left").groupBy("of", F.coalesce("component", "label").alias("label")).agg(F.min("doc_id").alias("doc_id"))
        moved = stage(moved, "ngram-reps")
        drop_stage(reps)
        drop_stage(mine)
        reps = moved
    drop_stage(reps)
    if not known:
        return members, near
    edges = near.select(F.col("node").alias("src"), F.col("component").alias("dst"))
    for links in known:
        edges = edges.union(links)
    new = stage(connected_components(edges), "ngram-near")
    for t in (near, members, *known):
        drop_stage(t)
    return _labelled(buckets, new), new


def _link_counts(rows: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """(n, d1, d2, n_links): documents linked with a set, those of equal sets included, the document itself not.  pairs: (src, dst) of representatives."""
    size = rows.where("n > 0 AND doc_id IS NOT NULL").select("n", "d1", "d2", "doc_id").distinct().groupBy("n", "d1", "d2").agg(F.count(F.lit(1)).alias("size"))
    classes = reps.select("n", "d1", "d2", "rep").join(size, ["n", "d1", "d2"])
    both = pairs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = both.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(both.select("b", "a"))
    sums = both.join(classes.select(F.col("rep").alias("other"), "size"), "other").groupBy("rep").agg(F.sum("size").alias("linked"))
    return classes.join(sums, "rep", "left").select("n", "d1", "d2", (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).alias("n_links"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, count_links: bool = False) -> DataFrame:
    """Per row of docs: (doc_id, n_shingles, component_id), and n_links if asked for; see the module for the method and the edge cases.

    n_links counts the other documents with a linked set, and is 0 for those without an id or a set.  It takes all pairs of a group of near
    copies, where components take one link for each; documents whose id has several texts count once for each set.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = stage(base.mapInArrow(_describe(k), "doc_id long, n long, d1 long, d2 long, times long"), "ngram-sets")
    rows = described.where("times = 0")
    total = rows.count()
    hot = sc.broadcast(_frequent(base, described, k, total))

    # one document stands for each class of equal sets; those that stand for none are left out by their doc_id, not by the order of rows
    reps, named = _representatives(rows, total)
    standing = reps.select(F.col("rep").alias("doc_id")).distinct()
    copies = stage(rows.where("n > 0 AND doc_id IS NOT NULL").select("doc_id").distinct().join(standing, "doc_id", "left_anti"), "ngram-copies")
    buckets = anti_join(base, copies, "doc_id").mapInArrow(_prefixes(k, percent, hot), "bucket long, shingle long, doc_id long, n int, pos int")
    buckets = buckets.repartition("bucket").sortWithinPartitions("bucket", "n").mapInArrow(_with_partners(percent), buckets.schema)
    # a salted bucket holds a part of its shingle's rows: a row alone in it goes only if the shingle has no other one
    same = "PARTITION BY bucket"
    held = stage(buckets.withColumn("alone", F.expr(f"count(*) OVER ({same}) = 1")).where("NOT alone OR shingle IS NOT NULL"), "ngram-buckets")
    lone = stage(held.where("shingle IS NOT NULL").groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where("c = 1").select("shingle"), "ngram-lone")
    # a shingle's only row is alone in its bucket, so only such rows are joined, at most one of each bucket; the join is broadcast where Spark finds `lone` small
    single = held.where("alone AND shingle IS NOT NULL").join(lone, "shingle", "left_anti").select(*held.columns)
    buckets = held.where("NOT alone").union(single)
    first = buckets.groupBy("doc_id").agg(F.min_by("bucket", F.struct("alone", "pos", "bucket")).alias("grp"))
    packed = base.where("doc_id IS NOT NULL").mapInArrow(_pack, "doc_id long, packed binary")
    packed = packed.join(first, "doc_id").select("grp", "doc_id", "packed")
    packed = stage(packed.mapInArrow(_with_prefix(k, percent, hot), "grp long, doc_id long, packed binary, n int, prefix binary"), "ngram-texts", "none")
    links = packed.select("grp", "doc_id", F.col("doc_id").alias("label"), "packed").repartition("grp").sortWithinPartitions("grp", "doc_id")
    links = stage(links.mapInArrow(_join_groups(k, percent, hot, False), "src long, dst long"), "ngram-links")
    near = stage(connected_components(links), "ngram-near")
    members, near = _grown(_labelled(buckets, near), near, packed, buckets, hot, k, percent)

    # pass 2: shingles under which several components meet
    whole = F.coalesce("shingle", "bucket")
    mixed = members.groupBy(whole.alias("of")).agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed")
    opened = members.join(mixed, whole == F.col("of"), "left_semi").repartition("bucket").sortWithinPartitions("bucket")
    opened = stage(opened.mapInArrow(_with_partners(percent), members.schema), "ngram-open")
    more = _blocks_joined(opened.withColumn("shingle", whole), packed, hot, k, percent, False)
    edges = near.select(F.col("node").alias("src"), F.col("component").alias("dst")).union(more).union(named)
    components = connected_components(edges)
    out = rows.join(components, rows.doc_id == components.node, "left").select(
        rows.doc_id, F.col("n").alias("n_shingles"), F.coalesce("component", rows.doc_id).alias("component_id"), "n", "d1", "d2"
    )
    used = [held, lone, packed, members, opened, more, near, links]
    if count_links:
        every = _blocks_joined(buckets.select(whole.alias("shingle"), "doc_id", "n", F.col("doc_id").alias("label")), packed, hot, k, percent, True)
        counts = _link_counts(rows, reps, every).where("n_links > 0")
        out = out.join(counts, ["n", "d1", "d2"], "left").withColumn("n_links", F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long"))
        used.append(every)
    out = stage(out.drop("n", "d1", "d2"), "ngram-components")
    for t in (*used, copies, reps, described):
        drop_stage(t)
    return out


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))
