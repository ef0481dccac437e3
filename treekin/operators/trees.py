"""Tree edit distance of ordered labelled trees, unit costs.

Trees come as preorder arrays of (label, value, depth, n_children).  Each distinct shape is annotated once, and the distance is
computed once for each pair of distinct shapes, in Arrow batches; equal trees and pairs that a bound on the common labels rules
out never reach Python.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from treekin.functions.hashing import token_stream


def annotate(labels: list, counts: list[int]) -> tuple[list, np.ndarray, list[int]]:
    """Of a preorder: labels in postorder, the leftmost leaf of each node, and the keyroots; all 0-based."""
    order: list = []
    leftmost: list[int] = []
    stack: list[list] = []  # label, children left, leftmost leaf
    for label, n in zip(labels, counts, strict=True):
        stack.append([label, n, None])
        while stack and stack[-1][1] == 0:
            label, _, left = stack.pop()
            here = len(order)
            left = here if left is None else left
            order.append(label)
            leftmost.append(left)
            if stack:
                stack[-1][1] -= 1
                if stack[-1][2] is None:
                    stack[-1][2] = left
    last = {left: i for i, left in enumerate(leftmost)}
    return order, np.array(leftmost, np.int32), sorted(last.values())


def _leaf_rows(ca: np.ndarray, left_a: np.ndarray, cb: np.ndarray, left_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of the first tree, and their distances to every subtree of the second: its size, less one if it has the leaf's label."""
    leaves = np.flatnonzero(left_a == np.arange(len(ca)))
    seen = np.zeros((len(leaves), len(cb) + 1), np.int32)
    np.cumsum(ca[leaves][:, None] == cb, axis=1, out=seen[:, 1:])
    there = seen[:, 1:] > seen[:, left_b]
    return leaves, (np.arange(len(cb)) - left_b + 1 - there).astype(np.int32)


#: More than any distance.
_FAR = 1 << 28


class _Level:
    """Forest tables of several keyroots side by side, none of which lies within another: each has a column for the empty forest and one for each
    node.  All arrays are by column."""

    def __init__(self, keys: list[int], left: np.ndarray, codes: np.ndarray):
        sizes = np.array([j - int(left[j]) + 1 for j in keys])
        ends = np.cumsum(sizes + 1)
        self.zero = ends - sizes - 1
        of = np.repeat(np.arange(len(keys)), sizes + 1)
        self.steps = np.arange(int(ends[-1])) - self.zero[of]
        first = np.array([int(left[j]) for j in keys])[of]
        self.node = np.maximum(first + self.steps - 1, 0)
        self.before = np.maximum(np.arange(int(ends[-1])) - 1, 0)
        self.jump = self.zero[of] + np.maximum(left[self.node] - first, 0)
        self.spine = (left[self.node] == first) & (self.steps > 0)
        self.spine_nodes = self.node[self.spine]
        self.codes = codes[self.node]
        # a running minimum over all columns stays within a keyroot's own when each next one's values are far below
        self.slope = self.steps + of.astype(np.int64) * _FAR


def _levels(left: np.ndarray, keys: list[int], codes: np.ndarray) -> list[_Level]:
    """The keyroots that are no leaves, those within others first."""
    height: dict[int, int] = {}
    for j in keys:
        if left[j] != j:
            height[int(j)] = 1 + max((h for k, h in height.items() if k >= left[j]), default=-1)
    return [_Level([j for j, h in height.items() if h == level], left, codes) for level in range(1 + max(height.values(), default=-1))]


def _fill(trees: np.ndarray, ca: np.ndarray, left_a: np.ndarray, keys_a: list[int], levels: list[_Level]) -> int:
    """Fills the distances of all pairs of subtrees, row by row for all keyroots of the second tree at once; the number of cells."""
    cells = 0
    for i in keys_a:
        i0 = int(left_a[i])
        if i0 == i:
            continue
        m = int(i) - i0 + 1
        tables = [np.empty((m + 1, len(v.steps)), np.int64) for v in levels]
        for table, v in zip(tables, levels, strict=True):
            table[0] = v.steps
            cells += m * (len(v.steps) - len(v.zero))
        for x in range(1, m + 1):
            at = i0 + x - 1
            back, on_a = int(left_a[at]) - i0, left_a[at] == i0
            for table, v in zip(tables, levels, strict=True):
                above = table[x - 1]
                swap = table[back][v.jump] + trees[at, v.node]
                if on_a:
                    swap = np.where(v.spine, above[v.before] + (v.codes != ca[at]), swap)
                row = np.minimum(above + 1, swap)
                row[v.zero] = x
                row -= v.slope
                np.minimum.accumulate(row, out=row)
                row += v.slope
                table[x] = row
                if on_a:
                    trees[at, v.spine_nodes] = row[v.spine]
    return cells


def tree_distance(a: tuple, b: tuple, most: int | None = None, work: list[int] | None = None) -> int | None:
    """Zhang and Shasha's recurrence over annotated trees; the rows of a forest table are NumPy vectors.

    Distances of leaves come for all of them at once.  Of a row, the costs without an insertion come from the row above; insertions are
    then one running minimum.  Keyroots of the second tree that don't lie within each other are handled side by side.

    most: distances beyond it are None.  Where a mapping of cost `most` at most ends two forests with nodes x and y, their places in postorder
    differ by `most` at most, as every node that one side has more is deleted or inserted.  So only a band of each table is filled, pairs of
    subtrees that begin outside of it are left out, and the last table ends at a row from which the rest can't be reached.
    work: the cells filled are added to its first item.
    """
    (la, left_a, keys_a), (lb, left_b, keys_b) = a, b
    if not len(la) or not len(lb):
        total = len(la) + len(lb)
        return total if most is None or total <= most else None
    if most is not None and abs(len(la) - len(lb)) > most:
        return None
    band = len(la) + len(lb) if most is None else most
    if isinstance(la, np.ndarray) and isinstance(lb, np.ndarray):
        ca, cb = la, lb
    else:
        codes = {x: i for i, x in enumerate(dict.fromkeys([*la, *lb]))}
        ca, cb = np.array([codes[x] for x in la]), np.array([codes[x] for x in lb])
    trees = np.full((len(la), len(lb)), _FAR, np.int32)
    leaves, costs = _leaf_rows(ca, left_a, cb, left_b)
    trees[leaves] = costs
    leaves, costs = _leaf_rows(cb, left_b, ca, left_a)
    trees[:, leaves] = costs.T
    levels = _levels(left_b, keys_b, cb)
    inner_a, inner_b = (np.array([int(left[k]) for k in keys if left[k] != k], np.int64) for left, keys in ((left_a, keys_a), (left_b, keys_b)))
    # tables of pairs cost by the pairs in the band, tables side by side by the levels, which are wider
    if most is None or 2 * len(levels) * len(inner_a) < (np.abs(inner_a[:, None] - inner_b) <= band).sum():
        cells = _fill(trees, ca, left_a, keys_a, levels)
        if work is not None:
            work[0] += cells
        found = int(trees[-1, -1])
        return found if most is None or found <= most else None
    for i in keys_a:
        i0 = int(left_a[i])
        if i0 == i:
            continue
        for j in keys_b:
            j0 = int(left_b[j])
            if j0 == j or abs(i0 - j0) > band:
                continue
            m, n = int(i) - i0 + 1, int(j) - j0 + 1
            steps = np.arange(n + 1, dtype=np.int32)
            forest = np.full((m + 1, n + 1), _FAR, np.int32)
            reach = min(n, i0 + band - j0)
            forest[0, : reach + 1] = steps[: reach + 1]
            spine_b = left_b[j0 : j + 1] == j0
            jump_b = left_b[j0 : j + 1] - j0
            last = most is not None and i == len(la) - 1 and j == len(lb) - 1
            for x in range(1, m + 1):
                at = i0 + x - 1
                lo, hi = max(1, at - band - j0 + 1), min(n, at + band - j0 + 1)
                if lo > hi:
                    if lo > n:
                        break
                    continue
                if work is not None:
                    work[0] += hi - lo + 1
                row = np.empty(hi - lo + 2, np.int32)
                row[0] = x if lo == 1 and at - j0 + 1 <= band else _FAR
                forest[x, lo - 1] = row[0]
                row[1:] = forest[x - 1, lo : hi + 1] + 1
                on_b, jump = spine_b[lo - 1 : hi], jump_b[lo - 1 : hi]
                there = trees[at, j0 + lo - 1 : j0 + hi]
                swap = forest[int(left_a[at]) - i0, jump] + there
                if left_a[at] == i0:
                    swap = np.where(on_b, forest[x - 1, lo - 1 : hi] + (cb[j0 + lo - 1 : j0 + hi] != ca[at]), swap)
                np.minimum(row[1:], swap, out=row[1:])
                row = np.minimum.accumulate(row - steps[lo - 1 : hi + 1]) + steps[lo - 1 : hi + 1]
                forest[x, lo : hi + 1] = row[1:]
                if left_a[at] == i0:
                    trees[at, j0 + lo - 1 : j0 + hi] = np.where(on_b, row[1:], there)
                if last and (row + np.abs((m - x) - (n - np.arange(lo - 1, hi + 1)))).min() > most:
                    return None
    found = int(trees[-1, -1])
    return found if most is None or found <= most else None


def shape(ast: Column) -> Column:
    """What the distance depends on: signatures and numbers of children, in preorder."""
    return F.transform(ast, lambda x: F.struct(F.concat_ws(":", x["label"], x["value"]).alias("sig"), x["n_children"].alias("n_children")))


TREE = StructType(
    [
        StructField("labels", ArrayType(LongType())), StructField("leftmost", ArrayType(IntegerType())), StructField("keyroots", ArrayType(IntegerType())),
        StructField("bag", ArrayType(LongType())), StructField("branches", ArrayType(LongType())),
    ]
)


def numbered(codes: np.ndarray) -> np.ndarray:
    """A set for a multiset: each code mixed with the number of equal ones before it.  Sets share as many elements as the multisets do, and
    seldom more."""
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(codes) else np.zeros(0, bool)
    place = np.arange(len(codes)) - np.maximum.accumulate(np.where(first, np.arange(len(codes)), 0)) if len(codes) else np.zeros(0, np.int64)
    return _mixed(ordered.astype(np.uint64), place.astype(np.uint64)).view(np.int64)


def _mixed(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        out = (out ^ part) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(32)
    return out


def branches(codes: list[int], counts: list[int]) -> np.ndarray:
    """Of a preorder, each node's binary branch: its label, the one of its first child and the one of its next sibling, as one code.

    An edit changes five branches at most, so the distance of two trees is a fifth at least of the branches that they don't share.
    """
    n = len(codes)
    child, sibling = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    before: list[list[int]] = []  # of each open node: children left, the child before
    for i, c in enumerate(counts):
        while before and before[-1][0] == 0:
            before.pop()
        if before:
            top = before[-1]
            if top[1] < 0:
                child[i - 1] = i
            else:
                sibling[top[1]] = i
            top[0] -= 1
            top[1] = i
        before.append([c, -1])
    labels = np.array([*codes, 0], np.int64).view(np.uint64)
    none = np.uint64(0x5851F42D4C957F2D)
    return _mixed(labels[:-1], np.where(child >= 0, labels[child], none), np.where(sibling >= 0, labels[sibling], none)).view(np.int64)


@F.arrow_udf(TREE)
def _annotated(codes: pa.Array, counts: pa.Array) -> pa.Array:
    out = []
    for c, n in zip(codes.to_pylist(), counts.to_pylist(), strict=True):
        labels, leftmost, keyroots = annotate(c or [], n or [])
        bag, profile = numbered(np.array(c or [], np.int64)), numbered(branches(c or [], n or []))
        out.append({"labels": labels, "leftmost": leftmost.tolist(), "keyroots": keyroots, "bag": bag.tolist(), "branches": profile.tolist()})
    return pa.array(out, pa.struct([(f.name, pa.list_(pa.int64() if f.dataType.elementType == LongType() else pa.int32())) for f in TREE.fields]))


def annotated(shape_col: Column) -> Column:
    """A shape as the distance takes it: hashes of the signatures in postorder, leftmost leaves, keyroots; and as bounds take it: its labels and its
    binary branches as sets."""
    return _annotated(F.transform(shape_col, lambda x: F.xxhash64(x["sig"])), F.transform(shape_col, lambda x: x["n_children"].cast("int")))


def _parts(trees: pa.Array) -> list:
    """Annotated trees of a column of structs; None for null."""
    known = trees.is_valid().to_pylist()
    fields = [[np.asarray(x.values) if x.is_valid else None for x in trees.field(k)] for k in range(3)]
    return [tuple(f[i] for f in fields) if ok else None for i, ok in enumerate(known)]


@F.arrow_udf(IntegerType())
def _distance(a: pa.Array, b: pa.Array, most: pa.Array) -> pa.Array:
    rows = zip(_parts(a), _parts(b), most.to_pylist(), strict=True)
    return pa.array([None if x is None or y is None else tree_distance(x, y, k) for x, y, k in rows], pa.int32())


def distance_bound(a: Column, b: Column) -> Column:
    """The least that the distance of two annotated trees can be, by their sizes and labels and by their binary branches."""
    n, m = F.size(a["labels"]), F.size(b["labels"])
    labels = F.greatest(n, m) - F.size(F.array_intersect(a["bag"], b["bag"]))
    shared = F.size(F.array_intersect(a["branches"], b["branches"]))
    return F.greatest(labels, F.ceil((n + m - 2 * shared) / 5).cast("int"))


def label_counts(ast: Column) -> Column:
    """Map from signature to count."""
    tokens = token_stream(ast)
    return F.map_from_entries(F.transform(F.array_distinct(tokens), lambda t: F.struct(t, F.size(F.filter(tokens, lambda x: x == t)))))


def ted_score(distance: Column, n: Column, m: Column) -> Column:
    return F.when(n + m == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - distance / (n + m)))


def tree_distances(trees: DataFrame, pairs: DataFrame) -> DataFrame:
    """trees: (tree_id, shape), or (tree_id, tree) with the shape annotated; pairs: (a, b) of tree ids, a <= b.  Adds distance, na, nb, ted.

    pairs may have a column most: where the distance is beyond it, distance and ted are null."""
    tree = F.col("tree") if "tree" in trees.columns else annotated(F.col("shape"))
    t = trees.select("tree_id", tree.alias("tree")).select("tree_id", "tree", F.size("tree.labels").alias("n"))
    rows = pairs.join(t.select(F.col("tree_id").alias("a"), F.col("tree").alias("ta"), F.col("n").alias("na")), "a")
    rows = rows.join(t.select(F.col("tree_id").alias("b"), F.col("tree").alias("tb"), F.col("n").alias("nb")), "b")
    same = F.col("a") == F.col("b")
    # a null on one side keeps equal trees out of the recurrence
    most = F.col("most").cast("int") if "most" in pairs.columns else F.lit(None).cast("int")
    distance = F.when(same, F.lit(0)).otherwise(_distance(F.when(~same, F.col("ta")), F.col("tb"), most))
    rows = rows.withColumn("distance", distance.cast("int"))
    return rows.select("a", "b", "distance", "na", "nb", ted_score(F.col("distance"), F.col("na"), F.col("nb")).alias("ted"))


def common_labels(a: Counter, b: Counter) -> int:
    return sum((a & b).values())
