"""Maximum bipartite matching, by phases of shortest augmenting paths.

The visiting order is fixed, because it decides which of several maximum matchings comes out: left vertices in their order, their
partners in the order of the edge list.
"""

from __future__ import annotations

from collections.abc import Hashable, Mapping, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treekin.operators.grouped import whole_groups


def maximum_matching(edges: Mapping[Hashable, Sequence], left: Sequence, right: Sequence) -> dict:
    """left vertex -> right vertex."""
    partner_l: dict = {}
    partner_r: dict = {}
    known = set(right)
    if not all(known.issuperset(edges.get(u, ())) for u in left):
        raise KeyError("an edge leads to an unknown right vertex")
    while True:
        layer = {u: 0 for u in left if u not in partner_l}
        queue, free = list(layer), False
        for u in queue:  # grows while it is read
            for v in edges.get(u, ()):
                w = partner_r.get(v)
                if v not in partner_r:
                    free = True
                elif w not in layer:
                    layer[w] = layer[u] + 1
                    queue.append(w)
        if not free:
            return {u: partner_l[u] for u in left if u in partner_l}
        for start in left:
            if start in partner_l:
                continue
            # a depth-first search without recursion: the path so far, with each vertex's untried edges
            path = [(start, iter(edges.get(start, ())))]
            taken: list = []
            while path:
                u, rest = path[-1]
                for v in rest:
                    if v not in partner_r:
                        taken.append(v)
                        for (x, _), y in zip(path, taken, strict=True):
                            partner_l[x], partner_r[y] = y, x
                        path = []
                        break
                    w = partner_r[v]
                    if layer.get(w) == layer[u] + 1:
                        taken.append(v)
                        path.append((w, iter(edges.get(w, ()))))
                        break
                else:
                    layer[u] = None
                    path.pop()
                    if taken:
                        taken.pop()


def matched_rows(left: np.ndarray, right: np.ndarray, begin: list[int]) -> np.ndarray:
    """Rows of the matched edges.  Groups begin at `begin`; their edges come in the order in which they are tried."""
    out: list[int] = []
    for a, b in pairwise(begin):
        if b - a == 1:
            out.append(a)
            continue
        lists: dict[int, list[int]] = {}
        at: dict[tuple[int, int], int] = {}
        for i, (u, v) in enumerate(zip(left[a:b].tolist(), right[a:b].tolist(), strict=True), a):
            lists.setdefault(u, []).append(v)
            at.setdefault((u, v), i)
        out += [at[x] for x in maximum_matching(lists, list(lists), right[a:b].tolist()).items()]
    return np.array(out, np.int64)


def match_groups(edges: DataFrame, by: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """edges: (by..., left, right, weight, keep...), left and right longs.  The matched edges of each group: (by..., left, right, keep...).

    Left vertices are visited in ascending order, their partners by descending weight, then ascending.  One shuffle brings groups
    together, and a batch of rows is matched at once, however many groups it holds; a group lies in memory as a whole.
    """
    rows = edges.select(*by, "left", "right", *keep, "weight").repartition(*by).sortWithinPartitions(*by, "left", F.desc("weight"), "right")
    names = [*by, "left", "right", *keep]

    def run(batches):
        for group, begin in whole_groups(batches, len(by)):
            left, right = (group.column(c).to_numpy() for c in ("left", "right"))
            found = group.take(pa.array(matched_rows(left, right, begin))).select(names)
            yield from found.to_batches()

    return rows.mapInArrow(run, rows.select(*names).schema)
