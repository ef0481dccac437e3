"""Similarity of sets and multisets."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from treekin.functions.hashing import LONGS, _in_parts, _lists, _longs, _ragged
from treekin.shared import setting, small_batches, stage

#: Numbers of elements are known for so many groups of elements.
GROUPS = 1 << 18
#: Elements of a cell of jaccard_pairs, and common elements of pairs that are counted at once.
CELL, FANOUT = 1 << 21, 1 << 20


def jaccard(a: Column, b: Column) -> Column:
    """Of two array columns without repeats; both empty: 1."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def jaccard_detail(a: Column, b: Column) -> Column:
    n = F.size(F.array_intersect(a, b)).cast("double")
    return F.struct(jaccard(a, b).alias("score"), n.alias("intersection"), F.size(F.array_union(a, b)).cast("double").alias("union"), F.size(a).cast("double").alias("size_a"), F.size(b).cast("double").alias("size_b"))


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Of two map columns from key to count: sum of minima over sum of maxima; both empty: 1."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    at = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(0))
    both = F.aggregate(
        keys, F.struct(F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi")),
        lambda s, k: F.struct((s["lo"] + F.least(at(a, k), at(b, k))).cast("long").alias("lo"), (s["hi"] + F.greatest(at(a, k), at(b, k))).cast("long").alias("hi")),
    )
    return F.when(F.size(keys) == 0, F.lit(1.0)).otherwise(F.transform(F.array(both), lambda s: s["lo"] / s["hi"])[0])


@F.arrow_udf(StringType())
def _digest(column: pa.Array) -> pa.Array:
    """SHA-256 of lists of longs without repeats, in any order."""
    values, first = _ragged(column)
    longs, null = values.fill_null(0).to_numpy(), values.is_null().to_numpy(zero_copy_only=False)
    parts = [(np.sort(longs[a:b][~null[a:b]]).tobytes(), null[a:b].any()) for a, b in zip(first, first[1:], strict=False)]
    return pa.array([hashlib.sha256(x + b"null" if n else x).hexdigest() for x, n in parts], pa.string())


def representatives(sets: DataFrame, item: str = "id", elements: str = "elements") -> DataFrame:
    """(id, representative): the smallest id with the same elements.  Sets are told apart by a 256-bit digest of their sorted elements."""
    own = F.array_distinct(F.coalesce(F.col(elements), F.array().cast(sets.schema[elements].dataType)))
    if sets.schema[elements].dataType.elementType == LongType():
        digest = _digest(own)
    else:
        digest = F.sha2(F.array_join(F.array_sort(own).cast("array<string>"), "\n", "null"), 256)
    rows = stage(sets.select(F.col(item).alias("id"), digest.alias("digest")), "digests")
    return rows.join(rows.groupBy("digest").agg(F.min("id").alias("representative")), "digest").select("id", "representative")


def shared_counts(sets: DataFrame, item: str = "id", elements: str = "elements") -> DataFrame:
    """(a, b, n_shared) of all pairs a < b that share an element: an inverted index joined with itself on the element."""
    rows = sets.select(F.col(item).alias("id"), F.explode(F.array_distinct(elements)).alias("e"))
    a, b = rows.select(F.col("id").alias("a"), "e"), rows.select(F.col("id").alias("b"), "e")
    return a.join(b, "e").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared"))


def _pairs_of(left: pa.Table, right: pa.Table, same: bool):
    """Rows (a, b, n_shared, n_union, score) of the pairs of a left and a right set (id, n, s) that share an element; same: both sides are the same
    sets.  As many left sets at once as have FANOUT common elements with right ones, or one."""
    (x, first), (y, begin) = (_ragged(t.column("s").combine_chunks()) for t in (left, right))
    codes = pa.concat_arrays([x, y]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    x, y = codes[: len(x)], codes[len(x) :]
    by = np.argsort(y, kind="stable")
    owner = np.repeat(np.arange(right.num_rows), np.diff(begin))[by]
    held = np.concatenate([[0], np.cumsum(np.bincount(y, minlength=int(codes.max(initial=-1)) + 1))])
    fan = np.concatenate([[0], np.cumsum(held[x + 1] - held[x])])
    ids, others = (t.column("id").combine_chunks() for t in (left, right))
    n, m, width = left.column("n").to_numpy(), right.column("n").to_numpy(), right.num_rows
    i = 0
    while i < left.num_rows:
        j = max(i + 1, int(np.searchsorted(fan[first], fan[first[i]] + FANOUT, "right")) - 1)
        at = np.arange(first[i], first[j])
        many = held[x[at] + 1] - held[x[at]]
        place = np.repeat(held[x[at]] - (fan[at] - fan[first[i]]), many) + np.arange(many.sum())
        key = np.repeat(np.repeat(np.arange(j - i), np.diff(first[i : j + 1])), many) * width + owner[place]
        if (j - i) * width <= 8 * FANOUT:
            count = np.bincount(key)
            key = np.flatnonzero(count)
            count = count[key]
        else:
            key, count = np.unique(key, return_counts=True)
        u, v = key // width + i, key % width
        if same:
            keep = u < v
            u, v, count = u[keep], v[keep], count[keep]
        a, b = ids.take(pa.array(u)), others.take(pa.array(v))
        less, union = pc.less(a, b), n[u] + m[v] - count
        yield pa.record_batch([pc.if_else(less, a, b), pc.if_else(less, b, a), pa.array(count), pa.array(union), pa.array(count / union)], ["a", "b", "n_shared", "n_union", "score"])
        i = j


def _packed(batches):
    """Of rows (block, id, n, s), sorted by block: (block, sets), a row for each block."""

    def row(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        held = pa.Table.from_batches(rows).combine_chunks()
        sets = pa.StructArray.from_arrays([held.column(c).chunk(0) for c in "id n s".split()], ["id", "n", "s"])
        return pa.record_batch([held.column("block").chunk(0)[:1], pa.ListArray.from_arrays(pa.array([0, len(sets)], pa.int32()), sets)], ["block", "sets"])

    now, held = None, []
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for p, q in zip(cuts, cuts[1:], strict=False):
            if q > p:
                if held and blocks[p] != now:
                    yield row(held)
                    held = []
                now = blocks[p]
                held.append(batch.slice(p, q - p))
    if held:
        yield row(held)


def _cells(batches):
    """Of rows (x, left, y, right), each two packed blocks: the pairs of their sets, one cell at a time."""

    def sets(column: pa.Array, k: int) -> pa.Table:
        structs = column.slice(k, 1).flatten()
        return pa.table(dict(zip(("id", "n", "s"), structs.flatten(), strict=True)))

    for batch in batches:
        for k in range(batch.num_rows):
            same = batch.column("x")[k] == batch.column("y")[k]
            left = sets(batch.column("left"), k)
            yield from _pairs_of(left, left if same else sets(batch.column("right"), k), same)


def jaccard_pairs(sets: DataFrame, item: str = "id", elements: str = "elements", cell: int = CELL) -> DataFrame:
    """(a, b, n_shared, n_union, score) of all pairs that share an element.

    Sets are dealt into blocks; each pair of blocks is a cell of `cell` elements or so, which one task compares whole.  A block is one row of a
    staged table, and cells are a product of that table with itself, whose tasks read the blocks where they are: what is shuffled is
    each element once or twice, no copy for each block and no row for each common element of a pair.  Each pair comes up once, with its result.
    Two empty sets share none and so are no pair here, though jaccard() gives them 1.  Equal sets give as many pairs as others: where there
    can be many, pairs are taken of representatives().
    """
    spark = sets.sparkSession
    small_batches(spark)
    rows = sets.select(F.col(item).alias("id"), F.array_distinct(elements).alias("s"))
    each = rows.select("id", F.size("s").cast("long").alias("n"), F.explode("s").alias("e"))
    common = each.withColumn("df", F.count("e").over(Window.partitionBy("e"))).where("df > 1")
    lists = stage(common.groupBy("id", "n").agg(F.collect_list("e").alias("s")), "common-elements")
    total = lists.agg(F.sum(F.size("s").cast("long"))).first()[0] or 0
    blocks = max(-(-2 * total // cell), math.isqrt(2 * spark.sparkContext.defaultParallelism) + 1)
    kinds = {f.name: f.dataType.simpleString() for f in lists.schema}
    dealt = lists.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "n", "s").repartition("block").sortWithinPartitions("block")
    # a file for each block, so that a task that reads blocks holds those of its part of the table and no others
    with setting(spark, "spark.sql.files.maxRecordsPerFile", "1"):
        packed = stage(dealt.mapInArrow(_packed, f"block int, sets array<struct<id: {kinds['id']}, n: long, s: {kinds['s']}>>"), "blocks")
    left, right = packed.select(F.col("block").alias("x"), F.col("sets").alias("left")), packed.select(F.col("block").alias("y"), F.col("sets").alias("right"))
    # of two blocks one order is a cell; which one alternates, so that each task of the product has its share
    one = (F.col("x") == F.col("y")) | ((F.col("x") < F.col("y")) == ((F.col("x") + F.col("y")) % 2 == 0)) & (F.col("x") != F.col("y"))
    return left.hint("shuffle_replicate_nl").join(right, one).mapInArrow(_cells, f"a {kinds['id']}, b {kinds['id']}, n_shared long, n_union long, score double")


def _group(hashes: np.ndarray) -> np.ndarray:
    return ((hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GROUPS.bit_length() + 1)).astype(np.int64)


def _group_counts(batches):
    """Of lists of hashes: (g, n), how many elements of a task fall into each group."""
    counts = np.zeros(GROUPS, np.int64)
    for batch in batches:
        counts += np.bincount(_group(_longs(batch.column(0).flatten()).view(np.int64)), minlength=GROUPS)
    at = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(at), pa.array(counts[at])], ["g", "n"])


def _prefix(often, threshold: float):
    """Of a set's hashes, those in the rarest groups first: the first n - ceil(threshold * n) + 1."""

    def run(column: pa.Array) -> pa.Array:
        values, first = _ragged(column)
        h, n = _longs(values).view(np.int64), np.diff(first)
        run = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((h, often.value[_group(h)], run))
        keep = np.minimum(n, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1)
        inside = np.arange(len(h)) - np.repeat(first[:-1], n) < np.repeat(keep, n)
        return _lists(h[order][inside], np.concatenate([[0], np.cumsum(keep)]))

    return F.arrow_udf(_in_parts(run), LONGS)


def similar_pairs(sets: DataFrame, threshold: float, item: str = "id", elements: str = "elements") -> DataFrame:
    """jaccard_pairs with score >= threshold > 0, by prefixes: elements have one order in all sets, and a similar pair shares one of the
    first n - ceil(threshold * n) + 1 of each set.

    Any order loses no pair.  This one goes by the number of elements in an element's group, of GROUPS by a hash, so that frequent elements come
    last and are hardly ever joined on, while no element is shuffled to be counted; these GROUPS numbers go to all tasks.
    """
    spark = sets.sparkSession
    rows = sets.select(F.col(item).alias("id"), F.array_distinct(elements).alias("s")).where("size(s) > 0")
    long = sets.schema[elements].dataType.elementType == LongType()
    hashes = F.transform("s", lambda e: F.coalesce(e, F.lit(0).cast("long")) if long else F.xxhash64(e))
    often = np.zeros(GROUPS, np.int64)
    for batch in rows.select(hashes.alias("h")).mapInArrow(_group_counts, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow().to_batches():
        often[batch.column("g").to_numpy()] = batch.column("n").to_numpy()
    prefix = stage(rows.select("id", F.size("s").alias("n"), _prefix(spark.sparkContext.broadcast(often), threshold)(hashes).alias("p")), "prefixes")
    prefix = prefix.select("id", "n", F.explode("p").alias("e"))
    a, b = (prefix.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), "e") for x in "ab")
    near = (F.col("na") >= F.lit(threshold) * F.col("nb") - 1e-9) & (F.col("nb") >= F.lit(threshold) * F.col("na") - 1e-9)
    pairs = a.join(b, "e").where("a < b").where(near).select("a", "b").distinct()
    pairs = pairs.join(rows.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(rows.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    n = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = (F.size("sa") + F.size("sb")).cast("long") - n
    return pairs.select("a", "b", n.alias("n_shared"), union.alias("n_union"), (n / union).alias("score")).where(F.col("score") >= threshold)
