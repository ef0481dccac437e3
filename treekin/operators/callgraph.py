"""Call graphs: edges, degrees, weak components, similarity."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treekin.functions.scalar import clamp, ratio
from treekin.operators.grouped import whole_groups
from treekin.operators.sets import multiset_jaccard
from treekin.shared import stage

# Fixed shares of degrees, edges and components.
SHARES = (0.6, 0.2, 0.2)


def call_edges(functions: DataFrame, by: str = "submission_id") -> DataFrame:
    """functions: (by, name, callees).  Distinct (by, caller, callee) where the callee is defined in the same group."""
    names = functions.select(by, F.col("name").alias("callee")).distinct()
    calls = functions.select(by, F.col("name").alias("caller"), F.explode("callees").alias("callee")).distinct()
    return calls.join(names, [by, "callee"], "left_semi").select(by, "caller", "callee")


def degree_counts(nodes: DataFrame, edges: DataFrame, by: str = "submission_id") -> DataFrame:
    """(by, in_degree, out_degree, n_nodes) over all nodes, isolated ones included; a loop counts on both sides.

    nodes: (by, name); edges: (by, caller, callee), distinct.
    """
    ends = edges.select(by, F.col("caller").alias("name"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    ends = ends.union(edges.select(by, "callee", F.lit(1), F.lit(0))).union(nodes.select(by, "name", F.lit(0), F.lit(0)))
    each = ends.groupBy(by, "name").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return each.groupBy(by, "in_degree", "out_degree").agg(F.count(F.lit(1)).alias("n_nodes"))


#: Groups with more nodes and edges than that are solved together, by rounds over the whole graph.
GROUP_ROWS = 200_000


def _count_components(batches):
    """Of rows (by, name, other), sorted by `by`: each group's components; a row without other is a node alone."""
    for rows, begin in whole_groups(batches, 1):
        codes = pa.chunked_array([*rows.column(1).chunks, *rows.column(2).chunks]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        u, v = codes[: rows.num_rows], codes[rows.num_rows :]
        counts = []
        for a, b in zip(begin, begin[1:], strict=False):
            parent: dict[int, int] = {}
            loose = 0
            for x, y in zip(u[a:b].tolist(), v[a:b].tolist(), strict=True):
                for z in (x, y):
                    if z == z and z not in parent:
                        parent[z] = z
                        loose += 1
                if y == y:
                    while parent[x] != x:
                        parent[x] = x = parent[parent[x]]
                    while parent[y] != y:
                        parent[y] = y = parent[parent[y]]
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        loose -= 1
            counts.append(loose)
        yield pa.record_batch([rows.column(0).take(pa.array(begin[:-1])).combine_chunks(), pa.array(counts, pa.int64())], ["key", "n_components"])


def component_counts(nodes: DataFrame, edges: DataFrame, by: str = "submission_id", most: int = GROUP_ROWS) -> DataFrame:
    """(by, n_components): weak components of the groups' nodes, loops ignored.

    A call graph is small: each group of `most` nodes and edges at most is solved in one task, many of them from one batch.  Larger
    ones are solved at once, as one graph, by connected_components.
    """
    kind = nodes.schema[by].dataType.simpleString()
    rows = nodes.select(F.col(by).alias("key"), F.col("name").cast("string").alias("name"), F.lit(None).cast("string").alias("other"))
    rows = rows.union(edges.select(by, F.col("caller").cast("string"), F.col("callee").cast("string"))).where("key IS NOT NULL")
    large = stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.col("key").alias(by)), "large-graphs")
    some = not large.isEmpty()
    small = rows.join(large.withColumnRenamed(by, "key"), "key", "left_anti") if some else rows
    out = small.repartition("key").sortWithinPartitions("key").mapInArrow(_count_components, f"key {kind}, n_components long").withColumnRenamed("key", by)
    if some:
        out = out.union(_large_component_counts(nodes.join(large, by, "left_semi"), edges.join(large, by, "left_semi"), by))
    return out


def _large_component_counts(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    from treekin.operators.components import connected_components

    key = lambda c: F.to_json(F.array(F.col(by).cast("string"), F.col(c).cast("string")))
    found = connected_components(edges.select(key("caller").alias("src"), key("callee").alias("dst")))
    named = nodes.select(by, key("name").alias("node")).distinct().join(found, "node", "left")
    return named.groupBy(by).agg(F.countDistinct(F.coalesce("component", "node")).alias("n_components"))


def graph_shapes(nodes: DataFrame, edges: DataFrame, by: str = "submission_id") -> DataFrame:
    """(by, degrees, n_nodes, n_edges, n_components): all that the similarity depends on.  degrees: map "in,out" -> count."""
    nodes = nodes.select(by, "name").distinct()
    degrees = degree_counts(nodes, edges, by).groupBy(by).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat_ws(",", "in_degree", "out_degree"), "n_nodes")))).alias("degrees"), F.sum("n_nodes").alias("n_nodes")
    )
    count = edges.groupBy(by).agg(F.count(F.lit(1)).alias("n_edges"))
    return degrees.join(count, by, "left").join(component_counts(nodes, edges, by), by).select(by, "degrees", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "n_components")


def graph_similarity_detail(a: Column, b: Column) -> Column:
    """a, b: structs of degrees, n_nodes, n_edges and n_components.  A struct of the score, its three parts and the sizes on both sides.

    Both without nodes: score 1, the parts null.
    """
    none = (a["n_nodes"] == 0) & (b["n_nodes"] == 0)
    parts = (multiset_jaccard(a["degrees"], b["degrees"]), ratio(a["n_edges"], b["n_edges"]), ratio(a["n_components"], b["n_components"]))
    score = sum((share * part for share, part in zip(SHARES[1:], parts[1:], strict=True)), SHARES[0] * parts[0])
    named = [F.when(~none, part).alias(f"{name}_similarity") for name, part in zip(("degree", "edge", "component"), parts, strict=True)]
    sizes = [x[f"n_{what}"].cast("double").alias(f"{what}_{side}") for what in ("nodes", "edges") for x, side in ((a, "a"), (b, "b"))]
    return F.struct(F.when(none, F.lit(1.0)).otherwise(clamp(score)).alias("score"), *named, *sizes)


def graph_similarity(a: Column, b: Column) -> Column:
    """a, b: structs of degrees, n_nodes, n_edges and n_components; both without nodes: 1."""
    return graph_similarity_detail(a, b)["score"]
