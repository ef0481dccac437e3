"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round rewires every edge to the smallest known neighbour; the number of edges never grows, hubs are met by
pre-aggregated minima and joins that adaptive execution can split, and the rounds needed grow with the logarithm of the
longest path.  Every round is a written table, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treekin.shared import drop_stage, stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v.  One half-round."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge; component is the smallest node reachable.

    Self-loops and repeated edges change nothing; rows with a null end are ignored; no edges give no rows.
    """
    now = stage(
        edges.where(f"`{src}` IS NOT NULL AND `{dst}` IS NOT NULL AND `{src}` != `{dst}`")
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .distinct(),
        "components",
    )
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        new = stage(_star(_star(now, True), False), "components")
        drop_stage(now)
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", "v"))


def extend_components(known: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of the nodes whose component new edges change, and of new nodes.

    known: (node, component), as connected_components gives it for the edges before.  The new edges are drawn between the known components of
    their ends, and only this smaller graph is solved; of the known rows those of merged components are returned, with the smaller component.
    """
    new = edges.where(f"`{src}` IS NOT NULL AND `{dst}` IS NOT NULL AND `{src}` != `{dst}`").select(F.col(src).alias("u"), F.col(dst).alias("v"))
    new = stage(new.distinct(), "new-edges")
    ends = stage(new.select(F.col("u").alias("node")).union(new.select("v")).distinct(), "ends")
    at = stage(known.join(ends, "node", "left_semi").select("node", "component"), "known-ends")
    for end in "uv":
        of = at.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        new = new.join(of, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    merged = stage(connected_components(new, "cu", "cv").select(F.col("node").alias("old"), "component"), "merged")
    moved = known.select("node", F.col("component").alias("old")).join(merged.where("old != component"), "old").select("node", "component")
    fresh = ends.join(at, "node", "left_anti").withColumnRenamed("node", "old").join(merged, "old").select(F.col("old").alias("node"), "component")
    return moved.union(fresh)


#: The partition doesn't depend on how a graph is walked; both names of the walk mean this operator.
STRATEGIES = {"dfs": connected_components, "bfs": connected_components}


def component_count(nodes: DataFrame, edges: DataFrame, node: str = "node", src: str = "src", dst: str = "dst") -> int:
    """Components of a graph, isolated nodes and ends that are not among the nodes included."""
    found = connected_components(edges, src, dst)
    loose = nodes.select(F.col(node).alias("node")).union(edges.select(src)).union(edges.select(dst)).where("node IS NOT NULL").distinct()
    return loose.join(found, "node", "left").select(F.countDistinct(F.coalesce("component", "node"))).first()[0]
