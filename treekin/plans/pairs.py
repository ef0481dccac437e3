"""Scores of pairs of submissions: trees, fingerprints and call graphs, put together.

Similarity is computed once for each pair of distinct tree shapes that stand on the two sides of a pair asked for, as fingerprints and
distances depend on the shape only.  While the tree share does not exceed the match threshold, two functions without a common fingerprint
cannot reach it, so candidates come from an inverted index.  The threshold, the sizes and the fingerprints' score give each candidate the largest
distance that would do; lower bounds of the distance, by labels and by binary branches, drop pairs beyond it, and the distance itself is
computed no further than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treekin.config import Settings
from treekin.functions.hashing import fingerprints, token_stream
from treekin.functions.scalar import clamp, round6
from treekin.operators.callgraph import call_edges, graph_shapes, graph_similarity
from treekin.operators.matching import match_groups
from treekin.operators.trees import annotated, distance_bound, shape, tree_distances
from treekin.shared import drop_stage, stage


def analyze(functions: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """functions: (submission_id, name, order_index, ast, callees).  Adds fingerprints, ast_node_count, shape and tree_id."""
    tokens = token_stream(F.col("ast"))
    return (
        functions.withColumn("fingerprints", fingerprints(tokens, settings.winnow_k, settings.winnow_window))
        .withColumn("ast_node_count", F.size("ast"))
        .withColumn("shape", shape(F.col("ast")))
        .withColumn("tree_id", F.sha2(F.to_json("shape"), 256))
    )


def asked_shapes(functions: DataFrame, others: DataFrame, pairs: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Distinct (lo, hi) of the shapes that the submissions of a pair have, lo from one side and hi from the other.

    of: (x, y), the shapes of the first and of the second side that matter; all without it.  A first side's shape is joined with the
    submissions it is asked against, not with their functions, so a pair of submissions costs its functions' number and not its square.
    """
    fa = functions.select(F.col("submission_id").alias("a"), F.col("tree_id").alias("x")).distinct()
    fb = others.select(F.col("submission_id").alias("b"), F.col("tree_id").alias("y")).distinct()
    against = pairs.select("a", "b").join(fa, "a").select("x", "b").distinct()
    found = against.join(fb, "b") if of is None else of.join(fb, "y").join(against, ["x", "b"], "left_semi")
    return found.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct()


def shape_pairs(functions: DataFrame, others: DataFrame, pairs: DataFrame, shapes: DataFrame, settings: Settings) -> DataFrame:
    """(a, b, winnow) of different shapes, a < b, that stand on both sides of an asked pair and whose score might reach the threshold.

    shapes: (tree_id, elements, n, tree).  Both sides' fingerprints are joined with each other, never one side's with its own.
    """
    prints = shapes.select("tree_id", F.size("elements").cast("long").alias("k"), F.explode("elements").alias("e"))
    sides = []
    for df, name in ((functions, "x"), (others, "y")):
        mine = df.select("tree_id").distinct()
        sides.append(prints.join(mine, "tree_id", "left_semi").select(F.col("tree_id").alias(name), F.col("k").alias(f"k{name}"), "e"))
    common = sides[0].join(sides[1], "e").where("x != y").groupBy("x", "y", "kx", "ky").agg(F.count(F.lit(1)).alias("shared"))
    scored = common.select("x", "y", (F.col("shared") / (F.col("kx") + F.col("ky") - F.col("shared"))).alias("winnow"))
    both = scored.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "winnow").distinct()
    if settings.ted_share <= settings.match_threshold:
        asked = asked_shapes(functions, others, pairs, scored.select("x", "y"))
        out = asked.join(both, ["lo", "hi"])
    else:
        out = asked_shapes(functions, others, pairs).where("lo != hi").join(both, ["lo", "hi"], "left").withColumn("winnow", F.coalesce("winnow", F.lit(0.0)))
    return out.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "winnow")


def bounded_pairs(candidates: DataFrame, shapes: DataFrame, settings: Settings) -> DataFrame:
    """candidates (a, b, winnow) with most, the largest distance with which the score reaches the threshold; those that a lower bound of
    the distance rules out are gone: sizes alone first, then labels and binary branches."""
    share, least = settings.ted_share, settings.match_threshold
    for side in "ab":
        candidates = candidates.join(shapes.select(F.col("tree_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("tree").alias(f"t_{side}")), side)
    total = F.col("n_a") + F.col("n_b")
    # share * (1 - distance / total) + (1 - share) * winnow >= least; without a share of trees any distance will do
    most = F.floor(total * (1 - (F.lit(least) - (1 - share) * F.col("winnow")) / share) + 1e-6) if share > 0 else F.when((1 - share) * F.col("winnow") >= least - 1e-9, total).otherwise(-1)
    rows = candidates.withColumn("most", F.least(most, total).cast("int")).where((F.col("most") >= 0) & (F.abs(F.col("n_a") - F.col("n_b")) <= F.col("most")))
    return rows.where(distance_bound(F.col("t_a"), F.col("t_b")) <= F.col("most")).select("a", "b", "winnow", "most")


def shape_scores(functions: DataFrame, others: DataFrame, pairs: DataFrame, settings: Settings) -> DataFrame:
    """(x, y, ted, winnow, combined) of shapes that stand on the two sides of asked pairs and reach the threshold, in both directions."""
    every = functions if others is functions else functions.select("tree_id", "shape", "fingerprints").union(others.select("tree_id", "shape", "fingerprints"))
    shapes = every.groupBy("tree_id").agg(F.first("shape").alias("shape"), F.first("fingerprints").alias("elements"))
    shapes = stage(shapes.select("tree_id", "elements", F.size("shape").alias("n"), annotated(F.col("shape")).alias("tree")), "shapes")
    share, least = settings.ted_share, settings.match_threshold
    kept = stage(bounded_pairs(shape_pairs(functions, others, pairs, shapes, settings), shapes, settings).repartition("a", "b"), "shape-pairs")
    ted = tree_distances(shapes, kept.select("a", "b", "most")).where("ted IS NOT NULL").select("a", "b", "ted")
    scored = kept.select("a", "b", "winnow").join(ted, ["a", "b"]).withColumn("combined", share * F.col("ted") + (1 - share) * F.col("winnow")).where(F.col("combined") >= least)
    scored = stage(scored, "shape-scores")
    drop_stage(kept)
    both = scored.select(F.col("a").alias("x"), F.col("b").alias("y"), "ted", "winnow", "combined")
    both = both.union(scored.select("b", "a", "ted", "winnow", "combined"))
    itself = shapes.select(F.col("tree_id").alias("x"), F.col("tree_id").alias("y"), F.lit(1.0), F.lit(1.0), F.lit(share * 1.0 + (1 - share) * 1.0)).where(F.lit(1.0) >= least)
    return both.union(itself)


def function_matches(functions: DataFrame, others: DataFrame, pairs: DataFrame, settings: Settings) -> DataFrame:
    """The aligned functions of each pair (a, b): a in functions, b in others, both analyzed."""
    scores = shape_scores(functions, others, pairs, settings)
    fa = functions.select(F.col("submission_id").alias("a"), F.col("order_index").cast("long").alias("left"), F.col("tree_id").alias("x"))
    fb = others.select(F.col("submission_id").alias("b"), F.col("order_index").cast("long").alias("right"), F.col("tree_id").alias("y"))
    edges = fa.join(scores, "x").join(fb, "y").join(pairs.select("a", "b"), ["a", "b"], "left_semi")
    found = match_groups(edges.withColumnRenamed("combined", "weight").withColumn("similarity", F.col("weight")), ["a", "b"], ("similarity", "ted", "winnow"))
    return found.select(
        "a", "b", F.col("left").cast("int").alias("index_a"), F.col("right").cast("int").alias("index_b"),
        round6("similarity").alias("similarity"), round6("ted").alias("ted_similarity"), round6("winnow").alias("winnow_similarity"),
    )


def submission_shapes(functions: DataFrame) -> DataFrame:
    """(submission_id, n, graph): the number of functions and the shape of the call graph of each submission."""
    counts = functions.groupBy("submission_id").agg(F.count(F.lit(1)).alias("n"))
    shapes = graph_shapes(functions.select("submission_id", "name"), call_edges(functions))
    return stage(counts.join(shapes, "submission_id").select("submission_id", "n", F.struct("degrees", "n_nodes", "n_edges", "n_components").alias("graph")), "call-graphs")


def compare(functions: DataFrame, pairs: DataFrame, settings: Settings = Settings(), others: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """functions (and others): analyzed; pairs: (a, b).  The scores of all pairs, and their aligned functions.

    Functions of submissions in no pair are left out before anything is scored.  A pair whose submissions have no functions at all
    scores 1.
    """
    of = lambda side: pairs.select(F.col(side).alias("submission_id"))
    if others is None:
        functions = others = functions.join(of("a").union(of("b")).distinct(), "submission_id", "left_semi")
    else:
        functions = functions.join(of("a").distinct(), "submission_id", "left_semi")
        others = others.join(of("b").distinct(), "submission_id", "left_semi")
    matches = stage(function_matches(functions, others, pairs, settings), "matches")
    # similarities have six places: as whole millionths their sum is exact, in whatever order they come
    total = lambda c: (F.sum(F.round(F.col(c) * 1e6).cast("long")) / 1e6).alias(c.replace("similarity", "sum"))
    sums = matches.groupBy("a", "b").agg(total("ted_similarity"), total("winnow_similarity"), F.count(F.lit(1)).alias("aligned_function_count"))
    rows = pairs.select("a", "b").join(sums, ["a", "b"], "left")
    known = submission_shapes(functions)
    for side, df in (("a", known), ("b", known if others is functions else submission_shapes(others))):
        rows = rows.join(df.select(F.col("submission_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("graph").alias(f"g_{side}")), side, "left")
    none = F.struct(F.create_map().cast("map<string,bigint>").alias("degrees"), *[F.lit(0).cast("long").alias(c) for c in ("n_nodes", "n_edges", "n_components")])
    rows = rows.withColumn("g_a", F.coalesce("g_a", none)).withColumn("g_b", F.coalesce("g_b", none))
    most = F.greatest(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0)))
    part = lambda c: F.when(most == 0, F.lit(1.0)).otherwise(F.coalesce(c, F.lit(0.0)) / most)
    rows = rows.select("a", "b", part("ted_sum").alias("ted"), part("winnow_sum").alias("winnow"), graph_similarity(F.col("g_a"), F.col("g_b")).alias("graph"), F.coalesce("aligned_function_count", F.lit(0)).alias("aligned_function_count"))
    w = settings.weights
    overall = clamp(w[0] * F.col("ted") + w[1] * F.col("winnow") + w[2] * F.col("graph"))
    scores = rows.select("a", "b", round6(overall).alias("overall_score"), round6("ted").alias("ted_score"), round6("winnow").alias("winnow_score"), round6("graph").alias("callgraph_score"), "aligned_function_count")
    return scores, matches
