"""Streaming ingest: each micro-batch of submissions is stored; what is new is compared when it is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treekin.plans.pairs import compare
from treekin.plans.store import Store
from treekin.shared import drop_stage, stage


def ingest(stream: DataFrame, store: Store, workspace: str, checkpoint: str, **trigger):
    """stream: (id, name, filename, source_code).  Starts the query and returns it.  A batch that is run again adds nothing twice."""

    def one(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.add_submissions(workspace, batch)  # known ids are rejected

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _new_and_all(store: Store, workspace: str, since) -> tuple[DataFrame, DataFrame]:
    """(a, t) of all submissions of the workspace, and (b, u) of those stored after `since`."""
    rows = store.table("submissions").where(F.col("workspace") == workspace).select("id", "created_at")
    return rows.select(F.col("id").alias("a"), F.col("created_at").alias("t")), rows.where(F.col("created_at") > F.lit(since)).select(F.col("id").alias("b"), F.col("created_at").alias("u"))


_EARLIER = "struct(t, a) < struct(u, b)"


def compare_new(store: Store, workspace: str, since) -> DataFrame:
    """Scores of all pairs with a submission stored after `since`; the earlier one is side a.  Stored submissions are not compared with each
    other, but the result has a row for each of them and each new one: similar_new gives those that matter."""
    old, new = _new_and_all(store, workspace, since)
    pairs = old.join(new, F.expr(_EARLIER)).select("a", "b")
    functions = store.table("functions")
    return compare(functions, pairs, store.settings, functions)[0]


def similar_new(store: Store, workspace: str, since, at_least: float | None = None) -> DataFrame:
    """Of the pairs of compare_new those with a score of at_least (the clusters' threshold) or more; no other pair is made.

    A pair's score is at most the call graph's weight and, for each aligned function, the others' weight over the larger number of functions.
    So a share of the new submission's functions must have a partner, and one of its rarest few has: these are looked up, with their shapes
    from the stored postings, and the submissions that hold such a shape are the candidates.  A shape that all submissions have is looked up
    only where nearly all functions of a new one are as frequent.  Where the settings let pairs without a common fingerprint reach the
    score, all pairs are compared.
    """
    settings = store.settings
    at_least = settings.cluster_threshold if at_least is None else at_least
    ted, winnow, graph = settings.weights
    share, least = settings.ted_share, settings.match_threshold
    need = (at_least - graph - 1e-6) / (ted + winnow) if ted + winnow else 0.0
    if need <= 0 or share > least:
        return compare_new(store, workspace, since).where(F.col("overall_score") >= at_least)
    old, new = _new_and_all(store, workspace, since)
    new = stage(new, "new-submissions")
    functions = store.table("functions")
    mine = functions.select("submission_id", "tree_id").join(old.select(F.col("a").alias("submission_id")), "submission_id", "left_semi")
    added = stage(functions.select("submission_id", "order_index", "tree_id", "fingerprints").join(new.select(F.col("b").alias("submission_id")), "submission_id", "left_semi"), "new-functions")
    # an upper bound of a pair of shapes: the tree's similarity is 1 at most
    partners = store.postings().probe(added).where(F.lit(share) + (1 - share) * F.col("winnow") >= least - 1e-9).where("x != y").select("x", "y")
    own = added.select(F.col("tree_id").alias("x"), F.col("tree_id").alias("y")).distinct()
    partners = stage(partners.union(own), "partners")
    holders = mine.groupBy(F.col("submission_id").alias("a"), F.col("tree_id").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    holders = stage(holders.join(partners.select("x").distinct(), "x", "left_semi"), "holders")
    sizes = stage(mine.groupBy(F.col("submission_id").alias("id")).agg(F.count(F.lit(1)).alias("n")), "sizes")
    often = partners.join(holders.groupBy("x").agg(F.count(F.lit(1)).alias("df")), "x").groupBy(F.col("y").alias("tree_id")).agg(F.sum("df").alias("df"))
    rare = Window.partitionBy("submission_id").orderBy("df", "tree_id", "order_index")  # a group is one program's functions
    least_n = F.greatest(F.ceil(F.col("n") * need - 1e-9), F.lit(1))
    ranked = added.join(often, "tree_id").join(sizes, F.col("id") == F.col("submission_id")).withColumn("at", F.row_number().over(rare)).where(F.col("at") <= F.col("n") - least_n + 1)
    asked = ranked.select(F.col("submission_id").alias("b"), F.col("tree_id").alias("y"), F.col("n").alias("nb")).distinct().join(new, "b")
    near = (F.least("na", "nb") >= F.lit(need) * F.greatest("na", "nb") - 1e-9) & F.expr(_EARLIER)
    found = asked.join(partners, "y").select("b", "u", "nb", "x").distinct().join(holders.select("a", "x"), "x").select("a", "b", "u", "nb").distinct()
    found = found.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(old, "a").where(near).select("a", "b")
    bare = [df.join(sizes, F.col("id") == F.col(x), "left_anti") for x, df in (("a", old), ("b", new))]  # two without any function are alike
    pairs = stage(found.union(bare[0].join(bare[1], F.expr(_EARLIER)).select("a", "b")), "similar-candidates")
    scores = compare(functions, pairs, settings, functions)[0].where(F.col("overall_score") >= at_least)
    for done in (new, added, partners, holders, sizes):
        drop_stage(done)
    return scores
