"""What is stored and grows: postings of shapes, components, clusters by rows, lookups of new submissions."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.test_engine import FUNCTIONS, _trees_of
from treekin.config import Settings
from treekin.operators.components import connected_components, extend_components
from treekin.plans.cohort import cluster_members, cluster_nodes, cluster_summaries, clusters
from treekin.plans.linked import Components
from treekin.plans.pairs import analyze
from treekin.plans.postings import Postings
from treekin.plans.store import Store, page_after
from treekin.streaming.ingest import compare_new, similar_new


def _partition(rows):
    return {(r["node"], r["component"]) for r in rows.collect()}


def _edges(spark, pairs, kind="long"):
    return spark.createDataFrame(pairs, f"src {kind}, dst {kind}")


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_grow_with_their_edges(spark, tmp_path, kind):
    rng, held, every = random.Random(5), Components(spark, f"{tmp_path}/held", kind), []
    assert held.read().count() == 0
    for batch in range(6):
        new = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(12)] + [(None, 3), (70, 70)]
        if kind == "string":
            new = [tuple(None if x is None else f"n{x}" for x in p) for p in new]
        every += new
        held.add(_edges(spark, new, kind))
        want = _partition(connected_components(_edges(spark, every, kind)))
        assert _partition(held.read()) == want
        if batch == 3:
            held.compact()
            assert len(held.parts.folders()) == 1 and _partition(held.read()) == want
    n = len(held.parts.folders())
    assert held.add(_edges(spark, every, kind)).count() == 0 and len(held.parts.folders()) == n
    again = Components(spark, f"{tmp_path}/held", kind)
    assert _partition(again.read()) == want


def test_only_what_edges_change_is_written(spark, tmp_path):
    known = connected_components(_edges(spark, [(1, 2), (2, 3), (10, 11), (20, 21)]))
    assert _partition(extend_components(known, _edges(spark, [(11, 3), (30, 31)]))) == {(10, 1), (11, 1), (30, 30), (31, 30)}
    assert not extend_components(known, _edges(spark, [])).count()


def test_a_lost_job_is_not_read(spark, tmp_path):
    held = Components(spark, f"{tmp_path}/held")
    held.add(_edges(spark, [(1, 2)]))
    (tmp_path / "held" / "000007-x").mkdir()
    spark.createDataFrame([(2, 0)], "node long, component long").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{tmp_path}/held/000000--y")
    assert _partition(held.read()) == {(1, 1), (2, 1)}
    held.add(_edges(spark, [(2, 3)]))
    assert _partition(held.read()) == {(1, 1), (2, 1), (3, 1)}


def test_members_of_clusters_are_rows(spark):
    scores = spark.createDataFrame([(5, 4, 0.9), (4, 9, 0.8), (1, 2, 0.75), (1, 4, 0.7), (7, 8, 1.0)], "a long, b long, overall_score double")
    names = spark.createDataFrame([(i, f"n{i}") for i in range(1, 9)], "id long, name string")
    member = cluster_nodes(scores)
    rows = [tuple(r) for r in cluster_members(member, names).orderBy("component", "place").collect()]
    assert rows == [(1, 1, 1, "n1"), (1, 2, 2, "n2"), (4, 1, 4, "n4"), (4, 2, 5, "n5"), (4, 3, 9, None), (7, 1, 7, "n7"), (7, 2, 8, "n8")]
    said = [tuple(r) for r in cluster_summaries(scores, member).orderBy("rank").collect()]
    assert said == [(4, 3, 0.85, 1), (7, 2, 1.0, 2), (1, 2, 0.75, 3)]
    nested = {r["component"]: ([tuple(m) for m in r["members"]], r["size"], r["average_similarity"], r["rank"]) for r in clusters(scores, names).collect()}
    assert nested == {c: ([x[2:] for x in rows if x[0] == c], n, s, k) for c, n, s, k in said}
    none = scores.where("a < 0")
    assert not cluster_members(cluster_nodes(none), names).count() and not cluster_summaries(none, cluster_nodes(none)).count()


def _shapes(spark, sets):
    return spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "tree_id string, fingerprints array<long>")


def test_postings(spark, tmp_path):
    rng = random.Random(11)
    sets = {f"t{i}": {rng.randint(0, 40) for _ in range(rng.randint(0, 12))} for i in range(40)}
    held = Postings(spark, f"{tmp_path}/it's", buckets=5)
    assert not held.probe(_shapes(spark, sets)).count()
    for start in range(0, 40, 10):
        part = {k: sets[k] for k in list(sets)[max(0, start - 3) : start + 10]}  # three come again
        held.add(_shapes(spark, part))
    assert held.shapes().count() == 40 and len(held.parts.folders()) == 4
    asked = {**{k: sets[k] for k in ("t1", "t9")}, "new": {1, 2, 3, 77}}
    want = {(x, y, len(s & t) / len(s | t)) for x, s in sets.items() for y, t in asked.items() if s & t}
    assert {tuple(r) for r in held.probe(_shapes(spark, asked)).collect()} == want
    held.compact()
    assert len(held.parts.folders()) == 1 and held.shapes().count() == 40
    assert {tuple(r) for r in Postings(spark, f"{tmp_path}/it's").probe(_shapes(spark, asked)).collect()} == want
    assert not held.probe(_shapes(spark, {})).count()


def test_postings_stay_where_they_are(spark, tmp_path):
    """Without a broadcast the new side is shuffled into the postings' buckets, however many partitions a shuffle has otherwise."""
    held = Postings(spark, f"{tmp_path}/p", buckets=8)
    held.add(_shapes(spark, {f"t{i}": {i, i + 1} for i in range(50)}))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(before, ("-1", "false", "200")):
            spark.conf.set(k, v)
        plan = held.probe(_shapes(spark, {"n": {3, 4, 5}}))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    join = plan.index("SortMergeJoin")
    side = plan[join:].split("Exchange hashpartitioning(fingerprint")
    assert len(side) == 2 and "SelectedBucketsCount: 8 out of 8" in plan and re.search(r"hashpartitioning\(fingerprint#\d+L, 8\)", plan)


OLD, LATER = datetime.datetime(2020, 1, 1), datetime.datetime(2021, 1, 1)


def _stored(spark, path, trees, new, settings):
    store = Store(spark, path, settings)
    functions = analyze(spark.createDataFrame(trees, FUNCTIONS), settings)
    ids = sorted({t[0] for t in trees}) + [900, 901]  # the last two have no functions
    for some, when in (([i for i in ids if i not in new], OLD), (new, LATER)):
        store.adopt("functions", functions.where(F.col("submission_id").isin(some)))
        store.adopt("submissions", spark.createDataFrame([(i, "w", when) for i in some], "id long, workspace string, created_at timestamp"))
    return store


@pytest.mark.parametrize("settings", [Settings(), Settings(match_threshold=0.7, weight_callgraph=0.0), Settings(match_threshold=0.4)])
def test_new_submissions_find_all_that_are_similar(spark, tmp_path, settings, monkeypatch):
    import treekin.streaming.ingest as plan

    rng = random.Random(23)
    trees = _trees_of(rng, 24)
    for i, j in ((20, 2), (21, 2), (22, 21), (23, 5)):  # copies, one with a function more and one with a function less
        trees = [t for t in trees if t[0] != i] + [(i, *t[1:]) for t in trees if t[0] == j]
    trees += [(21, "more", 3, trees[0][3], []), (23, "same", 3, trees[3][3], [])]
    trees = [t for t in trees if (t[0], t[2]) != (22, 1)]
    store = _stored(spark, f"{tmp_path}/s", trees, [20, 21, 22, 23, 901], settings)
    store.adopt("submissions", spark.createDataFrame([(77, "other", LATER)], "id long, workspace string, created_at timestamp"))
    since, seen = datetime.datetime(2020, 6, 1), []
    real = plan.compare
    every = {tuple(r) for r in compare_new(store, "w", since).collect()}
    assert all(r[1] in (20, 21, 22, 23, 901) and r[0] != 77 for r in every) and len(every) == 21 * 5 + 10
    monkeypatch.setattr(plan, "compare", lambda f, pairs, *rest: seen.append(pairs.count()) or real(f, pairs, *rest))
    for at_least in (None, 0.6):
        found = {tuple(r) for r in similar_new(store, "w", since, at_least).collect()}
        bound = settings.cluster_threshold if at_least is None else at_least
        assert found == {r for r in every if r[2] >= bound} and {(2, 20), (900, 901)} <= {r[:2] for r in found}
    if settings.match_threshold >= 0.6:
        assert max(seen) < len(every)


def test_postings_come_with_stored_submissions(spark, tmp_path):
    store, kind = Store(spark, f"{tmp_path}/s"), "id long, name string, filename string, source_code string"
    code = "int f(int a) { while (a > 3) { a = g(a - 1); } return a; }"
    store.add_submissions("w", spark.createDataFrame([(1, "a", "a.c", code)], kind))
    store.add_submissions("w", spark.createDataFrame([(2, "b", "b.c", code.replace("a", "b"))], kind))
    assert store.postings().shapes().count() == store.table("functions").select("tree_id").distinct().count()
    assert [(r["a"], r["b"], r["overall_score"]) for r in similar_new(store, "w", OLD).collect()] == [(1, 2, 1.0)]


def test_pages_by_cursor(spark, tmp_path):
    """All pages give every row once, in the order of the offsets; later files are left out by their statistics."""
    store, day = Store(spark, f"{tmp_path}/s"), lambda d: datetime.datetime(2020, 1, 1) + datetime.timedelta(days=d)
    kind = "id long, workspace string, name string, created_at timestamp"
    for start in range(0, 30, 6):  # a folder for each six days; ids tie on a day, and run against time
        store.adopt("submissions", spark.createDataFrame([(100 * (9 - start // 6) + i, "w", "x", day(start + i // 2)) for i in range(6)], kind))
    store.adopt("submissions", spark.createDataFrame([(i, "w", "x", None) for i in range(3)] + [(999, "other", "x", day(1))], kind))
    store.adopt("functions", spark.createDataFrame([(901, "f"), (901, "g"), (2, "h")], "submission_id long, name string"))
    want = [(r["id"], r["function_count"]) for r in store.list_submissions("w", limit=500).collect()]
    got, after = [], None
    while rows := store.submissions_after("w", after, 4).collect():
        got += [(r["id"], r["function_count"]) for r in rows]
        after = (rows[-1]["created_at"], rows[-1]["id"])
        store.adopt("submissions", spark.createDataFrame([(5000 + len(got), "w", "new", day(400))], kind))  # a newer one moves none
    assert got == want and len(got) == 33 and dict(got)[901] == 2
    page = page_after(store.table("submissions"), (day(2), 3), 4)
    assert page._jdf.collectAsList().size() == 4
    leaves = page._jdf.queryExecution().executedPlan().collectLeaves()
    read = sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    assert read <= 10 < store.table("submissions").count()  # of the folders that begin by that day, and those without times
    for bad in (0, 501):
        with pytest.raises(ValueError):
            store.submissions_after("w", None, bad)
