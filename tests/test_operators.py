import itertools
import random

import pytest
from pyspark.sql import functions as F

from treekin.operators import callgraph, matching, sets, trees
from treekin.operators.components import connected_components
from treekin.operators.ranking import global_rank


def test_jaccard(spark):
    rows = [([9, 8, 7, 6], [6, 9], 0.5), ([5], [], 0.0), ([], [], 1.0), ([1, 2, 3, 4, 5], [5, 4, 3, 2, 1], 1.0), ([10, 20, 30], [30, 40, 50], 0.2)]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, want double")
    for r in df.select("*", sets.jaccard_detail(F.col("a"), F.col("b")).alias("d")).collect():
        a, b = set(r["a"]), set(r["b"])
        assert r["d"].asDict() == {"score": r["want"], "intersection": len(a & b), "union": len(a | b), "size_a": len(a), "size_b": len(b)}


def test_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    data = {i: sorted({rng.randrange(12) for _ in range(rng.randrange(8))}) for i in range(60)}
    df = spark.createDataFrame(list(data.items()), "id long, elements array<long>")
    want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for (a, x), (b, y) in itertools.combinations(data.items(), 2) if set(x) & set(y)}
    assert {(r["a"], r["b"]): r["score"] for r in sets.jaccard_pairs(df).collect()} == want
    for t in (0.3, 0.5, 0.75, 1.0):
        assert {(r["a"], r["b"]): r["score"] for r in sets.similar_pairs(df, t).collect()} == {k: v for k, v in want.items() if v >= t}


def test_multiset_jaccard(spark):
    df = spark.createDataFrame([({"a": 2, "b": 1}, {"a": 1, "c": 1}, 0.25), ({}, {}, 1.0)], "x map<string,long>, y map<string,long>, want double")
    assert all(r[0] == r[1] for r in df.select("want", sets.multiset_jaccard(F.col("x"), F.col("y"))).collect())


def tree(t):
    """("root", [children]) or "leaf" to (labels, counts) in preorder."""
    if isinstance(t, str):
        return [t], [0]
    labels, counts = [t[0]], [len(t[1])]
    for c in t[1]:
        x, y = tree(c)
        labels += x
        counts += y
    return labels, counts


def distance(a, b):
    return trees.tree_distance(trees.annotate(*tree(a)), trees.annotate(*tree(b)))


TREES = [
    ("while", "while", 0), ("while", "for", 1), (("call", ["name", ("args", ["1", "2", "3"])]), ("call", ["name", ("args", ["1", "3"])]), 1),
    (("block", [("if", ["cond", "then"]), "return"]), ("block", [("if", ["cond", "then", "else"]), "return"]), 1),
    (("p", [("q", [("r", ["s"])])]), ("p", ["s"]), 2), (("sum", ["x", "y", "z"]), ("sum", ["z", "y", "x"]), 2), (("m", [("n", ["o"]), "o"]), ("m", ["o", ("n", ["o"])]), 2),
]


@pytest.mark.parametrize("a, b, want", TREES)
def test_tree_distance(a, b, want):
    assert distance(a, b) == distance(b, a) == want


def forest_distance(a, b, memo):
    """The recurrence on forests as tuples of (label, children)."""
    key = (a, b)
    if key not in memo:
        if not a or not b:
            memo[key] = sum(size(x) for x in a + b)
        else:
            (la, ca), (lb, cb) = a[-1], b[-1]
            memo[key] = min(
                forest_distance(a[:-1] + ca, b, memo) + 1, forest_distance(a, b[:-1] + cb, memo) + 1,
                forest_distance(a[:-1], b[:-1], memo) + forest_distance(ca, cb, memo) + (la != lb),
            )
    return memo[key]


def size(t):
    return 1 + sum(map(size, t[1]))


def random_tree(rng, n):
    label = rng.choice("abc")
    children, left = [], n - 1
    while left > 0:
        k = rng.randint(1, left)
        children.append(random_tree(rng, k))
        left -= k
    return (label, tuple(children))


def test_tree_distance_equals_the_recurrence():
    rng = random.Random(3)
    listed = lambda t: (t[0], [listed(c) for c in t[1]]) if t[1] else t[0]
    for _ in range(150):
        a, b = random_tree(rng, rng.randint(1, 9)), random_tree(rng, rng.randint(1, 9))
        assert distance(listed(a), listed(b)) == forest_distance((a,), (b,), {})


def test_bounded_distance():
    """The distance where it is within the bound, None beyond it, and fewer cells the lower the bound."""
    rng = random.Random(5)
    listed = lambda t: (t[0], [listed(c) for c in t[1]]) if t[1] else t[0]
    for _ in range(120):
        a, b = (trees.annotate(*tree(listed(random_tree(rng, rng.randint(1, 14))))) for _ in range(2))
        d = trees.tree_distance(a, b)
        for most in range(0, d + 3):
            assert trees.tree_distance(a, b, most) == (d if d <= most else None)
    big = [trees.annotate(*tree(listed(random_tree(rng, 150)))) for _ in range(2)]
    cells = []
    for most in (None, 150, 40, 8, 2):
        work = [0]
        found = trees.tree_distance(*big, most, work)
        assert found is None or found == trees.tree_distance(*big)
        cells.append(work[0])
    assert cells[0] >= cells[1] >= cells[2] > 4 * cells[3] > 4 * cells[4] >= 0


def test_bounds_of_the_distance(spark):
    """No bound is above the distance; binary branches tell apart what labels can't."""
    rng = random.Random(6)
    listed = lambda t: (t[0], [listed(c) for c in t[1]]) if t[1] else t[0]
    rows, want = [], []
    for i in range(150):
        x = random_tree(rng, rng.randint(1, 16))
        y = random_tree(rng, rng.randint(1, 16))
        pair = [tree(listed(t)) for t in (x, y)]
        rows.append((i, *[[(s, n) for s, n in zip(*p, strict=True)] for p in pair]))
        want.append(trees.tree_distance(*[trees.annotate(*p) for p in pair]))
    # one order of many leaves against another: the labels are the same
    leaves = ["a", "b"] * 15
    pair = [tree(("r", sorted(leaves))), tree(("r", leaves))]
    rows.append((150, *[[(s, n) for s, n in zip(*p, strict=True)] for p in pair]))
    want.append(trees.tree_distance(*[trees.annotate(*p) for p in pair]))
    kind = "array<struct<sig:string,n_children:int>>"
    df = spark.createDataFrame(rows, f"i long, x {kind}, y {kind}").select("i", trees.annotated(F.col("x")).alias("x"), trees.annotated(F.col("y")).alias("y"))
    found = {r["i"]: (r["bound"], r["labels"]) for r in df.select("i", trees.distance_bound(F.col("x"), F.col("y")).alias("bound"), (F.greatest(F.size("x.labels"), F.size("y.labels")) - F.size(F.array_intersect("x.bag", "y.bag"))).alias("labels")).collect()}
    assert all(labels <= found[i][0] <= want[i] for i, (_, labels) in found.items())
    assert found[150][1] == 0 < found[150][0]


def test_matching():
    m = matching.maximum_matching
    assert m({7: [3, 4], 8: [3]}, [7, 8], [3, 4]) == {7: 4, 8: 3}  # an augmenting path moves the first one
    assert m({7: [3], 8: [3], 9: [3]}, [7, 8, 9], [3]) == {7: 3} and m({7: []}, [7], [3]) == {} == m({}, [], [3])
    assert m({"p": ["u", "v", "w"], "q": ["u"], "r": ["u", "v"]}, ["p", "q", "r"], ["u", "v", "w"]) == {"p": "w", "q": "u", "r": "v"}
    with pytest.raises(KeyError):
        m({1: [2]}, [1], [3])


def test_groups_are_matched_one_by_one(spark):
    """Many groups in a batch, groups over several batches, null keys, and ties by weight."""
    rng = random.Random(11)
    rows = [(g if g else None, f"h{g % 3}", u, v, rng.choice([0.5, 1.0]), f"{u}-{v}") for g in range(40) for u in range(rng.randrange(6)) for v in rng.sample(range(6), rng.randrange(5))]
    df = spark.createDataFrame(rows, "g long, h string, left long, right long, weight double, note string").repartition(3)
    want = set()
    for g in {r[0] for r in rows}:
        mine = sorted((u, -w, v) for x, _, u, v, w, _ in rows if x == g)
        lists = {u: [v for x, _, v in mine if x == u] for u, _, _ in mine}
        want |= {(g, f"h{(g or 0) % 3}", u, v, f"{u}-{v}") for u, v in matching.maximum_matching(lists, list(lists), [v for _, _, v in mine]).items()}
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert {tuple(r) for r in matching.match_groups(df, ["g", "h"], ("note",)).collect()} == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert matching.match_groups(df.where("left < 0"), ["g", "h"]).count() == 0


def test_global_rank(spark):
    rng = random.Random(12)
    rows = [(i, rng.randrange(20), None if i % 9 == 0 else rng.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k long, rank double").repartition(7)
    got = global_rank(df, F.desc("k"), F.col("id"), name="place").collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == [i for i, _, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert sorted(r["place"] for r in got) == list(range(1, 501)) and global_rank(df.where("id < 0"), F.col("id"), name="place").count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_pairs_by_cells(spark, monkeypatch, kind):
    """Every pair of blocks is compared once, empty blocks too, and what is shuffled is a copy of the common elements for each block."""
    rng = random.Random(9)
    data = {i: sorted({rng.randrange(1, 60) for _ in range(rng.randrange(7))}) for i in range(40)} | {90: [None], 91: [None, 5], 92: list(range(1000, 1100))}
    made = (lambda v: v) if kind == "long" else (lambda v: None if v is None else f"w{v}")
    staged, write = {}, sets.stage
    monkeypatch.setattr(sets, "stage", lambda df, name: staged.setdefault(name, write(df, name)))
    df = spark.createDataFrame([(made(i), [made(x) for x in v]) for i, v in data.items()], f"id {kind}, elements array<{kind}>").repartition(3)
    want = []
    for (a, x), (b, y) in itertools.combinations([(made(i), v) for i, v in data.items()], 2):
        shared, union = len({*x} & {*y} - {None}), len(set(x)) + len(set(y)) - len({*x} & {*y} - {None})
        if shared:
            want.append((min(a, b), max(a, b), shared, union, shared / union))
    for cell in (20, 1 << 20):
        staged.clear()
        assert sorted(tuple(r) for r in sets.jaccard_pairs(df, cell=cell).collect()) == sorted(want)
        assert made(92) not in {r["id"] for r in staged["common-elements"].collect()}


def test_pairs_shuffle_no_copies(spark, monkeypatch):
    """However many blocks there are, each is staged once, and comparing them shuffles nothing."""
    rng = random.Random(10)
    data = {i: sorted({rng.randrange(90) for _ in range(rng.randrange(9))}) for i in range(70)}
    staged, write = {}, sets.stage
    monkeypatch.setattr(sets, "stage", lambda df, name: staged.setdefault(name, write(df, name)))
    df = spark.createDataFrame(list(data.items()), "id long, elements array<long>").repartition(3)
    found = sets.jaccard_pairs(df, cell=30)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = sorted((a, b, len(set(x) & set(y))) for (a, x), (b, y) in itertools.combinations(data.items(), 2) if set(x) & set(y))
    assert sorted(tuple(r) for r in found.select("a", "b", "n_shared").collect()) == want
    blocks = [r["block"] for r in staged["blocks"].collect()]
    assert len(blocks) == len(set(blocks)) > 10


def test_prefixes_hold_few_elements_and_rare_ones(spark, monkeypatch):
    """Only a set's prefix of hashes is shuffled, and an element that all sets have is not in it."""
    rng = random.Random(8)
    data = {i: sorted({0, *(rng.randrange(1, 400) for _ in range(rng.randrange(1, 9)))}) for i in range(120)}
    data |= {200: [], 201: [0], 202: [0, None], 203: [0, None, 7], 204: [None, 7, 0, 9]}
    staged, write = {}, sets.stage
    monkeypatch.setattr(sets, "stage", lambda df, name: staged.setdefault(name, write(df, name)))
    for kind in ("long", "string"):
        staged.clear()
        rows = [(i, v if kind == "long" else [None if x is None else str(x) for x in v]) for i, v in data.items()]
        df = spark.createDataFrame(rows, f"id long, elements array<{kind}>").repartition(3)
        want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for (a, x), (b, y) in itertools.combinations(sorted(data.items()), 2) if x and y}
        assert {(r["a"], r["b"]): r["score"] for r in sets.similar_pairs(df, 0.75).collect()} == {k: v for k, v in want.items() if v >= 0.75}
        for r in staged["prefixes"].collect():
            n = len(data[r["id"]])
            assert r["n"] == n and len(r["p"]) == n - -(-3 * n // 4) + 1
            assert kind == "string" or n < 4 or r["id"] > 199 or 0 not in r["p"]


def test_representatives(spark):
    data = [(5, [1, 2]), (3, [2, 1, 1]), (9, [12]), (4, []), (7, None), (8, [3])]
    got = sets.representatives(spark.createDataFrame(data, "id long, elements array<long>")).collect()
    assert {r["id"]: r["representative"] for r in got} == {5: 3, 3: 3, 9: 9, 4: 4, 7: 4, 8: 8}


def test_matching_is_maximum():
    rng = random.Random(5)
    for _ in range(200):
        edges = {u: rng.sample(range(6), rng.randrange(4)) for u in range(6)}
        best = max(len(c) for n in range(7) for c in itertools.combinations([(u, v) for u in edges for v in edges[u]], min(n, 6)) if len({u for u, _ in c}) == len(c) == len({v for _, v in c})) if sum(map(len, edges.values())) < 9 else None
        found = matching.maximum_matching(edges, range(6), range(6))
        assert all(v in edges[u] for u, v in found.items()) and len(set(found.values())) == len(found)
        assert best is None or len(found) == best


@pytest.mark.parametrize("edges, want", [
    ([(3, 9), (9, 4), (8, 6), (6, 6)], {3: 3, 9: 3, 4: 3, 6: 6, 8: 6}), ([], {}), ([(1, 1)], {}), ([(i, i + 1) for i in range(60)], {i: 0 for i in range(61)}),
    ([(50, 40), (40, 30), (20, 30), (11, 12), (12, 13), (13, 11), (None, 3)], {50: 20, 40: 20, 30: 20, 20: 20, 11: 11, 12: 11, 13: 11}),
])
def test_components(spark, edges, want):
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == want


def graph(spark, rows):
    df = spark.createDataFrame([(1, n, c) for n, c in rows], "submission_id long, name string, callees array<string>")
    return df, callgraph.call_edges(df)


def test_call_graph(spark):
    df, edges = graph(spark, [("read", ["parse", "fopen", "parse", "read"]), ("parse", ["emit"]), ("emit", []), ("unused", ["malloc"])])
    assert {(r["caller"], r["callee"]) for r in edges.collect()} == {("read", "parse"), ("read", "read"), ("parse", "emit")}
    nodes = df.select("submission_id", "name")
    assert {(r["in_degree"], r["out_degree"]): r["n_nodes"] for r in callgraph.degree_counts(nodes, edges).collect()} == {(1, 2): 1, (1, 1): 1, (1, 0): 1, (0, 0): 1}
    assert callgraph.component_counts(df, edges).first()["n_components"] == 2
    shape = callgraph.graph_shapes(nodes, edges).first()
    assert (shape["n_nodes"], shape["n_edges"], shape["n_components"]) == (4, 3, 2)


def test_call_graph_similarity(spark):
    named = [(k, f"{k}{n}", [f"{k}{c}" for c in calls]) for k in (1, 2) for n, calls in (("top", ("mid", "low")), ("mid", ("low",)), ("low", ()))]
    a = spark.createDataFrame(named, "submission_id long, name string, callees array<string>")
    g = [r["g"] for r in callgraph.graph_shapes(a, callgraph.call_edges(a)).select(F.struct("degrees", "n_nodes", "n_edges", "n_components").alias("g")).collect()]
    assert g[0] == g[1]
    kind = "struct<degrees:map<string,long>,n_nodes:long,n_edges:long,n_components:long>"
    rows = spark.createDataFrame([(({}, 0, 0, 0), ({}, 0, 0, 0), 1.0), (({}, 0, 0, 0), ({"0,0": 1}, 1, 0, 1), 0.2), (({"0,1": 1, "1,0": 1}, 2, 1, 1), ({"0,1": 1, "1,1": 1, "1,0": 1}, 3, 2, 1), 0.6 * 2 / 3 + 0.1 + 0.2)], f"a {kind}, b {kind}, want double")
    got = rows.select("want", callgraph.graph_similarity(F.col("a"), F.col("b")), callgraph.graph_similarity_detail(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(abs(r[0] - r[1]) < 1e-12 and r["d"]["score"] == r[1] for r in got)
    assert got[2]["d"].asDict() == {"score": got[2][1], "degree_similarity": 2 / 3, "edge_similarity": 0.5, "component_similarity": 1.0, "nodes_a": 2.0, "nodes_b": 3.0, "edges_a": 1.0, "edges_b": 2.0}
    assert got[0]["d"]["degree_similarity"] is None and got[0]["d"]["nodes_a"] == 0.0
