import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from treekin.config import Settings
from treekin.functions import scalar
from treekin.functions.scalar import percent
from treekin.operators.callgraph import component_counts
from treekin.operators.trees import annotate, tree_distance
from treekin.plans.cohort import AnalysisRequest, analyze_cohort
from treekin.plans.pairs import analyze, compare
from treekin.plans.store import Store, Transaction
from treekin.sources.normalize import each_function, functions_of, parse_functions
from treekin.sources.submissions import file_names, read_json, read_uploads

MAX = "int max(int p, int q) {\n    if (p > q) return p; // the larger one\n    return q;\n}\n"
BIGGER = "int bigger(int left, int right) {\n    if (left > right) return left;\n    return right;\n}\n"
WAIT = "void wait(void) {\n    do { tick(); } while (!done);\n}\n"
PROGRAM = "double area(double w, double h) {\n  return w * h;\n}\n\nvoid report(double w) {\n  double a = area(w, 4);\n  print(a);\n}\n"
CLONE = "// another order, other names\nvoid show(double side) {\n  double size = space(side, 4); /* four */\n  print(size);\n}\n\ndouble space(double x, double y) {\n  return x * y;\n}\n"
UNRELATED = "int count(char *s) {\n  int n = 0;\n  while (s[n]) {\n    n = n + 1;\n    if (n > 99) { break; }\n  }\n  return n;\n}\n"


def stream(source):
    return [(n["label"], n["value"]) for n in functions_of(source)[0]["ast"]]


def test_front_end():
    assert [f["name"] for f in functions_of(MAX)] == ["max"]
    assert stream(MAX) == stream(BIGGER) != stream(WAIT)
    assert ("identifier", None) in stream(MAX) and ("binary_expression", ">") in stream(MAX)
    report = next(f for f in functions_of(PROGRAM) if f["name"] == "report")
    assert report["callees"] == ["print", "area"]


def test_calls_come_last_one_first():
    source = "int f(int a[g(1)]) { h(i(j()), k(2)); if (x) { y.z(3); (*p)(4); } int inner(void) { return l(); } return (m)(5) + n(o(6)); }\nint q(void) { $ r( ; s(7); }"
    assert [(f["name"], f["callees"]) for f in functions_of(source)] == [("f", ["n", "o", "l", "h", "k", "i", "j", "g"]), ("q", ["s"])]


def test_functions_in_containers_come_after_the_others():
    source = "#ifdef A\nint a(void) { return 1; }\n#endif\n#ifdef B\nint b(void) { return 1; }\n#else\nint c(void) { return 1; }\n#endif\nint d(void) { return 1; }\n"
    assert [f["name"] for f in functions_of(source)] == ["d", "b", "c", "a"]


def test_functions_are_passed_on_as_they_are_parsed():
    """A long program is neither read whole nor kept."""
    import tracemalloc

    source = "\n".join(f"int f{i}(int a) {{ a = 1; return f{i + 1}(a); }}" for i in range(4000))
    tracemalloc.start()
    found = sum(f["order_index"] == i and f["name"] == f"f{i}" and f["callees"] == [f"f{i + 1}"] for i, f in enumerate(each_function(source)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 4000 and peak < 8 << 20


@pytest.mark.parametrize("source", ["", "   ", "int", "}}}{{{", "int f( {", "int f(void) { @@@ ; return 1; }", "x" * 10_000, "int f(void) { return " + "(" * 3000 + "1" + ")" * 3000 + "; }", "\x00é\"'"])
def test_broken_sources_do_not_raise(source):
    functions_of(source)


def test_broken_parts_keep_the_rest():
    found = functions_of("int ok(void) { $$$ ; return f(1); }\nint = 5 5;\nint also(int *p, ...) { p[1]->x.y++; do { g(*p, (char)3, sizeof(int)); } while (p && !q); switch (x) { case 1: h(); default: ; } return 0; }")
    assert [f["name"] for f in found] == ["ok", "also"] and sorted(found[1]["callees"]) == ["g", "h"]


def analyzed(spark, *sources):
    rows = spark.createDataFrame([(i + 1, s) for i, s in enumerate(sources)], "id long, source_code string")
    return analyze(parse_functions(rows)).cache()


def score(spark, a, b, settings=Settings()):
    scores, matches = compare(analyzed(spark, a, b), spark.createDataFrame([(1, 2)], "a long, b long"), settings)
    return scores.first(), matches.collect()


def test_pairs(spark):
    assert score(spark, PROGRAM, PROGRAM)[0]["overall_score"] == 1.0
    row, matches = score(spark, PROGRAM, CLONE)
    assert row["overall_score"] > 0.85 and len(matches) == 2
    row, _ = score(spark, PROGRAM, UNRELATED)
    assert row["overall_score"] == 0.03 and row["callgraph_score"] == 0.2


def test_no_candidate_is_lost_by_the_index(spark):
    """With a low threshold all function pairs are looked at; the result at the default one is the same where they agree."""
    every, _ = score(spark, PROGRAM, UNRELATED, Settings(match_threshold=0.3))
    assert every["aligned_function_count"] == 1


def cohort(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, "w", "Alice", PROGRAM, t), (2, "w", "Bob", CLONE, t), (3, "w", "Carol", UNRELATED, t), (4, "other", "Dan", PROGRAM, t)]
    return spark.createDataFrame(rows, "id long, workspace string, name string, source_code string, created_at timestamp")


def test_cohort(spark):
    report = analyze_cohort(cohort(spark), "w", AnalysisRequest((1, 2, 3, 1)))
    pairs = report.pairs.orderBy("rank").collect()
    assert len(pairs) == 3 and (pairs[0]["a"], pairs[0]["b"]) == (1, 2) and pairs[0]["overall_score"] > 0.85
    clusters = report.clusters.collect()
    assert len(clusters) == 1 and [m["submission_id"] for m in clusters[0]["members"]] == [1, 2]
    made = json.loads(report.to_json().first()["report"])
    assert (made["submission_count"], made["ai_reference_enabled"], made["ai_reference_count"], made["problem_description"], made["warnings"]) == (3, False, 0, None, [])
    assert made["highest_student_score"] == report.highest().first()[0] == pairs[0]["overall_score"] and made["ai_references"] == made["reference_results"] == made["reference_summaries"] == []
    assert [(p["submission_a_id"], p["submission_a_name"], p["submission_b_id"], p["overall_score"]) for p in made["student_pairs"]] == [(p["a"], p["name_a"], p["b"], p["overall_score"]) for p in pairs]
    assert made["student_pairs"][0]["submission_a_name"] == "Alice" and set(made["student_pairs"][0]) == {"submission_a_id", "submission_a_name", "submission_b_id", "submission_b_name", "overall_score", "ted_score", "winnow_score", "callgraph_score", "aligned_function_count"}
    assert made["clusters"] == [{"members": [{"submission_id": 1, "name": "Alice"}, {"submission_id": 2, "name": "Bob"}], "size": 2, "average_similarity": pairs[0]["overall_score"]}]
    datetime.datetime.strptime(made["generated_at"], "%Y-%m-%dT%H:%M:%SZ")
    with pytest.raises(LookupError):
        analyze_cohort(cohort(spark), "w", AnalysisRequest((1, 4)))


def test_references(spark):
    request = AnalysisRequest((1, 2, 3), True, "add two numbers", 3)
    report = analyze_cohort(cohort(spark), "w", request, provider=lambda text, n: [f"Here:\n```c\n{PROGRAM}```\nDone.", "no code at all", ""])
    best = report.reference_summary.orderBy("rank").first()
    assert best["submission_id"] == 1 and best["max_reference_score"] > 0.85 and best["best_reference_label"] == "AI Reference 1"
    assert any("AI Reference 2" in w for w in report.warnings)
    assert report.reference_source("AI Reference 1") == PROGRAM.strip() and report.reference_source("AI Reference 2") is None
    made = json.loads(report.to_json().first()["report"])
    assert made["ai_references"] == [{"label": "AI Reference 1", "source_code": PROGRAM.strip()}] and (made["ai_reference_count"], made["problem_description"]) == (1, "add two numbers")
    assert [(r["submission_id"], r["submission_name"], r["reference_label"]) for r in made["reference_results"]] == [(1, "Alice", "AI Reference 1"), (2, "Bob", "AI Reference 1"), (3, "Carol", "AI Reference 1")]
    assert made["reference_summaries"][0] == {"submission_id": 1, "submission_name": "Alice", "max_reference_score": best["max_reference_score"], "best_reference_label": "AI Reference 1"}
    assert made["reference_results"][0]["overall_score"] == best["max_reference_score"]

    def broken(text, n):
        raise RuntimeError("quota")

    report = analyze_cohort(cohort(spark), "w", request, provider=broken)
    assert any("quota" in w for w in report.warnings) and report.reference_summary.count() == 3
    with pytest.raises(ValueError):
        AnalysisRequest((), True, "  ")


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([(1, "Alice", "a.c", PROGRAM), (2, "Bob", "b.c", CLONE), (3, "Eve", "e.c", "  "), (4, "Mal", "m.c", "hello")], "id long, name string, filename string, source_code string")
    assert {(r["id"], r["reject_reason"]) for r in store.add_submissions(" w ", rows).collect()} == {(3, "empty source"), (4, "no functions")}
    assert [(r["id"], r["function_count"]) for r in store.list_submissions("w").collect()] == [(2, 2), (1, 2)]
    assert len(store.get_submission("w", 1).first()["functions"]) == 2
    first = store.compare([(1, 2)]).first()
    again = store.compare([(2, 1)]).first()
    assert first["overall_score"] > 0.85 and again["created_at"] == first["created_at"] and (again["a"], again["b"]) == (1, 2)
    forced = store.compare([(2, 1)], force=True).collect()
    assert len(forced) == 1 and (forced[0]["a"], forced[0]["b"]) == (2, 1)
    assert len(store.comparison(forced[0]["id"]).first()["matches"]) == 2
    assert store.by_submission(1).count() == 1
    with pytest.raises(ValueError):
        store.compare([(1, 1)])
    store.save_lab(" Lab 1 ", "secret", store.analyze("w"))
    with pytest.raises(ValueError):
        store.save_lab("lab 1", "x", "{}")
    assert store.unlock_lab("LAB 1", "secret")["submission_count"] == 2 and store.unlock_lab("lab 1", "no") is None and store.unlock_lab("lab", "x") is None
    lab = store.labs().first()
    assert lab["highest_student_score"] == first["overall_score"] and lab["submission_count"] == 2
    store.delete_submission("w", 1)
    assert not store.table("comparisons").count() and not store.table("matches").count() and store.table("functions").count() == 2
    assert store.ready() and store.capabilities(" ")["references_configured"] is False


def test_nothing_of_a_broken_change_stays(spark, tmp_path):
    """A crash between the tables of one change leaves the version before; the change can be made again."""
    store = Store(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([(1, "Alice", "a.c", PROGRAM)], "id long, name string, filename string, source_code string")
    write = Transaction._write

    def broken(self, name, rows):
        if name == "submissions":
            raise OSError("disk")
        return write(self, name, rows)

    Transaction._write = broken
    try:
        with pytest.raises(OSError):
            store.add_submissions("w", rows)
    finally:
        Transaction._write = write
    assert not store.table("functions").count() and not list((tmp_path / "store" / "functions").glob("part=*"))
    store.add_submissions("w", rows)
    assert store.table("functions").count() == 2 and store.table("submissions").count() == 1
    with pytest.raises(OSError), store.transaction() as t:  # two writers: the second one fails
        t.insert("labs", id="x", label="x", report="{}")
        with store.transaction() as other:
            other.insert("labs", id="y", label="y", report="{}")
    assert [r["id"] for r in store.table("labs").collect()] == ["y"]


def test_appends_read_nothing_and_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("treekin.plans.store.MERGE", 3)
    store = Store(spark, f"file://{tmp_path}/store")
    for i in range(7):
        with store.transaction() as t:
            t.insert("comparisons", id=f"c{i}", a=i, b=i + 1, overall_score=0.5)
    assert sorted(level for _, level in store._head()[1]["comparisons"]) == [0, 1, 1] and store.table("comparisons").count() == 7
    assert len(list((tmp_path / "store" / "comparisons").glob("part=*"))) <= 6  # this version and the one before
    store.delete_comparison("c3")
    assert sorted(r["id"] for r in store.table("comparisons").collect()) == ["c0", "c1", "c2", "c4", "c5", "c6"]


def test_a_pair_reads_the_functions_of_two_submissions(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = [(i, f"s{i}", "s.c", UNRELATED if i > 2 else PROGRAM) for i in range(1, 9)]
    store.add_submissions("w", spark.createDataFrame(rows, "id long, name string, filename string, source_code string"))
    seen = []

    def watched(functions, pairs, *rest):
        plan = functions._jdf.queryExecution().executedPlan().toString()
        seen.append((functions.select("submission_id").distinct().count(), "PushedFilters" in plan and "In(submission_id" in plan.replace("In(submission_id, ", "In(submission_id")))
        return compare(functions, pairs, *rest)

    monkeypatch.setattr("treekin.plans.store.compare", watched)
    assert store.compare([(1, 2), (2, 1)]).first()["overall_score"] == 1.0 and seen == [(2, True)]
    assert "PartitionFilters: [isnotnull(workspace" in store.table("submissions").where("workspace = 'w'")._jdf.queryExecution().executedPlan().toString()


def test_older_tables(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    old = spark.createDataFrame([(7, "Ann", "a.c", "int f;", 3.0)], "id int, name string, filename string, source_code string, score double")
    store.adopt("submissions", old)
    row = store.table("submissions").first()
    assert (row["id"], row["workspace"], row["language"], row["created_at"]) == (7, "legacy", "c", None) and "score" not in store.table("submissions").columns
    assert store.list_submissions("legacy").first()["function_count"] == 0


def test_uploads(spark, tmp_path):
    for name, body in (("a.c", PROGRAM.encode()), ("b.txt", b"x"), ("c.h", b""), ("d.c", b"\xff\xfe"), ("e.C", b"x" * (2 * 1024 * 1024 + 1))):
        (tmp_path / name).write_bytes(body)
    rows = read_uploads(spark, str(tmp_path))
    assert {r["filename"]: r["reject_reason"] for r in rows.collect()} == {"a.c": None, "b.txt": "extension", "c.h": "empty", "d.c": "not UTF-8", "e.C": "too large"}
    many = spark.createDataFrame([(1, "Ann", "a.c"), (2, "Ann", "b.c"), (2, "Ann", "c.c")], "batch int, typed string, filename string")
    assert {(r["filename"], r["name"]) for r in file_names(many, "typed").collect()} == {("a.c", "Ann"), ("b.c", "b.c"), ("c.c", "c.c")}


def test_requests(spark, tmp_path):
    rows = [{"name": "é" * 255, "filename": "f" * 512, "source_code": "x"}, {"name": "", "filename": "f", "source_code": "x"}, {"name": "n" * 256, "filename": "f", "source_code": "x"}, {"name": "n", "filename": "f" * 513, "source_code": "x"}, {"name": "n", "filename": "f"}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, rows)))
    got = read_json(spark, f"file://{tmp_path}/r.json").collect()
    assert [r["reject_reason"] for r in got] == [None, "name is missing", "name is too long", "filename is too long", "source_code is missing"]


def test_stream(spark, tmp_path):
    from treekin.streaming.ingest import compare_new, ingest

    store = Store(spark, f"file://{tmp_path}/store")
    kind = "id long, name string, filename string, source_code string"
    for batch in ([(1, "A", "a.c", PROGRAM)], [(2, "B", "b.c", CLONE), (1, "A", "a.c", PROGRAM)]):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        ingest(spark.readStream.schema(kind).json(f"{tmp_path}/in"), store, "w", f"{tmp_path}/cp").awaitTermination()
    assert store.table("submissions").count() == 2
    assert compare_new(store, "w", datetime.datetime(2000, 1, 1)).first()["overall_score"] > 0.85


def test_scalars(spark):
    df = spark.createDataFrame([(0.8123,), (1.0,), (0.6,), (0.2,)], "s double").select(scalar.percent(F.col("s")), scalar.risk_level(F.col("s")), scalar.risk_color(F.col("s")))
    assert [tuple(r) for r in df.collect()] == [("81.2%", "high", "#dc2626"), ("100.0%", "high", "#dc2626"), ("60.0%", "medium", "#d97706"), ("20.0%", "low", "#16a34a")]
    df = spark.createDataFrame([("x ```c\nint a;\n``` y", "int a;"), (" raw ", "raw"), ("```C++ \nq```", "q")], "s string, w string")
    assert all(a == b for a, b in df.select(scalar.fenced_code(F.col("s")), "w").collect())
    rng = random.Random(7)
    values = [None, 0.0, 1.0, 1 / 128, 1 / 640, 5e-7, 1.5e-6, 0.30000000000000004, *(k / 128 for k in range(128)), *((2 * k + 1) / 2e6 for k in rng.sample(range(10**6), 3000)), *(rng.random() * 10.0 ** -rng.randrange(9) for _ in range(3000)), 1234.5678905]
    values += [x + d * 2.0**-53 for x in ((2 * k + 1) / 2e6 for k in rng.sample(range(10**6), 500)) for d in (-1, 1)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    assert [r[0] for r in df.select(scalar.round6("x")).collect()] == [None if x is None else round(x, 6) for x in values]
    df = spark.createDataFrame([(" My Prog! ", "my_prog.c"), ("!!", "submission.c")], "s string, w string")
    assert all(a == b for a, b in df.select(scalar.filename(F.col("s")), "w").collect())
    assert [scalar.reference_count(x) for x in (None, 0, 3, 99)] == [5, 5, 3, 15]


def test_passwords():
    stored = scalar.hash_password("pw")
    import hashlib

    known = f"pbkdf2_sha256$1000$00ff${hashlib.pbkdf2_hmac('sha256', b'pw', bytes.fromhex('00ff'), 1000).hex()}"
    assert scalar.verify_password("pw", known) and scalar.verify_password("pw", known.replace("00ff", "00FF")) and not scalar.verify_password("pW", known)
    assert scalar.verify_password("pw", stored) and not scalar.verify_password("", stored) and stored != scalar.hash_password("pw")
    assert not any(scalar.verify_password("pw", x) for x in ("", "a$b", "md5$1$00$00", "pbkdf2_sha256$x$zz$1"))


def test_errors():
    class Failure(Exception):
        def __init__(self, body=None, message=None):
            super().__init__("as text")
            self.body, self.message = body, message

    cases = [(Failure(), "as text"), (Failure(None, "own"), "own"), (Failure({"message": "outer"}, "own"), "outer"), (Failure({"error": {"message": "inner"}, "message": "outer"}), "inner"), (Failure({"error": "x", "message": 3}, "own"), "own"), (ValueError("v"), "v")]
    assert [scalar.error_message(e) for e, _ in cases] == [w for _, w in cases]


def test_settings(spark):
    assert Settings().ted_share == 0.5 / 0.85 and sum(Settings(weight_ted=2).weights) == pytest.approx(1)
    assert Settings(weight_ted=0, weight_winnow=0, weight_callgraph=0).weights == (1 / 3, 1 / 3, 1 / 3)
    with pytest.raises(ValueError):
        Settings(winnow_k=0)
    spark.conf.set("treekin.match_threshold", "0.7")
    assert Settings.of(spark).match_threshold == 0.7
    spark.conf.unset("treekin.match_threshold")


def test_tree_json(spark):
    from treekin.functions.register import register
    from treekin.sources.ast_json import ast_from_json, tree_from_json, tree_to_json

    flat = [("root", None, 0, 2), ("a", "x\"é", 1, 1), ("b", None, 2, 0), ("c", None, 1, 0)]
    assert tree_to_json(flat) == '{"label": "root", "children": [{"label": "a", "value": "x\\"é", "children": [{"label": "b"}]}, {"label": "c"}]}'
    assert tree_from_json(tree_to_json(flat)) == flat
    register(spark)
    df = spark.createDataFrame([(PROGRAM,)], "source string")
    df.createOrReplaceTempView("programs")
    rows = spark.sql("SELECT f.name, f.ast, ast_to_json(f.ast) AS j FROM programs, LATERAL parse_c(source) f")
    assert [r["d"] for r in spark.sql("SELECT tree_distance(f.ast, g.ast) AS d FROM programs, LATERAL parse_c(source) f, LATERAL parse_c(source) g WHERE f.name <= g.name").collect()].count(0) == 2
    made = spark.sql("SELECT fingerprints(split('a b c d e f g h i j', ' ')) AS f, winnow(kgram_hashes(token_hashes(split('a b c d e f g h i j', ' ')), 5), 4) AS w, token_hash('identifier') AS t, jaccard(array(1L, 2L), array(2L)) AS j, round6(0.0078125D) AS r, tree_similarity(ast, ast) AS s FROM (SELECT f.ast FROM programs, LATERAL parse_c(source) f) LIMIT 1").first()
    assert made["f"] == made["w"] and (made["t"], made["j"], made["r"], made["s"]) == (348638641506766093, 0.5, 0.007812, 1.0)
    back = rows.select("ast", ast_from_json(F.col("j")).alias("again")).collect()
    assert len(back) == 2 and all(r["ast"] == r["again"] for r in back)


def test_component_count(spark):
    from treekin.operators.components import STRATEGIES, component_count

    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9)], "src long, dst long")
    assert component_count(nodes, edges) == 3 and component_count(nodes, edges.where("src < 0")) == 3
    assert STRATEGIES["dfs"](edges).collect() == STRATEGIES["bfs"](edges).collect()


def test_keys():
    assert scalar.provider_configured(" k ") and not scalar.provider_configured(" ") and not scalar.provider_configured("your-key", "your-key")
    assert scalar.workspace_token() != scalar.workspace_token()


def _trees_of(rng, n):
    """Functions of n submissions over a few statements, as analyze() takes them."""
    rows = []
    for i in range(n):
        for k in range(3):
            nodes = [("function", None, 0, 0)]
            for _ in range(rng.randint(4, 14)):
                nodes.append(("call", rng.choice("fgh"), 1, 1))
                nodes.append((rng.choice(["x", "y", "z"]), None, 2, 0))
            nodes[0] = ("function", None, 0, (len(nodes) - 1) // 2)
            rows.append((i, f"f{k}", k, nodes, [f"f{(k + 1) % 3}"] if rng.random() < 0.5 else []))
    return rows


FUNCTIONS = "submission_id long, name string, order_index int, ast array<struct<label:string,value:string,depth:int,n_children:int>>, callees array<string>"


def test_only_asked_shapes_are_measured(spark, monkeypatch):
    """Shape pairs are those of asked pairs; bounds lose none that reaches the threshold; brute force agrees."""
    import treekin.plans.pairs as plan

    rng = random.Random(17)
    functions = analyze(spark.createDataFrame(_trees_of(rng, 12), FUNCTIONS)).cache()
    listed = {(r["submission_id"], r["order_index"]): r for r in functions.collect()}
    measured = []
    real = plan.tree_distances
    monkeypatch.setattr(plan, "tree_distances", lambda shapes, pairs: measured.append({(r["a"], r["b"]) for r in pairs.collect()}) or real(shapes, pairs))
    for settings in (Settings(), Settings(match_threshold=0.4)):
        for asked in ([(0, i) for i in range(1, 12)], [(1, 2), (3, 4)]):
            measured.clear()
            pairs = spark.createDataFrame(asked, "a long, b long")
            scores = plan.shape_scores(functions, functions, pairs, settings)
            got = {(r["x"], r["y"]): r["combined"] for r in scores.collect() if r["x"] != r["y"]}
            possible, want = set(), {}
            for a, b in asked:
                for f in (listed[a, k] for k in range(3)):
                    for g in (listed[b, k] for k in range(3)):
                        if f["tree_id"] != g["tree_id"]:
                            x, y = sorted((f["tree_id"], g["tree_id"]))
                            possible.add((x, y))
                            s, t = set(f["fingerprints"]), set(g["fingerprints"])
                            n = len(f["ast"]) + len(g["ast"])
                            d = tree_distance(*[annotate([x["sig"] for x in r["shape"]], [x["n_children"] for x in r["shape"]]) for r in (f, g)])
                            combined = settings.ted_share * (1 - d / n) + (1 - settings.ted_share) * len(s & t) / len(s | t)
                            if combined >= settings.match_threshold:
                                want[x, y] = want[y, x] = combined
            assert len(measured) == 1 and measured[0] <= possible and len(measured[0]) < len(possible)
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_sides_are_kept_apart(spark):
    """Pairs of one side's own shapes are no candidates."""
    import treekin.plans.pairs as plan

    functions = analyze(spark.createDataFrame(_trees_of(random.Random(3), 9), FUNCTIONS))
    left, right = functions.where("submission_id < 8"), functions.where("submission_id = 8")
    pairs = spark.createDataFrame([(i, 8) for i in range(8)], "a long, b long")
    asked = plan.asked_shapes(left, right, pairs).collect()
    mine = {r["tree_id"] for r in right.collect()}
    assert asked and all(mine & {r["lo"], r["hi"]} for r in asked) and len(asked) <= 8 * 3 * 3


def test_component_counts_of_large_groups(spark):
    rng = random.Random(8)
    nodes = [(g, f"n{i}") for g in range(6) for i in range(rng.randint(1, 30))] + [(9, "alone")]
    names = {}
    for g, x in nodes:
        names.setdefault(g, []).append(x)
    edges = sorted({(g, rng.choice(names[g]), rng.choice(names[g])) for g in range(6) for _ in range(12)})
    want = {}
    for g, mine in names.items():
        root = {x: x for x in mine}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for _, x, y in (e for e in edges if e[0] == g):
            root[find(x)] = find(y)
        want[g] = len({find(x) for x in mine})
    n, e = spark.createDataFrame(nodes, "submission_id long, name string"), spark.createDataFrame(edges, "submission_id long, caller string, callee string")
    for most in (10**6, 25, 0):
        assert {r[0]: r[1] for r in component_counts(n, e, most=most).collect()} == want


def test_percent(spark):
    """As toFixed(1) gives it: the nearest tenth to the exact value, the larger of two."""
    from decimal import ROUND_HALF_UP, Decimal

    scores = [k / 2000 for k in range(2001)] + [0.0025, 0.1275, 1 / 3, 0.99999, 1e-9, 0.0, 1.0] + [random.Random(2).random() for _ in range(500)]
    rows = spark.createDataFrame([(s,) for s in scores], "s double").select("s", percent(F.col("s")).alias("p")).collect()
    assert all(r["p"] == f"{Decimal(r['s'] * 100).quantize(Decimal('0.1'), ROUND_HALF_UP)}%" for r in rows)


def test_requests_and_ids_are_checked_where_they_are_stored(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    code = "int f(int a) { return a + 1; }"
    kind = "id long, name string, filename string, source_code string"
    rows = [(1, "a", "a.c", code), (1, "b", "b.c", code), (2, "", "c.c", code), (3, "n" * 300, "d.c", code), (4, "e", "f" * 600, code), (None, "g", "g.c", code), (5, "h", "h.c", "int x;"), (6, "i", "i.c", None), (7, "j", "j.c", code), (7, "j", "j.c", code)]
    lost = {(r["id"], r["reject_reason"]) for r in store.add_submissions("w", spark.createDataFrame(rows, kind)).collect()}
    assert lost == {(1, "id is repeated"), (2, "name is missing"), (3, "name is too long"), (4, "filename is too long"), (None, "id is missing"), (5, "no functions"), (6, "source_code is missing"), (7, "id is repeated")}
    again = {(r["id"], r["reject_reason"]) for r in store.add_submissions("other", spark.createDataFrame([(1, "a", "a.c", code), (8, "k", "k.c", code)], kind)).collect()}
    assert again == {(1, "id is taken")}
    assert sorted((r["id"], r["name"]) for r in store.table("submissions").collect()) == [(1, "a"), (7, "j"), (8, "k")]
    assert store.table("functions").count() == 3
