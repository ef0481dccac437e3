"""Queries over the driver's tables, one for each operator, with the SQL that gives the same rows.

Tables stand in for the engine's own: a document's words are the tokens of one function, a user's events a call graph, a part's
name the leaves of a flat tree.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treekin.config import Settings
from treekin.functions import hashing, scalar
from treekin.operators import sets
from treekin.operators.callgraph import call_edges, component_counts, degree_counts, graph_shapes, graph_similarity
from treekin.operators.components import connected_components
from treekin.operators.matching import match_groups
from treekin.operators.trees import tree_distances
from treekin.plans import store
from treekin.plans.cohort import AnalysisRequest, analyze_cohort, cluster_members, cluster_nodes, cluster_summaries, clusters, ranked_pairs, reference_summary
from treekin.plans.linked import Components
from treekin.plans.migrations import migrate
from treekin.plans.pairs import analyze, compare
from treekin.plans.store import Store
from treekin.shared import drop_stage, new_path, small_batches, spread, stage, table
from treekin.sources.normalize import parse_functions
from treekin.sources.submissions import reject_reason
from treekin.streaming.ingest import similar_new


def tokens(docs: DataFrame) -> DataFrame:
    """Words between spaces and line feeds."""
    return docs.select("doc_id", F.array_remove(F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), " "), "").alias("tokens"))


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, elements): the fingerprints of every document."""
    small_batches(spark)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return tokens(docs).select(F.col("doc_id").alias("id"), hashing.fingerprints(F.col("tokens")).alias("elements"))


def token_stream(spark, sf_dir):
    """Words as nodes of a tree without values."""
    rows = tokens(table(spark, sf_dir, "documents"))
    ast = F.transform("tokens", lambda t: F.struct(t.alias("label"), F.lit(None).cast("string").alias("value")))
    return rows.select("doc_id", F.posexplode(hashing.token_stream(ast)).alias("pos", "token"))


def token_hash(spark, sf_dir):
    words = tokens(table(spark, sf_dir, "documents")).select(F.explode("tokens").alias("token")).distinct()
    return words.select("token", hashing.token_hash(F.col("token")).alias("hash"))


def kgram_hash(spark, sf_dir):
    rows = tokens(table(spark, sf_dir, "documents")).select("doc_id", hashing.token_hashes("tokens").alias("h"))
    return rows.select("doc_id", F.posexplode(hashing.kgram_hashes(F.col("h"), 5)).alias("pos", "hash"))


def winnow_fingerprints(spark, sf_dir):
    return prints(spark, sf_dir).select(F.col("id").alias("doc_id"), F.explode("elements").alias("fingerprint"))


def fingerprint_count(spark, sf_dir):
    return prints(spark, sf_dir).select(F.col("id").alias("doc_id"), hashing.fingerprint_count(F.col("elements")).cast("long").alias("n"))


def _members(spark, sf_dir):
    """The fingerprints of every document, and (id, representative)."""
    every = stage(prints(spark, sf_dir), "prints")
    return every, stage(sets.representatives(every), "members")


def _distinct_prints(spark, sf_dir):
    """(id, representative) of every document, and the fingerprints of those that represent themselves: copies make no pairs of their own."""
    every, members = _members(spark, sf_dir)
    own = stage(every.join(members.where("id = representative").select("id"), "id", "left_semi"), "own-prints")
    drop_stage(every)
    return members, own


def similar_members(spark, sf_dir):
    """Of each document the smallest one with the same fingerprints, which stands for it in the pairs."""
    return _members(spark, sf_dir)[1]


def jaccard_pairs(spark, sf_dir):
    """Of representatives; similar_members has all documents."""
    return sets.jaccard_pairs(_distinct_prints(spark, sf_dir)[1])


def similar_documents(spark, sf_dir):
    """Of representatives; similar_members has all documents."""
    return sets.similar_pairs(_distinct_prints(spark, sf_dir)[1], 0.75)


def _similar_edges(spark, sf_dir):
    """(a, b, score): the similar pairs, and each document with the one that stands for it; those without fingerprints resemble nothing."""
    members, own = _distinct_prints(spark, sf_dir)
    pairs = sets.similar_pairs(own, 0.75).select("a", "b", "score")
    full = own.where("size(elements) > 0").select(F.col("id").alias("representative"))
    copies = members.where("id != representative").join(full, "representative", "left_semi")
    return pairs.union(copies.select("representative", "id", F.lit(1.0)))


def document_components(spark, sf_dir):
    return connected_components(_similar_edges(spark, sf_dir), "a", "b")


def suspicious_clusters(spark, sf_dir):
    pairs = stage(_similar_edges(spark, sf_dir).withColumnRenamed("score", "overall_score"), "similar")
    names = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"))
    found = clusters(pairs, names, 0.75)
    return found.select("component", "size", F.array_join(F.transform("members", lambda m: m["submission_id"].cast("string")), ",").alias("ids"))


def _cluster_parts(spark, sf_dir):
    pairs = stage(_similar_edges(spark, sf_dir).withColumnRenamed("score", "overall_score"), "similar")
    return pairs, cluster_nodes(pairs, 0.75)


def cluster_averages(spark, sf_dir):
    """Size, mean score and place of each cluster of similar documents."""
    return cluster_summaries(*_cluster_parts(spark, sf_dir), 0.75)


def cluster_rows(spark, sf_dir):
    """Each member of a cluster of similar documents in a row."""
    names = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"))
    return cluster_members(_cluster_parts(spark, sf_dir)[1], names)


def grown_components(spark, sf_dir):
    """document_components, from edges that come in three batches."""
    edges = stage(_similar_edges(spark, sf_dir), "similar")
    held = Components(spark, new_path(spark, "held-components"))
    for batch in range(3):
        held.add(edges.where((F.col("a") + F.col("b")) % 3 == batch), "a", "b")
    return held.read()


def reference_best(spark, sf_dir):
    """Of each document, as a submission, the benchmark item, as a reference, with the most common fingerprints, in share of all."""
    docs = stage(prints(spark, sf_dir), "prints")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    items = stage(tokens(items).select(F.col("doc_id").alias("id"), hashing.fingerprints(F.col("tokens")).alias("elements")), "items")
    a = docs.select(F.col("id").alias("submission_id"), F.size("elements").alias("n"), F.explode("elements").alias("e"))
    b = items.select(F.col("id").alias("reference_order"), F.size("elements").alias("m"), F.explode("elements").alias("e"))
    scored = a.join(b, "e").groupBy("submission_id", "reference_order", "n", "m").agg(F.count(F.lit(1)).alias("i"))
    score = F.col("i") / (F.col("n") + F.col("m") - F.col("i"))
    scored = scored.select("submission_id", "reference_order", F.col("reference_order").cast("string").alias("reference_label"), score.alias("overall_score"))
    rows = reference_summary(docs.select("id", F.lit(None).cast("string").alias("name"), F.col("id").alias("place")), scored)
    return rows.select(F.col("submission_id").alias("doc_id"), F.col("max_reference_score").alias("score"), F.col("best_reference_label").cast("long").alias("item_id"), "rank")


def _event_graph(spark, sf_dir):
    """Nodes (user_id, name) and distinct edges (user_id, caller, callee): a user's event types, which call those that follow them."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("name"))
    after = F.lead("name").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    functions = events.select("user_id", "name", F.array_compact(F.array(after)).alias("callees"))
    return events.select("user_id", "name").distinct(), call_edges(functions, "user_id")


def call_graph_edges(spark, sf_dir):
    return _event_graph(spark, sf_dir)[1]


def degree_signature(spark, sf_dir):
    return degree_counts(*_event_graph(spark, sf_dir), "user_id")


def component_count(spark, sf_dir):
    return component_counts(*_event_graph(spark, sf_dir), "user_id").select("user_id", "n_components")


def _shapes(spark, sf_dir):
    """(user_id, g, k) of every user: the graph's shape, and the shape as a key."""
    nodes, edges = (stage(x, "graph") for x in _event_graph(spark, sf_dir))
    shapes = graph_shapes(nodes, edges, "user_id").select("user_id", F.struct("degrees", "n_nodes", "n_edges", "n_components").alias("g"))
    return shapes.withColumn("k", F.to_json("g"))


def call_graph_members(spark, sf_dir):
    """Of each user the one that stands for the graph's shape in call_graph_similarity; users of one shape have similarity 1."""
    shapes = stage(_shapes(spark, sf_dir).select("user_id", "k"), "members")
    return shapes.join(shapes.groupBy("k").agg(F.min("user_id").alias("representative")), "k").select("user_id", "representative")


def call_graph_similarity(spark, sf_dir):
    """Of all pairs of different graph shapes, each by the smallest user_id that has it; call_graph_members has all users of each."""
    shapes = _shapes(spark, sf_dir)
    distinct = shapes.groupBy("k").agg(F.min("user_id").alias("user_id"), F.first("g").alias("g"))
    distinct = stage(distinct, "shapes")
    a, b = (distinct.select(F.col("user_id").alias(x), F.col("g").alias(f"g{x}")) for x in "ab")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", graph_similarity(F.col("ga"), F.col("gb")).alias("score"))


def multiset_jaccard(spark, sf_dir):
    """Event types of each user against those of the next user id."""
    each = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = each.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    maps = stage(maps, "multisets")
    b = maps.select((F.col("user_id") - 1).alias("user_id"), F.col("m").alias("other"))
    return maps.join(b, "user_id").select("user_id", sets.multiset_jaccard(F.col("m"), F.col("other")).alias("score"))


def ted_flat(spark, sf_dir):
    """Tree distances of all pairs of part names, each a root with its characters as leaves."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("tree_id")).distinct()
    chars = F.filter(F.split("tree_id", ""), lambda c: c != "")
    root = F.struct(F.lit("root").alias("sig"), F.size(chars).alias("n_children"))
    trees = stage(names.select("tree_id", F.concat(F.array(root), F.transform(chars, lambda c: F.struct(F.concat(F.lit("c:"), c).alias("sig"), F.lit(0).alias("n_children")))).alias("shape")), "trees")
    pairs = trees.select(F.col("tree_id").alias("a")).join(trees.select(F.col("tree_id").alias("b")), F.col("a") < F.col("b"))
    return tree_distances(trees, pairs.repartition("a", "b")).select("a", "b", F.col("distance").cast("long").alias("distance"), "ted")


def ted_chains(spark, sf_dir):
    """Tree distances of all pairs of part types, each a chain with a character at every depth."""
    names = table(spark, sf_dir, "part").select(F.col("p_type").alias("tree_id")).distinct()
    chars = F.filter(F.split("tree_id", ""), lambda c: c != "")
    chain = F.transform(chars, lambda c, i: F.struct(c.alias("sig"), F.when(i < F.size(chars) - 1, 1).otherwise(0).alias("n_children")))
    trees = stage(names.select("tree_id", chain.alias("shape")), "trees")
    pairs = trees.select(F.col("tree_id").alias("a")).join(trees.select(F.col("tree_id").alias("b")), F.col("a") < F.col("b"))
    return tree_distances(trees, pairs.repartition("a", "b")).select("a", "b", F.col("distance").cast("long").alias("distance"), "ted")


def matching_size(spark, sf_dir):
    """Of each customer, open orders matched with finished ones of the same priority."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    left = orders.where("o_orderstatus = 'O'").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("left"))
    right = orders.where("o_orderstatus = 'F'").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("right"))
    edges = left.join(right, ["o_custkey", "o_orderpriority"]).withColumn("weight", F.lit(1.0))
    return match_groups(edges, ["o_custkey"]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


def list_submissions(spark, sf_dir):
    rows = store.list_with_counts(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "n_orders")
    return store.page(rows, F.desc("c_acctbal"), F.desc("c_custkey"), limit=100, offset=20).select("c_custkey", "c_name", "n_orders")


def _pairs(spark, sf_dir):
    """Comparisons: parts and suppliers that are ordered together, with a score."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return rows.agg(F.max("l_discount").alias("overall_score"))


def find_pair(spark, sf_dir):
    first = table(spark, sf_dir, "lineitem").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("x")).first()["x"]
    return store.find_pair(_pairs(spark, sf_dir), first["l_suppkey"], first["l_partkey"])


def comparisons_of(spark, sf_dir):
    return store.comparisons_of(_pairs(spark, sf_dir), 7)


def cascade_delete(spark, sf_dir):
    """What is left of the line items when the customers of the first market segment go, with their orders."""
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    segment = customers.agg(F.min("c_mktsegment").alias("c_mktsegment"))
    gone = customers.join(segment, "c_mktsegment", "left_semi").select("id")
    left = store.cascade(gone, customers, (table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey"), (table(spark, sf_dir, "lineitem"), "l_orderkey", "l_orderkey"))
    return left[-1].select("l_orderkey", "l_linenumber")


def cache_misses(spark, sf_dir):
    """Pairs of part and supplier of returned items that aren't, in either order, among those of items shipped as ordered."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), "l_returnflag")
    asked = items.where("l_returnflag = 'R'").select("a", "b").distinct()
    return store.cache_misses(asked, items.where("l_returnflag = 'N'").select("a", "b").distinct())


def label_lookup(spark, sf_dir):
    """The nation whose name is first, asked for in capitals and with white space around it."""
    name = table(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0]
    return store.label_is(table(spark, sf_dir, "nation"), f" \t{name.upper()}\n ", "n_name").select("n_nationkey", "n_name")


def comparison_matches(spark, sf_dir):
    """Of each order its line items as an array, most expensive first."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("comparison_id"), F.col("l_linenumber").alias("index_a"), F.col("l_linenumber").alias("index_b"),
        F.col("l_extendedprice").alias("similarity"), F.col("l_quantity").alias("ted_similarity"), F.col("l_discount").alias("winnow_similarity"),
    )
    rows = store.with_matches(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), items)
    return rows.select("id", F.array_join(F.transform("matches", lambda m: m["index_a"].cast("string")), ",").alias("lines"))


def best_of_group(spark, sf_dir):
    """Each customer's most expensive order, as submissions and references; the first of equal ones; none: 0 and null."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("submission_id"), F.col("o_orderkey").alias("reference_order"), F.col("o_orderkey").cast("string").alias("reference_label"), F.col("o_totalprice").alias("overall_score"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("place"))
    rows = reference_summary(customers, orders)
    return rows.select(F.col("submission_id").alias("c_custkey"), F.col("max_reference_score").alias("price"), F.col("best_reference_label").cast("long").alias("o_orderkey"), "rank")


def presentation(spark, sf_dir):
    """Risk, color, percent and names of the line items' discounts, as scores."""
    score = F.col("l_discount") * 10
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", scalar.risk_level(score).alias("risk"), scalar.risk_color(score).alias("color"), scalar.percent(score * F.col("l_extendedprice") / 100003).alias("shown"), scalar.ratio(F.col("l_discount"), F.col("l_tax")).alias("balance")
    )


def source_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalar.filename(F.concat(F.lit("  "), F.col("p_name"), F.lit(" -- "), F.col("p_type"), F.lit(" "))).alias("filename"))


def source_validation(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("n_functions", F.when(F.col("text").contains("("), 1).otherwise(0))
    return rows.select("doc_id", F.coalesce(reject_reason(F.col("text"), F.col("n_functions")), F.lit("accepted")).alias("result"))


def fenced_replies(spark, sf_dir):
    """Code blocks put around the texts of assistants come out again."""
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    fence = F.when(F.col("role") == "assistant", F.concat(F.lit("Sure:\n```C\n"), F.col("text"), F.lit("\n```\nDone."))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", scalar.fenced_code(fence).alias("code"))


def report_json(spark, sf_dir):
    """A report for each customer as JSON, and the summary that is read from it."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("submission_count"), F.max("o_totalprice").alias("highest_student_score"))
    labs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label")).join(orders, "id", "left")
    labs = labs.select("id", "label", F.current_timestamp().alias("created_at"), F.to_json(F.struct("submission_count", "highest_student_score")).alias("report"))
    return store.summary_of_reports(labs).drop("created_at")


def schema_migration(spark, sf_dir):
    """Old rows get a wider key and the workspace `legacy`; new ones keep theirs."""
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("id"), F.col("s_name").alias("name"), "s_acctbal")
    new = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("workspace"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    now = "id long, name string, workspace string"
    return migrate(old, now).union(migrate(new, now))


def rank_pairs(spark, sf_dir):
    """Part types by their share of returned items, ranked."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    by = items.groupBy("p_type").agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"), F.count(F.lit(1)).alias("n"))
    return ranked_pairs(by.withColumn("overall_score", F.col("returned") / F.col("n")), "p_type").select("rank", "p_type", "returned", "n")


def _programs(spark, sf_dir):
    """A C program for each nation: a function for each customer, longer or shorter by the customer's key, that calls the next one."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("id"), "c_custkey")
    body = F.concat(F.lit("int f"), F.col("c_custkey"), F.lit("(int a) { "), F.repeat(F.lit("a = 1; "), F.pmod("c_custkey", F.lit(4)).cast("int")), F.lit("return f"), F.col("c_custkey") + 4, F.lit("(a); }"))
    parts = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c_custkey", body.alias("body")))).alias("f"))
    return parts.select("id", F.array_join(F.transform("f", lambda x: x["body"]), "\n").alias("source_code"))


def parsed_functions(spark, sf_dir):
    found = parse_functions(_programs(spark, sf_dir))
    return found.select("submission_id", "name", F.col("order_index").cast("long").alias("order_index"), F.size("ast").cast("long").alias("n_nodes"), F.array_join("callees", ",").alias("callees"))


def parsed_call_edges(spark, sf_dir):
    return call_edges(parse_functions(_programs(spark, sf_dir)))


#: Kinds of functions for the market segments by their first letter: two statements that differ in one operator.
_STATEMENTS = {
    "A": ("a = a + 2; ", "a = a - 2; "),
    "B": ("if (a < 3) { g(a); } ", "if (a > 3) { g(a); } "),
    "F": ("while (a) { a++; } ", "while (a) { a--; } "),
    "H": ("b[a] = b[a * 2]; ", "b[a] = b[a / 2]; "),
    "M": ("do { h(a, 1); } while (a == 9); ", "do { h(a, 1); } while (a != 9); "),
}


def _family_programs(spark, sf_dir):
    """A C program for each nation: a function for each market segment, which repeats the segment's statements as its number of customers n
    tells (3 + n % 5 of the first, then 2 + n % 3 of the second; none where n % 4 = 0) and calls the next segment's function."""
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("id"), F.substring("c_mktsegment", 1, 1).alias("s")).agg(F.count(F.lit(1)).alias("n")).where("n % 4 != 0")
    kinds = list(_STATEMENTS)
    following = F.create_map(*[F.lit(x) for a, b in zip(kinds, [*kinds[1:], "Z"], strict=True) for x in (a, b)])
    one, two = (F.create_map(*[F.lit(x) for k, v in _STATEMENTS.items() for x in (k, v[i])])[F.col("s")] for i in (0, 1))
    body = F.concat(F.lit("int f"), "s", F.lit("(int a) { "), F.repeat(one, (3 + F.col("n") % 5).cast("int")), F.repeat(two, (2 + F.col("n") % 3).cast("int")), F.lit("return f"), following[F.col("s")], F.lit("(a); }"))
    return rows.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", body.alias("body")))), lambda x: x["body"]), "\n").alias("source_code"))


def _fused(spark, sf_dir):
    functions = stage(analyze(parse_functions(_family_programs(spark, sf_dir))), "functions")
    ids = functions.select("submission_id").distinct()
    pairs = ids.select(F.col("submission_id").alias("a")).join(ids.select(F.col("submission_id").alias("b")), F.col("a") < F.col("b"))
    return compare(functions, stage(pairs, "pairs"))


def fused_pairs(spark, sf_dir):
    """Scores of all pairs of programs: trees, fingerprints and call graphs put together."""
    return _fused(spark, sf_dir)[0]


def fused_matches(spark, sf_dir):
    """The functions aligned in all pairs of programs."""
    return _fused(spark, sf_dir)[1]


def similar_to_new(spark, sf_dir):
    """Programs of nations from 20 on, stored after the others, with the earlier ones that are similar; looked up in stored postings."""
    held = Store(spark, new_path(spark, "store"), Settings())
    functions = stage(analyze(parse_functions(_family_programs(spark, sf_dir))), "functions")
    stored = F.when(F.col("submission_id") < 20, F.lit("2024-01-01")).otherwise(F.lit("2024-03-01")).cast("timestamp")
    held.adopt("functions", functions)
    held.adopt("submissions", functions.select("submission_id").distinct().select(F.col("submission_id").alias("id"), F.lit("all").alias("workspace"), stored.alias("created_at")))
    return similar_new(held, "all", datetime.datetime(2024, 2, 1))


def cohort_report(spark, sf_dir):
    """What the JSON of a report on all programs says."""
    rows = _family_programs(spark, sf_dir).select("id", F.lit("all").alias("workspace"), F.concat(F.lit("n"), "id").alias("name"), "source_code", F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    report = analyze_cohort(rows, "all", AnalysisRequest()).to_json()
    at = lambda path, kind: F.get_json_object("report", path).cast(kind)
    pairs = F.from_json(F.get_json_object("report", "$.student_pairs"), "array<struct<submission_a_id:bigint,submission_b_id:bigint,overall_score:double>>")
    first = F.array_sort(F.filter(pairs, lambda p: p["overall_score"] == at("$.highest_student_score", "double")))
    found = F.size(F.from_json(F.get_json_object("report", "$.clusters"), "array<struct<size:bigint>>"))
    return report.select(
        at("$.submission_count", "long").alias("submission_count"), F.size(pairs).cast("long").alias("n_pairs"), at("$.highest_student_score", "double").alias("highest"),
        F.size(first).cast("long").alias("n_highest"), found.cast("long").alias("n_clusters"), at("$.ai_reference_enabled", "boolean").alias("ai_reference_enabled"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        token_stream, token_hash, kgram_hash, winnow_fingerprints, fingerprint_count, similar_members, jaccard_pairs, similar_documents, document_components, suspicious_clusters, reference_best,
        call_graph_edges, degree_signature, component_count, call_graph_members, call_graph_similarity, multiset_jaccard, ted_flat, ted_chains, matching_size, list_submissions, find_pair, comparisons_of, cascade_delete,
        cache_misses, label_lookup, comparison_matches, best_of_group, presentation, source_names, source_validation, fenced_replies, report_json, schema_migration, rank_pairs, parsed_functions,
        parsed_call_edges, fused_pairs, fused_matches, cohort_report, cluster_averages, cluster_rows, grown_components, similar_to_new,
    )
}

# --- the same in SQL

_POLY = "CAST(list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform({items}, lambda x: CAST(x AS HUGEINT))), lambda h, x: (h * 1000003 + x) % 2305843009213693951) AS BIGINT)"
_TOKENS = "d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\n]+'), lambda t: t <> '') AS tokens FROM {source})"
_STREAM = "s AS (SELECT doc_id, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM d)"
_HASHES = f"w AS (SELECT token, {_POLY.format(items="list_transform(string_split(token, ''), lambda c: unicode(c))")} AS th FROM (SELECT DISTINCT token FROM s))"
_GRAMS = (
    "a AS (SELECT doc_id, pos, list(th) OVER p AS ths, count(*) OVER (PARTITION BY doc_id) AS n FROM s JOIN w USING (token) "
    "WINDOW p AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)), "
    f"g AS (SELECT doc_id, pos, greatest(n - 4, 1) AS gn, {_POLY.format(items='ths')} AS kh FROM a WHERE len(ths) = 5 OR (n < 5 AND pos = 0))"
)
_PRINTS = (
    "f AS (SELECT DISTINCT doc_id, fp FROM (SELECT doc_id, pos, gn, min(kh) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS fp FROM g) WHERE pos <= greatest(gn - 4, 0))"
)


def _with(*parts: str, source: str = "documents", recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(p.replace("{source}", source) for p in parts) + " "


_ALL_PRINTS = (_TOKENS, _STREAM, _HASHES, _GRAMS, _PRINTS)
_MEMBERS = (
    "l AS (SELECT d.doc_id, list(fp ORDER BY fp) FILTER (fp IS NOT NULL) AS fps FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id)",
    "m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY fps) AS representative, fps FROM l)",
)
_JACCARD = (
    *_ALL_PRINTS, *_MEMBERS,
    "fr AS (SELECT f.doc_id, fp FROM f JOIN m USING (doc_id) WHERE doc_id = representative)",
    "n AS (SELECT doc_id, count(*) AS n FROM fr GROUP BY doc_id)",
    "i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_shared FROM fr x JOIN fr y ON x.fp = y.fp AND x.doc_id < y.doc_id GROUP BY 1, 2)",
    "j AS (SELECT a, b, n_shared, x.n + y.n - n_shared AS n_union, n_shared / (x.n + y.n - n_shared) AS score FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b)",
)
_COMPONENTS = (
    "eg AS (SELECT a AS u, b AS v FROM j WHERE score >= 0.75 UNION ALL SELECT representative, doc_id FROM m WHERE doc_id <> representative AND fps IS NOT NULL)",
    "e AS (SELECT u, v FROM eg UNION SELECT v, u FROM eg)",
    "r AS (SELECT u AS node, u AS seen FROM e UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.seen)",
    "c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)",
)
_GRAPH = (
    "ev AS (SELECT user_id, event_type AS caller, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS callee FROM events)",
    "ed AS (SELECT DISTINCT user_id, caller, callee FROM ev WHERE callee IS NOT NULL)",
    "nd AS (SELECT DISTINCT user_id, event_type AS name FROM events)",
)
_DEGREES = (
    "dg AS (SELECT nd.user_id, name, (SELECT count(*) FROM ed WHERE ed.user_id = nd.user_id AND callee = name) AS in_degree, (SELECT count(*) FROM ed WHERE ed.user_id = nd.user_id AND caller = name) AS out_degree FROM nd)",
    "sg AS (SELECT user_id, in_degree, out_degree, count(*) AS n_nodes FROM dg GROUP BY ALL)",
)
_REACH = (
    "un AS (SELECT user_id, caller AS u, callee AS v FROM ed WHERE caller <> callee UNION SELECT user_id, callee, caller FROM ed WHERE caller <> callee)",
    "rc AS (SELECT user_id, name, name AS seen FROM nd UNION SELECT rc.user_id, rc.name, un.v FROM rc JOIN un ON un.user_id = rc.user_id AND un.u = rc.seen)",
    "cc AS (SELECT user_id, count(DISTINCT root) AS n_components FROM (SELECT user_id, name, min(seen) AS root FROM rc GROUP BY ALL) GROUP BY user_id)",
)
#: Of the programs of fused_pairs, preorders: what stands before and after the statements, and each kind's statements.
_BEFORE = "function_definition primitive_type function_declarator identifier parameter_list parameter_declaration primitive_type identifier compound_statement".split()
_AFTER = "return_statement call_expression identifier argument_list identifier".split()
_PREORDERS = {
    "A": ("expression_statement assignment_expression:= identifier binary_expression:{} identifier number_literal:NUM", "+", "-"),
    "B": ("if_statement parenthesized_expression binary_expression:{} identifier number_literal:NUM compound_statement expression_statement call_expression identifier argument_list identifier", "<", ">"),
    "F": ("while_statement parenthesized_expression identifier compound_statement expression_statement update_expression:{} identifier", "++", "--"),
    "H": ("expression_statement assignment_expression:= subscript_expression identifier identifier subscript_expression identifier binary_expression:{} identifier number_literal:NUM", "*", "/"),
    "M": ("do_statement compound_statement expression_statement call_expression identifier argument_list identifier number_literal:NUM parenthesized_expression binary_expression:{} identifier number_literal:NUM", "==", "!="),
}


def _round6(x: str) -> str:
    """Of a column of doubles: half to even on the exact binary value, which round() does not give."""
    high = f"(floor({x} * 67108864::DOUBLE) / 67108864::DOUBLE)"
    middle = f"(floor(({x} - {high}) * 1125899906842624::DOUBLE) / 1125899906842624::DOUBLE)"
    k = f"floor({x} * 1e6)"
    side = f"((({high} * 2e6 - (2 * {k} + 1)) + {middle} * 2e6) + ({x} - {high} - {middle}) * 2e6)"
    return f"CASE WHEN {side} > 0 THEN {k} + 1 WHEN {side} < 0 THEN {k} ELSE {k} + {k} % 2 END / 1e6"


_listed = lambda tokens: "[" + ", ".join(f"'{t}'" for t in tokens) + "]"
_FUSED = (
    "st AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {_listed(t.format(x).split())}, {_listed(t.format(y).split())})" for k, (t, x, y) in _PREORDERS.items()) + ") AS t(s, one, two))",
    "fn AS (SELECT CAST(c_nationkey AS BIGINT) AS id, substr(c_mktsegment, 1, 1) AS s, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) % 4 <> 0)",
    "fx AS (SELECT id, s, instr('ABFHM', s) AS k, 3 + n % 5 AS i, 2 + n % 3 AS j, row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS place FROM fn)",
    "sh AS (SELECT DISTINCT s, k * 100 + i * 10 + j AS doc_id, i, j FROM fx)",
    f"d AS (SELECT doc_id, s, i, j, len(one) AS w, list_concat(list_concat({_listed(_BEFORE)}, flatten(list_transform(range(i), lambda x: one))), list_concat(flatten(list_transform(range(j), lambda x: two)), {_listed(_AFTER)})) AS tokens FROM sh JOIN st USING (s))",
    _STREAM, _HASHES, _GRAMS, _PRINTS,
    # of functions of one kind: nodes that no relabelling or deletion of whole statements saves
    "dd AS (SELECT x.doc_id AS x, y.doc_id AS y, len(x.tokens) AS nx, len(y.tokens) AS ny, "
    f"greatest(nx, ny) - ({len(_BEFORE) + len(_AFTER)} + (x.w - 1) * least(x.i + x.j, y.i + y.j) + least(x.i, y.i) + least(x.j, y.j)) AS distance, "
    "(SELECT count(*) FROM f p JOIN f q USING (fp) WHERE p.doc_id = x.doc_id AND q.doc_id = y.doc_id) AS shared, "
    "(SELECT count(*) FROM f p WHERE p.doc_id = x.doc_id) + (SELECT count(*) FROM f q WHERE q.doc_id = y.doc_id) AS both_ FROM d x JOIN d y USING (s))",
    "sc AS (SELECT *, share * ted + (1 - share) * winnow AS combined FROM (SELECT x, y, 1 - distance::DOUBLE / (nx + ny) AS ted, shared::DOUBLE / (both_ - shared) AS winnow, 0.5::DOUBLE / 0.85::DOUBLE AS share FROM dd))",
    f"ma AS (SELECT p.id AS a, q.id AS b, p.place AS index_a, q.place AS index_b, {_round6('combined')} AS similarity, {_round6('ted')} AS ted_similarity, {_round6('winnow')} AS winnow_similarity "
    "FROM fx p JOIN fx q ON p.s = q.s AND p.id < q.id JOIN sc ON x = p.k * 100 + p.i * 10 + p.j AND y = q.k * 100 + q.i * 10 + q.j WHERE combined >= 0.6)",
    "gd AS (SELECT x.id, (SELECT count(*) FROM fx y WHERE y.id = x.id AND y.k = x.k - 1) AS din, (SELECT count(*) FROM fx y WHERE y.id = x.id AND y.k = x.k + 1) AS dout FROM fx x)",
    "gs AS (SELECT id, din, dout, count(*) AS n FROM gd GROUP BY ALL)",
    "gn AS (SELECT id, count(*) AS nodes, sum(dout) AS edges, count(*) - sum(dout) AS parts FROM gd GROUP BY id)",
    "pp AS (SELECT x.id AS a, y.id AS b, x.nodes AS na, y.nodes AS nb, x.edges AS ea, y.edges AS eb, x.parts AS ca, y.parts AS cb FROM gn x JOIN gn y ON x.id < y.id)",
    "ks AS (SELECT a, b, din, dout, sum(CASE WHEN side = 0 THEN n ELSE 0 END) AS u, sum(CASE WHEN side = 1 THEN n ELSE 0 END) AS v FROM (SELECT a, b, din, dout, n, 0 AS side FROM pp JOIN gs ON id = a UNION ALL SELECT a, b, din, dout, n, 1 FROM pp JOIN gs ON id = b) GROUP BY ALL)",
    "kd AS (SELECT a, b, sum(least(u, v)) / sum(greatest(u, v)) AS degree FROM ks GROUP BY a, b)",
    "ag AS (SELECT a, b, sum(CAST(round(ted_similarity * 1e6) AS BIGINT)) / 1e6 AS t, sum(CAST(round(winnow_similarity * 1e6) AS BIGINT)) / 1e6 AS w, count(*) AS n FROM ma GROUP BY a, b)",
    "fo AS (SELECT a, b, coalesce(t, 0) / greatest(na, nb) AS t, coalesce(w, 0) / greatest(na, nb) AS w, coalesce(n, 0) AS n, "
    "0.6::DOUBLE * degree + 0.2::DOUBLE * CASE WHEN ea = 0 AND eb = 0 THEN 1.0 ELSE least(ea, eb) / greatest(ea, eb) END + 0.2::DOUBLE * (least(ca, cb) / greatest(ca, cb)) AS g FROM pp JOIN kd USING (a, b) LEFT JOIN ag USING (a, b))",
    f"fu AS (SELECT a, b, {_round6('o')} AS overall_score, {_round6('t')} AS ted_score, {_round6('w')} AS winnow_score, {_round6('g')} AS callgraph_score, n AS aligned_function_count "
    "FROM (SELECT *, greatest(0.0, least(1.0, 0.5::DOUBLE * t + 0.35::DOUBLE * w + 0.15::DOUBLE * g)) AS o FROM fo))",
)
_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_PAIRS = "pr AS (SELECT l_partkey AS a, l_suppkey AS b, max(l_discount) AS overall_score FROM lineitem GROUP BY ALL)"

ORACLES = {
    "token_stream": _with(_TOKENS, _STREAM) + "SELECT doc_id, CAST(pos AS INTEGER) AS pos, token FROM s",
    "token_hash": _with(_TOKENS, _STREAM, _HASHES) + "SELECT token, th AS hash FROM w",
    "kgram_hash": _with(_TOKENS, _STREAM, _HASHES, _GRAMS) + "SELECT doc_id, CAST(pos AS INTEGER) AS pos, kh AS hash FROM g",
    "winnow_fingerprints": _with(*_ALL_PRINTS) + "SELECT doc_id, fp AS fingerprint FROM f",
    "fingerprint_count": _with(*_ALL_PRINTS) + "SELECT d.doc_id, count(fp) AS n FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id",
    "similar_members": _with(*_ALL_PRINTS, *_MEMBERS) + "SELECT doc_id AS id, representative FROM m",
    "jaccard_pairs": _with(*_JACCARD) + "SELECT a, b, n_shared, n_union, score FROM j",
    "similar_documents": _with(*_JACCARD) + "SELECT a, b, n_shared, n_union, score FROM j WHERE score >= 0.75",
    "document_components": _with(*_JACCARD, *_COMPONENTS, recursive=True) + "SELECT node, component FROM c",
    "suspicious_clusters": _with(*_JACCARD, *_COMPONENTS, recursive=True) + "SELECT component, count(*) AS size, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS ids FROM c GROUP BY component",
    "reference_best": _with(*_ALL_PRINTS)
    + ", q AS ("
    + _with(*_ALL_PRINTS, source="(SELECT item_id AS doc_id, text FROM benchmark)")
    + "SELECT doc_id AS item_id, fp FROM f), x AS (SELECT f.doc_id, q.item_id, count(*) AS i FROM f JOIN q USING (fp) GROUP BY ALL), "
    "y AS (SELECT doc_id, item_id, i / ((SELECT count(*) FROM f WHERE f.doc_id = x.doc_id) + (SELECT count(*) FROM q WHERE q.item_id = x.item_id) - i) AS score FROM x), "
    "z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS k FROM y) "
    "SELECT d.doc_id, coalesce(z.score, 0.0::DOUBLE) AS score, z.item_id, CAST(row_number() OVER (ORDER BY coalesce(z.score, 0) DESC, d.doc_id) AS INTEGER) AS rank FROM documents d LEFT JOIN z ON z.doc_id = d.doc_id AND z.k = 1",
    "call_graph_edges": _with(*_GRAPH) + "SELECT user_id, caller, callee FROM ed",
    "degree_signature": _with(*_GRAPH, *_DEGREES) + "SELECT user_id, in_degree, out_degree, n_nodes FROM sg",
    "component_count": _with(*_GRAPH, *_REACH, recursive=True) + "SELECT user_id, n_components FROM cc",
    "call_graph_members": _with(
        *_GRAPH, *_DEGREES, *_REACH,
        "sh AS (SELECT user_id, string_agg(in_degree || ',' || out_degree || ':' || n_nodes, ';' ORDER BY in_degree, out_degree) AS degrees, sum(n_nodes) AS n_nodes FROM sg GROUP BY user_id)",
        "ec AS (SELECT user_id, count(*) AS n_edges FROM ed GROUP BY user_id)",
        "fu AS (SELECT sh.user_id, degrees, n_nodes, coalesce(n_edges, 0) AS n_edges, n_components FROM sh LEFT JOIN ec USING (user_id) JOIN cc USING (user_id))", recursive=True,
    )
    + "SELECT user_id, min(user_id) OVER (PARTITION BY degrees, n_nodes, n_edges, n_components) AS representative FROM fu",
    "call_graph_similarity": _with(
        *_GRAPH, *_DEGREES, *_REACH,
        "sh AS (SELECT user_id, string_agg(in_degree || ',' || out_degree || ':' || n_nodes, ';' ORDER BY in_degree, out_degree) AS degrees, sum(n_nodes) AS n_nodes FROM sg GROUP BY user_id)",
        "ec AS (SELECT user_id, count(*) AS n_edges FROM ed GROUP BY user_id)",
        "fu AS (SELECT sh.user_id, degrees, n_nodes, coalesce(n_edges, 0) AS n_edges, n_components FROM sh LEFT JOIN ec USING (user_id) JOIN cc USING (user_id))",
        "ds AS (SELECT min(user_id) AS user_id, n_edges, n_components FROM fu GROUP BY degrees, n_nodes, n_edges, n_components)",
        "ps AS (SELECT x.user_id AS a, y.user_id AS b, x.n_edges AS ea, y.n_edges AS eb, x.n_components AS ca, y.n_components AS cb FROM ds x JOIN ds y ON x.user_id < y.user_id)",
        "ks AS (SELECT a, b, in_degree, out_degree, sum(CASE WHEN side = 0 THEN n_nodes ELSE 0 END) AS na, sum(CASE WHEN side = 1 THEN n_nodes ELSE 0 END) AS nb FROM "
        "(SELECT a, b, in_degree, out_degree, n_nodes, 0 AS side FROM ps JOIN sg ON sg.user_id = a UNION ALL SELECT a, b, in_degree, out_degree, n_nodes, 1 FROM ps JOIN sg ON sg.user_id = b) GROUP BY ALL)",
        "ms AS (SELECT a, b, sum(least(na, nb)) / sum(greatest(na, nb)) AS degree FROM ks GROUP BY a, b)", recursive=True,
    )
    + "SELECT a, b, greatest(0.0, least(1.0, 0.6::DOUBLE * degree + 0.2::DOUBLE * CASE WHEN ea = 0 AND eb = 0 THEN 1.0 ELSE least(ea, eb) / greatest(ea, eb) END + 0.2::DOUBLE * CASE WHEN ca = 0 AND cb = 0 THEN 1.0 ELSE least(ca, cb) / greatest(ca, cb) END)) AS score FROM ms JOIN ps USING (a, b)",
    "multiset_jaccard": "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT x.user_id, x.event_type, x.n AS n, 0 AS m FROM c x UNION ALL SELECT user_id - 1, event_type, 0, n FROM c), "
    "g AS (SELECT user_id, event_type, sum(n) AS n, sum(m) AS m FROM k GROUP BY ALL) "
    "SELECT user_id, sum(least(n, m)) / sum(greatest(n, m)) AS score FROM g WHERE user_id IN (SELECT user_id FROM events) AND user_id + 1 IN (SELECT user_id FROM events) GROUP BY user_id",
    "ted_flat": "WITH n AS (SELECT DISTINCT p_name AS x FROM part) SELECT a.x AS a, b.x AS b, levenshtein(a.x, b.x) AS distance, greatest(0.0::DOUBLE, 1 - levenshtein(a.x, b.x) / (length(a.x) + length(b.x) + 2)) AS ted FROM n a JOIN n b ON a.x < b.x",
    "ted_chains": "WITH n AS (SELECT DISTINCT p_type AS x FROM part) SELECT a.x AS a, b.x AS b, levenshtein(a.x, b.x) AS distance, greatest(0.0::DOUBLE, 1 - levenshtein(a.x, b.x) / (length(a.x) + length(b.x))) AS ted FROM n a JOIN n b ON a.x < b.x",
    "matching_size": "WITH k AS (SELECT o_custkey, o_orderpriority, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS l, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS r FROM orders GROUP BY ALL) "
    "SELECT o_custkey, CAST(sum(least(l, r)) AS BIGINT) AS n FROM k GROUP BY o_custkey HAVING sum(least(l, r)) > 0",
    "list_submissions": "SELECT c_custkey, c_name, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_acctbal ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 100 OFFSET 20",
    "find_pair": _with(_PAIRS, "t AS (SELECT l_partkey AS p, l_suppkey AS s FROM lineitem ORDER BY 1, 2 LIMIT 1)") + "SELECT a, b, overall_score FROM pr, t WHERE least(a, b) = least(p, s) AND greatest(a, b) = greatest(p, s)",
    "comparisons_of": _with(_PAIRS) + "SELECT a, b, overall_score FROM pr WHERE a = 7 OR b = 7",
    "cascade_delete": "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer))",
    "cache_misses": "SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem x WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_returnflag = 'N' AND least(y.l_partkey, y.l_suppkey) = least(x.l_partkey, x.l_suppkey) AND greatest(y.l_partkey, y.l_suppkey) = greatest(x.l_partkey, x.l_suppkey))",
    "label_lookup": "SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) = (SELECT lower(min(n_name)) FROM nation)",
    "comparison_matches": "SELECT o_orderkey AS id, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_extendedprice DESC, l_linenumber), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "best_of_group": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT c_custkey, coalesce(o_totalprice, 0.0::DOUBLE) AS price, o_orderkey, row_number() OVER (ORDER BY coalesce(o_totalprice, 0) DESC, c_custkey) AS rank FROM customer LEFT JOIN r ON o_custkey = c_custkey AND k = 1",
    "presentation": "WITH t AS (SELECT *, l_discount * 10 AS s, l_discount * 10 * l_extendedprice / 100003 * 100 AS x FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.5 THEN 'medium' ELSE 'low' END AS risk, "
    "CASE WHEN s >= 0.8 THEN '#dc2626' WHEN s >= 0.5 THEN '#d97706' ELSE '#16a34a' END AS color, CASE WHEN x * 4 = floor(x * 4) AND floor(x * 4) % 2 = 1 THEN format('{:.1f}%', x + 0.05) ELSE format('{:.1f}%', x) END AS shown, "
    "CASE WHEN l_discount = 0 AND l_tax = 0 THEN 1.0::DOUBLE ELSE least(l_discount, l_tax) / greatest(l_discount, l_tax) END AS balance FROM t",
    "source_names": "WITH t AS (SELECT p_partkey, regexp_replace(regexp_replace(lower('  ' || p_name || ' -- ' || p_type || ' '), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS x FROM part) SELECT p_partkey, CASE WHEN x = '' THEN 'submission.c' ELSE x || '.c' END AS filename FROM t",
    "source_validation": "SELECT doc_id, CASE WHEN " + _STRIP.format(x="coalesce(text, '')") + " = '' THEN 'empty source' WHEN NOT contains(text, '(') THEN 'no functions' ELSE 'accepted' END AS result FROM documents",
    "fenced_replies": "SELECT conv_id, turn, " + _STRIP.format(x="text") + " AS code FROM conversations WHERE text IS NOT NULL",
    "report_json": "SELECT c_custkey AS id, c_name AS label, count(o_orderkey) AS submission_count, coalesce(max(o_totalprice), 0.0::DOUBLE) AS highest_student_score FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
    "schema_migration": "SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name, 'legacy' AS workspace FROM supplier UNION ALL SELECT c_custkey, c_name, coalesce(c_mktsegment, 'legacy') FROM customer",
    "parsed_functions": "SELECT CAST(c_nationkey AS BIGINT) AS submission_id, 'f' || c_custkey AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS order_index, 14 + 4 * (c_custkey % 4) AS n_nodes, 'f' || (c_custkey + 4) AS callees FROM customer",
    "parsed_call_edges": "SELECT CAST(a.c_nationkey AS BIGINT) AS submission_id, 'f' || a.c_custkey AS caller, 'f' || b.c_custkey AS callee FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND b.c_custkey = a.c_custkey + 4",
    "cluster_averages": _with(*_JACCARD, *_COMPONENTS, recursive=True)
    + ", es AS (SELECT a, score FROM j WHERE score >= 0.75 UNION ALL SELECT representative, 1.0 FROM m WHERE doc_id <> representative AND fps IS NOT NULL), "
    "sz AS (SELECT component, count(*) AS size FROM c GROUP BY component), av AS (SELECT component, avg(score) AS mean FROM es JOIN c ON node = a GROUP BY component), "
    f"cs AS (SELECT component, size, {_round6('mean')} AS average_similarity FROM sz JOIN av USING (component)) "
    "SELECT *, row_number() OVER (ORDER BY size DESC, average_similarity DESC, component) AS rank FROM cs",
    "cluster_rows": _with(*_JACCARD, *_COMPONENTS, recursive=True)
    + "SELECT component, row_number() OVER (PARTITION BY component ORDER BY node) AS place, node AS submission_id, source AS name FROM c JOIN documents ON doc_id = node",
    "grown_components": _with(*_JACCARD, *_COMPONENTS, recursive=True) + "SELECT node, component FROM c",
    "similar_to_new": _with(*_FUSED) + "SELECT * FROM fu WHERE b >= 20 AND overall_score >= 0.75",
    "fused_pairs": _with(*_FUSED) + "SELECT * FROM fu",
    "fused_matches": _with(*_FUSED) + "SELECT a, b, CAST(index_a AS INTEGER) AS index_a, CAST(index_b AS INTEGER) AS index_b, similarity, ted_similarity, winnow_similarity FROM ma",
    "cohort_report": _with(
        *_FUSED, "e AS (SELECT a AS u, b AS v FROM fu WHERE overall_score >= 0.75 UNION SELECT b, a FROM fu WHERE overall_score >= 0.75)",
        "r AS (SELECT u AS node, u AS seen FROM e UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.seen)", "h AS (SELECT max(overall_score) AS highest FROM fu)", recursive=True,
    )
    + "SELECT (SELECT count(*) FROM gn) AS submission_count, (SELECT count(*) FROM fu) AS n_pairs, highest, (SELECT count(*) FROM fu WHERE overall_score = highest) AS n_highest, "
    "(SELECT count(DISTINCT c) FROM (SELECT node, min(seen) AS c FROM r GROUP BY node)) AS n_clusters, false AS ai_reference_enabled FROM h",
    "rank_pairs": "WITH t AS (SELECT p_type, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_type) SELECT row_number() OVER (ORDER BY returned / n DESC, p_type) AS rank, p_type, returned, n FROM t",
}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: clusters of documents with similar fingerprints."""
    return suspicious_clusters(spark, sf_dir)


assert ORACLES.keys() <= QUERIES.keys()
assert Settings().winnow_k == 5 and Settings().winnow_window == 4
