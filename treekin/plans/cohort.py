"""Cohort analysis: pairs, suspicious clusters, comparison with reference solutions, report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treekin.config import Settings
from treekin.functions.scalar import error_message, fenced_code, reference_count, round6
from treekin.operators.components import connected_components
from treekin.operators.ranking import global_rank
from treekin.plans.pairs import analyze, compare
from treekin.shared import stage
from treekin.sources.normalize import parse_functions


@dataclass(frozen=True)
class AnalysisRequest:
    submission_ids: tuple[int, ...] = ()
    use_references: bool = False
    problem_description: str | None = None
    references: int | None = None

    def __post_init__(self):
        object.__setattr__(self, "submission_ids", tuple(dict.fromkeys(self.submission_ids)))
        if self.use_references and not (self.problem_description or "").strip():
            raise ValueError("a problem description is needed for reference solutions")
        if self.problem_description is not None and len(self.problem_description) > 8000:
            raise ValueError("the problem description is too long")
        if self.references is not None and not 1 <= self.references <= 50:
            raise ValueError("1 to 50 references can be asked for")


# Fixed names of a report's parts and of their columns: the column here, the name in JSON.
_PAIRS = (("a", "submission_a_id"), ("name_a", "submission_a_name"), ("b", "submission_b_id"), ("name_b", "submission_b_name"))
_SCORES = tuple((c, c) for c in ("overall_score", "ted_score", "winnow_score", "callgraph_score"))
_LISTED = {
    "student_pairs": (*_PAIRS, *_SCORES, ("aligned_function_count", "aligned_function_count")),
    "clusters": (("members", "members"), ("size", "size"), ("average_similarity", "average_similarity")),
    "ai_references": (("label", "label"), ("source_code", "source_code")),
    "reference_results": (("submission_id", "submission_id"), ("submission_name", "submission_name"), ("reference_label", "reference_label"), *_SCORES),
    "reference_summaries": tuple((c, c) for c in ("submission_id", "submission_name", "max_reference_score", "best_reference_label")),
}


@dataclass
class Report:
    """A cohort's analysis.  All but the matches have a column rank, the order in which they are listed."""

    submission_count: int
    pairs: DataFrame
    matches: DataFrame
    clusters: DataFrame
    request: AnalysisRequest = AnalysisRequest()
    references: DataFrame | None = None
    reference_pairs: DataFrame | None = None
    reference_summary: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)

    def highest(self) -> DataFrame:
        return self.pairs.agg(F.coalesce(F.max("overall_score"), F.lit(0.0)).alias("highest_similarity"))

    def reference_source(self, label: str) -> str | None:
        """The source code of the reference solution with that label, or None."""
        row = self.references.where(F.col("label") == label).first() if self.references is not None else None
        return row["source_code"] if row else None

    def to_json(self) -> DataFrame:
        """One row: the report as JSON.  Its lists are as long as the cohort has pairs, which is what bounds it."""
        parts = {"student_pairs": self.pairs, "clusters": self.clusters, "ai_references": self.references, "reference_results": self.reference_pairs, "reference_summaries": self.reference_summary}
        spark, on = self.pairs.sparkSession, self.request.use_references
        row = spark.createDataFrame([(1,)], "key int")
        out = []
        for name, df in parts.items():
            if df is None:
                out.append(F.array().alias(name))
                continue
            entry = F.struct("rank", F.struct(*[F.col(c).alias(n) for c, n in _LISTED[name]]).alias("x"))
            row = row.join(df.agg(F.lit(1).alias("key"), F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["x"]).alias(name)), "key")
            out.append(F.col(name))
        row = row.join(self.highest().select(F.lit(1).alias("key"), round6("highest_similarity").alias("highest_student_score")), "key")
        now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        count = self.references.count() if self.references is not None else 0
        head = [
            now.alias("generated_at"), F.lit(self.submission_count).alias("submission_count"), F.lit(on).alias("ai_reference_enabled"), F.lit(count).alias("ai_reference_count"),
            F.lit(self.request.problem_description if on else None).cast("string").alias("problem_description"), F.col("highest_student_score"),
        ]
        said = F.array(*[F.lit(w) for w in self.warnings]).cast("array<string>").alias("warnings")
        return row.select(F.to_json(F.struct(*head, *out, said), {"ignoreNullFields": "false"}).alias("report"))


def select_cohort(submissions: DataFrame, workspace: str, ids: tuple[int, ...] = (), limit: int = 500) -> DataFrame:
    """The submissions of the ids, with their place in them; without ids the newest ones of the workspace.  A missing id is an error."""
    mine = submissions.where(F.col("workspace") == workspace)
    if ids:
        places = F.create_map(*[x for i, v in enumerate(ids) for x in (F.lit(int(v)), F.lit(i))])
        found = mine.where(F.col("id").isin([int(i) for i in ids])).withColumn("place", places[F.col("id")])
        missing = set(ids) - {r[0] for r in found.select("id").collect()}
        if missing:
            raise LookupError(f"no such submissions: {sorted(missing)}")
        return found
    newest = mine.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)  # so the window below has that many rows at most
    return newest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id"))) - 1)


def all_pairs(cohort: DataFrame) -> DataFrame:
    """(a, b) of all unordered pairs, the one with the earlier place first.  A cohort has as many members as its limit or its list of ids."""
    a, b = cohort.select(F.col("id").alias("a"), F.col("place").alias("p")), cohort.select(F.col("id").alias("b"), F.col("place").alias("q"))
    return a.join(b, F.col("p") < F.col("q")).select("a", "b", "p", "q")


def ranked_pairs(scores: DataFrame, *ties: str) -> DataFrame:
    """scores by descending overall_score, those of equal score by the columns `ties`; adds rank."""
    return global_rank(scores, F.desc("overall_score"), *[F.col(c) for c in ties])


def cluster_summaries(scores: DataFrame, member: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(component, size, average_similarity, rank): one row for each component, largest first.

    scores: (a, b, overall_score); member: (node, component) of the pairs at or above the threshold, over which the average is taken.  Sizes and
    means are added up before rows are shuffled.
    """
    sizes = member.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    strong = scores.where(F.col("overall_score") >= threshold).select("a", "overall_score")
    inside = strong.join(member.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.avg("overall_score").alias("mean"))
    rows = sizes.join(inside, "component").select("component", "size", round6("mean").alias("average_similarity"))
    return global_rank(rows, F.desc("size"), F.desc("average_similarity"), F.col("component"))


def cluster_members(member: DataFrame, names: DataFrame) -> DataFrame:
    """(component, place, submission_id, name): one row for each member, places from 1 by id; a component of any size is spread over partitions.

    member: (node, component); names: (id, name).  The place is that in the order of all members less that of the component's first one.
    """
    rows = global_rank(member.select("component", F.col("node").alias("submission_id")), F.col("component"), F.col("submission_id"), name="at")
    first = rows.groupBy("component").agg(F.min("at").alias("first"))
    rows = rows.join(first, "component").join(names.select(F.col("id").alias("submission_id"), "name"), "submission_id", "left")
    return rows.select("component", (F.col("at") - F.col("first") + 1).alias("place"), "submission_id", "name")


def cluster_nodes(scores: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(node, component) of the components that the pairs at or above the threshold make."""
    return stage(connected_components(scores.where(F.col("overall_score") >= threshold).select("a", "b"), "a", "b"), "clusters")


def clusters(scores: DataFrame, names: DataFrame, threshold: float = 0.75) -> DataFrame:
    """scores: (a, b, overall_score); names: (id, name).  Components of the pairs at or above the threshold, of two members or more, each with
    its members in one row: for a cohort, whose size has a bound.  cluster_summaries and cluster_members are for more.
    """
    member = cluster_nodes(scores, threshold)
    people = member.join(names.select(F.col("id").alias("node"), "name"), "node", "left").groupBy("component").agg(
        F.sort_array(F.collect_list(F.struct(F.col("node").alias("submission_id"), "name"))).alias("members")
    )
    return cluster_summaries(scores, member, threshold).join(people, "component").select("members", "size", "average_similarity", "component", "rank")


def reference_summary(submissions: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: (submission_id, reference_order, reference_label, overall_score).  Each submission's best reference; the first of equal ones;
    none: 0 and null."""
    best = pairs.groupBy("submission_id").agg(F.max_by(F.struct("overall_score", "reference_label"), F.struct("overall_score", -F.col("reference_order"))).alias("best"))
    rows = submissions.select(F.col("id").alias("submission_id"), F.col("name").alias("submission_name"), "place").join(best, "submission_id", "left")
    rows = rows.select("submission_id", "submission_name", "place", F.coalesce("best.overall_score", F.lit(0.0)).alias("max_reference_score"), F.col("best.reference_label").alias("best_reference_label"))
    return global_rank(rows, F.desc("max_reference_score"), F.col("place")).drop("place")


def references_of(replies: list[str], asked: int | None, settings: Settings) -> list[tuple[int, str, str]]:
    """(order, label, reply) of the replies that aren't blank, as many as may be asked for; labels keep their numbers."""
    n = reference_count(asked, settings.reference_default, settings.reference_max)
    out = [(i, f"AI Reference {i + 1}", r) for i, r in enumerate(replies[:n]) if r and r.strip()]
    if not out:
        raise ValueError("no reference solution came back")
    return out


def analyze_cohort(submissions: DataFrame, workspace: str, request: AnalysisRequest = AnalysisRequest(), settings: Settings = Settings(), provider=None) -> Report:
    """submissions: (id, workspace, name, source_code, created_at).  provider(description, n): replies with reference solutions."""
    spark = submissions.sparkSession
    cohort = stage(select_cohort(submissions, workspace, request.submission_ids, settings.cohort_limit), "cohort")
    functions = stage(analyze(parse_functions(cohort), settings), "functions")
    pairs = all_pairs(cohort)
    scores, matches = compare(functions, pairs, settings)
    names = [cohort.select(F.col("id").alias(k), F.col("name").alias(f"name_{k}")) for k in "ab"]
    ranked = ranked_pairs(scores.join(pairs, ["a", "b"]).join(names[0], "a").join(names[1], "b"), "p", "q").drop("p", "q")
    count = cohort.count()
    report = Report(count, ranked, matches, clusters(ranked, cohort, settings.cluster_threshold), request)
    if count < 2:
        report.warnings.append("There is nothing to compare: the cohort has fewer than two submissions.")
    if request.use_references:
        try:
            if provider is None:
                raise ValueError("no provider of reference solutions is configured")
            made = references_of(list(provider(request.problem_description, reference_count(request.references, settings.reference_default, settings.reference_max))), request.references, settings)
        except Exception as error:  # a provider can fail in any way; the comparison of submissions stands
            report.warnings.append(f"There are no reference solutions: {error_message(error)}")
            made = []
        refs = spark.createDataFrame(made, "id long, label string, reply string").withColumn("source_code", fenced_code(F.col("reply")))
        ref_functions = stage(analyze(parse_functions(refs), settings), "reference-functions")
        usable = stage(refs.join(ref_functions.select(F.col("submission_id").alias("id")).distinct(), "id", "left_semi"), "references")
        skipped = refs.join(usable, "id", "left_anti").orderBy("id").select("label").collect()
        report.warnings += [f"{r[0]} was left out: no function could be read from it." for r in skipped]
        # a cohort by a handful of references, both bounded
        to_score = cohort.select(F.col("id").alias("a")).join(F.broadcast(usable.select(F.col("id").alias("b"))), F.lit(True))
        compared, _ = compare(functions, to_score, settings, ref_functions)
        named = compared.join(usable.select(F.col("id").alias("b"), F.col("label").alias("reference_label")), "b").withColumnRenamed("a", "submission_id").withColumnRenamed("b", "reference_order")
        named = named.join(cohort.select(F.col("id").alias("submission_id"), F.col("name").alias("submission_name"), "place"), "submission_id")
        report.references = usable.select((F.col("id") + 1).alias("rank"), "label", "source_code")
        report.reference_pairs = ranked_pairs(named, "place", "reference_order").drop("place")
        report.reference_summary = reference_summary(cohort, report.reference_pairs)
    return report
