"""Stored submissions, comparisons and reports: tables of Parquet in one folder, and the queries on them.

A table is a list of folders of Parquet files.  The lists of all tables are in one small file, a version; a transaction writes its new
folders and then one new version, so that all its changes appear together or not at all, and readers see one version or the other.  An
append adds a folder and reads none; small folders are merged into larger ones, ``MERGE`` at a time, so a row is written again as often
as the logarithm of their number.  There is one writer at a time.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treekin.config import Settings
from treekin.functions.scalar import hash_password, strip, verify_password
from treekin.operators.prefilter import known_members
from treekin.plans.cohort import AnalysisRequest, Report, analyze_cohort
from treekin.plans.migrations import migrate
from treekin.plans.pairs import analyze, compare
from treekin.plans.postings import Postings
from treekin.shared import drop_stage, setting, stage
from treekin.sources.normalize import parse_functions
from treekin.sources.submissions import accepted, rejected, request_reason

SCHEMAS = {
    "submissions": "id long, workspace string, name string, filename string, language string, source_code string, ast_node_count int, created_at timestamp",
    "functions": "submission_id long, name string, order_index int, ast array<struct<label:string,value:string,depth:int,n_children:int>>, callees array<string>, fingerprints array<long>, ast_node_count int, shape array<struct<sig:string,n_children:int>>, tree_id string",
    "comparisons": "id string, a long, b long, settings string, overall_score double, ted_score double, winnow_score double, callgraph_score double, aligned_function_count long, created_at timestamp",
    "matches": "comparison_id string, index_a int, index_b int, similarity double, ted_similarity double, winnow_similarity double",
    "labs": "id string, label string, password_hash string, report string, created_at timestamp",
}
#: Columns by which a folder's files are laid out, so that a query on one value reads that part only.
PARTITIONS = {"submissions": ("workspace",)}
SORTED = {"functions": "submission_id", "matches": "comparison_id", "comparisons": "a"}
#: So many folders of one level are merged into one of the next.
MERGE = 16


# --- queries on tables, whatever they are stored in


def by_id(rows: DataFrame, key, column: str = "id") -> DataFrame:
    return rows.where(F.col(column) == key)


def page(rows: DataFrame, *order, limit: int = 100, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500, offset 0 or more")
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_after(rows: DataFrame, after: tuple | None, limit: int = 100, time: str = "created_at", key: str = "id") -> DataFrame:
    """The page that follows the row with this (time, key), newest first, rows without a time last; the first page without one.

    Unlike an offset it sorts no row of an earlier page, and files whose times are all later than the cursor's are not read: the condition on the
    time alone reaches the scan.  Rows that come or go meanwhile move no other row to another page.
    """
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1 to 500")
    if after is not None:
        when, last = after
        if when is None:
            rows = rows.where(F.col(time).isNull() & (F.col(key) < F.lit(last)))
        else:
            at, untimed = F.lit(when).cast("timestamp"), F.col(time).isNull()
            rows = rows.where((F.col(time) <= at) | untimed).where((F.col(time) < at) | (F.col(key) < F.lit(last)) | untimed)
    return rows.orderBy(F.desc_nulls_last(time), F.desc(key)).limit(limit)


def list_with_counts(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, count: str = "function_count") -> DataFrame:
    counts = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.count(F.lit(1)).alias(count))
    return parents.join(counts, parent_key, "left").withColumn(count, F.coalesce(count, F.lit(0)))


def canonical(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adds lo and hi, one key for both orders."""
    return pairs.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b))


def find_pair(comparisons: DataFrame, x, y) -> DataFrame:
    return comparisons.where((F.least("a", "b") == min(x, y)) & (F.greatest("a", "b") == max(x, y)))


def comparisons_of(comparisons: DataFrame, key) -> DataFrame:
    return comparisons.where((F.col("a") == key) | (F.col("b") == key)).orderBy(F.desc("overall_score"), "a", "b")


def with_matches(comparisons: DataFrame, matches: DataFrame) -> DataFrame:
    """Each comparison with the array of its matches, best first."""
    best = F.struct((-F.col("similarity")).alias("o"), "index_a", "index_b", "similarity", "ted_similarity", "winnow_similarity")
    grouped = matches.groupBy(F.col("comparison_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(best)), lambda x: x.dropFields("o")).alias("matches"))
    return comparisons.join(grouped, "id", "left").withColumn("matches", F.coalesce("matches", F.array().cast(grouped.schema["matches"].dataType)))


def cache_misses(requests: DataFrame, cached: DataFrame) -> DataFrame:
    """Requested pairs (a, b) that are cached in neither order."""
    return canonical(requests).join(canonical(cached).select("lo", "hi"), ["lo", "hi"], "left_anti").select(*requests.columns)


def label_is(rows: DataFrame, label, column: str = "label") -> DataFrame:
    return rows.where(F.lower(column) == F.lower(strip(F.lit(label) if isinstance(label, str) else label)))


def summary_of_reports(labs: DataFrame) -> DataFrame:
    at = lambda path, kind: F.coalesce(F.get_json_object("report", path).cast(kind), F.lit(0).cast(kind))
    return labs.select("id", "label", "created_at", at("$.submission_count", "long").alias("submission_count"), at("$.highest_student_score", "double").alias("highest_student_score"))


def cascade(gone: DataFrame, parents: DataFrame, *children: tuple[DataFrame, str, str]) -> list[DataFrame]:
    """What is left of tables when parents go, whose keys are `id` in gone.

    children: (rows, key that names a row of the table before, own key), from the parents down; a row goes with the one it names.
    """
    left = [parents.join(gone.select("id"), "id", "left_anti")]
    for rows, above, own in children:
        dead = rows.join(gone.select(F.col("id").alias(above)).distinct(), above, "left_semi")
        left.append(rows.join(gone.select(F.col("id").alias(above)).distinct(), above, "left_anti"))
        gone = dead.select(F.col(own).alias("id"))
    return left


class Transaction:
    """Changes of several tables that become visible together; table() shows them already."""

    def __init__(self, store: Store):
        self.store, (self.version, before) = store, store._head()
        self.parts = {name: list(parts) for name, parts in before.items()}
        self.made: list[str] = []

    def table(self, name: str) -> DataFrame:
        return self.store._read(name, self.parts.get(name, []))

    def _write(self, name: str, rows: DataFrame) -> str:
        folder = f"part={uuid.uuid4().hex}"
        self.made.append(f"{self.store.path}/{name}/{folder}")
        rows = migrate(rows, SCHEMAS[name], {})
        if name in SORTED:
            rows = rows.sortWithinPartitions(SORTED[name])
        with setting(self.store.spark, "spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS"):  # the other type has no statistics
            rows.write.partitionBy(*PARTITIONS.get(name, ())).parquet(self.made[-1])
        return folder

    def append(self, name: str, rows: DataFrame) -> None:
        parts = self.parts.setdefault(name, [])
        parts.append([self._write(name, rows), 0])
        level = 0
        while len(small := [p for p in parts if p[1] == level]) >= MERGE:
            merged = self._write(name, self.store._read(name, small))
            parts[:] = [p for p in parts if p[1] != level]
            level += 1
            parts.append([merged, level])

    def replace(self, name: str, rows: DataFrame) -> None:
        level = max((p[1] for p in self.parts.get(name, [])), default=0)
        self.parts[name] = [[self._write(name, rows), level]]

    def insert(self, name: str, **row) -> None:
        """One row."""
        kind = self.store.table(name).schema
        self.append(name, self.store.spark.createDataFrame([tuple(row.get(f.name) for f in kind.fields)], kind))

    def delete(self, name: str, key, column: str = "id") -> None:
        """The rows with that key; the table is written anew without them."""
        self.replace(name, self.table(name).where(~F.col(column).eqNullSafe(F.lit(key))))


class Store:
    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings or Settings.of(spark)
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- versions and tables

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.path}/_versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))

    def _file(self, version: int) -> str:
        return f"{self.path}/_versions/{version:012d}.json"

    def _parts(self, version: int) -> dict[str, list]:
        stream = self._fs.open(self._path(self._file(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _head(self) -> tuple[int, dict[str, list]]:
        versions = self._versions()
        return (versions[-1], self._parts(versions[-1])) if versions else (0, {})

    def _read(self, name: str, parts: list) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        base = f"{self.path}/{name}"
        columns = [c.split(" ", 1)[0] for c in SCHEMAS[name].split(", ")]
        return self.spark.read.schema(SCHEMAS[name]).option("basePath", base).parquet(*[f"{base}/{folder}" for folder, _ in parts]).select(*columns)

    def table(self, name: str) -> DataFrame:
        return self._read(name, self._head()[1].get(name, []))

    @contextlib.contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """All changes or none: an error leaves the version that was there, and its new folders go."""
        t = Transaction(self)
        try:
            yield t
            self._commit(t)
        except BaseException:
            for folder in t.made:
                self._fs.delete(self._path(folder), True)
            raise

    def _commit(self, t: Transaction) -> None:
        number = t.version + 1
        new = self._path(f"{self.path}/_versions/_new-{uuid.uuid4().hex}")
        stream = self._fs.create(new, False)
        stream.write(bytearray(json.dumps(t.parts).encode()))
        stream.close()
        target = self._path(self._file(number))
        if self._fs.exists(target) or not self._fs.rename(new, target):
            self._fs.delete(new, False)
            raise OSError(f"version {number} was written by another writer")
        # folders that neither this version nor the one before names; the one before may still be read
        kept = {f"{self.path}/{name}/{folder}" for v in (t.version, number) if v for name, parts in self._parts(v).items() for folder, _ in parts}
        for old in [v for v in self._versions() if v < t.version]:
            for name, parts in self._parts(old).items():
                for folder, _ in parts:
                    if f"{self.path}/{name}/{folder}" not in kept:
                        self._fs.delete(self._path(f"{self.path}/{name}/{folder}"), True)
            self._fs.delete(self._path(self._file(old)), False)
        for folder in set(t.made) - kept:
            self._fs.delete(self._path(folder), True)

    def adopt(self, name: str, rows: DataFrame) -> None:
        """Appends rows of an older layout of the table."""
        if name == "functions":
            self.postings().add(migrate(rows, SCHEMAS[name]))
        with self.transaction() as t:
            t.append(name, migrate(rows, SCHEMAS[name]))

    # -- submissions

    def add_submissions(self, workspace: str, rows: DataFrame) -> DataFrame:
        """rows: (id, name, filename, source_code).  Stores those that are accepted; returns the others with their reason.

        Rejected: requests with a field that is missing or too long, ids that are null, stored already (in any workspace) or taken by an earlier row
        (the first by name, filename and source of equal ids stays), sources that are blank or without a function.  Only what passes
        the checks before is parsed, and only ids are compared with the stored table.  Submissions and their functions appear together.
        """
        workspace = _workspace(workspace)
        fields = ("id", "name", "filename", "source_code")
        # each row once: equal rows are told apart by their number
        same = Window.partitionBy("id").orderBy(*[F.col(c).asc_nulls_last() for c in fields[1:]])
        asked = stage(rows.select(F.col("id").cast("long").alias("id"), *fields[1:], request_reason().alias("reject_reason")), "asked-requests")
        sound = asked.where("reject_reason IS NULL AND id IS NOT NULL")
        numbered = sound.withColumn("nth", F.row_number().over(same))
        stored = known_members(sound.select("id"), self.table("submissions").select("id"), "id").withColumn("stored", F.lit(True))
        numbered = numbered.join(stored, "id", "left")
        reason = F.when(F.col("stored"), "id is taken").when(F.col("nth") > 1, "id is repeated")
        numbered = stage(numbered.select(*fields, reason.alias("reject_reason")), "numbered-requests")
        fresh = numbered.where("reject_reason IS NULL").drop("reject_reason")
        functions = stage(parse_functions(fresh), "parsed")
        counts = functions.groupBy(F.col("submission_id").alias("id")).agg(F.count(F.lit(1)).alias("n_functions"), F.sum(F.size("ast")).cast("int").alias("ast_node_count"))
        checked = stage(fresh.join(counts, "id", "left"), "checked")
        good = accepted(checked)
        kept = stage(analyze(functions.join(good.select(F.col("id").alias("submission_id")), "submission_id", "left_semi"), self.settings), "analyzed")
        self.postings().add(kept)  # before the functions appear, so that none is without its postings
        with self.transaction() as t:
            t.append("functions", kept)
            t.append("submissions", good.select("id", F.lit(workspace).alias("workspace"), "name", "filename", F.lit("c").alias("language"), "source_code", "ast_node_count", F.current_timestamp().alias("created_at")))
        for done in (functions, kept):
            drop_stage(done)
        lost = asked.where("reject_reason IS NOT NULL OR id IS NULL").withColumn("reject_reason", F.coalesce("reject_reason", F.lit("id is missing")))
        lost = lost.union(numbered.where("reject_reason IS NOT NULL")).withColumn("n_functions", F.lit(None).cast("long")).withColumn("ast_node_count", F.lit(None).cast("int"))
        return lost.unionByName(rejected(checked))

    def postings(self) -> Postings:
        """The postings of all stored functions' shapes; a store that has none yet gets them."""
        found = Postings(self.spark, f"{self.path}/postings")
        if not found.parts.folders():
            found.add(self.table("functions"))
        return found

    def list_submissions(self, workspace: str, limit: int = 100, offset: int = 0) -> DataFrame:
        mine = self.table("submissions").where(F.col("workspace") == _workspace(workspace))
        return page(list_with_counts(mine, self.table("functions"), "id", "submission_id"), F.desc("created_at"), F.desc("id"), limit=limit, offset=offset)

    def submissions_after(self, workspace: str, after: tuple | None = None, limit: int = 100) -> DataFrame:
        """list_submissions by a cursor: the page after the submission with this (created_at, id).  Only the page's functions are counted."""
        mine = self.table("submissions").where(F.col("workspace") == _workspace(workspace))
        found = stage(page_after(mine, after, limit), "page")
        functions = self.table("functions").join(found.select(F.col("id").alias("submission_id")), "submission_id", "left_semi")
        return list_with_counts(found, functions, "id", "submission_id").orderBy(F.desc_nulls_last("created_at"), F.desc("id"))

    def get_submission(self, workspace: str, key: int) -> DataFrame:
        one = by_id(self.table("submissions").where(F.col("workspace") == _workspace(workspace)), key)
        functions = self.table("functions").where(F.col("submission_id") == key).groupBy(F.col("submission_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("order_index", "name", "ast_node_count", "callees"))).alias("functions"))
        return one.join(functions, "id", "left")

    def delete_submission(self, workspace: str, key: int) -> None:
        """With its functions, comparisons and their matches."""
        gone = by_id(self.table("submissions").where(F.col("workspace") == _workspace(workspace)), key).select("id")
        if not gone.count():
            raise LookupError(key)
        with self.transaction() as t:
            submissions, functions = cascade(gone, t.table("submissions"), (t.table("functions"), "submission_id", "submission_id"))
            dead = t.table("comparisons").where((F.col("a") == key) | (F.col("b") == key)).select("id")
            comparisons, matches = cascade(dead, t.table("comparisons"), (t.table("matches"), "comparison_id", "comparison_id"))
            for name, rows in (("submissions", submissions), ("functions", functions), ("comparisons", comparisons), ("matches", matches)):
                t.replace(name, rows)

    # -- comparisons

    def compare(self, pairs: list[tuple[int, int]], force: bool = False) -> DataFrame:
        """Scores of pairs, from the cache where they are there for these settings; force computes them anew.

        Only the functions of the submissions asked for are read.
        """
        if any(a == b or a <= 0 or b <= 0 for a, b in pairs):
            raise ValueError("a pair needs two different positive ids")
        ids = sorted({x for p in pairs for x in p})
        wanted = self.spark.createDataFrame(pairs, "a long, b long")
        known = {r[0] for r in self.table("submissions").select("id").where(F.col("id").isin(ids)).collect()}
        if missing := set(ids) - known:
            raise LookupError(f"no such submissions: {sorted(missing)}")
        key = F.lit(self.settings.key())
        todo = wanted if force else cache_misses(wanted, self.table("comparisons").where(F.col("settings") == key))
        todo = stage(canonical(todo).dropDuplicates(["lo", "hi"]).select("a", "b"), "asked")
        if todo.count():
            scores, matches = compare(self.table("functions").where(F.col("submission_id").isin(ids)), todo, self.settings)
            scores = scores.withColumn("id", F.sha2(F.concat_ws(":", F.least("a", "b"), F.greatest("a", "b"), key), 256)).withColumn("settings", key)
            fresh = stage(scores.withColumn("created_at", F.current_timestamp()), "fresh")
            listed = matches.join(fresh.select("a", "b", F.col("id").alias("comparison_id")), ["a", "b"]).dropna(subset=["index_a", "index_b"])
            with self.transaction() as t:
                if force:
                    left = cascade(fresh.select("id"), t.table("comparisons"), (t.table("matches"), "comparison_id", "comparison_id"))
                    for name, rows in zip(("comparisons", "matches"), left, strict=True):
                        t.replace(name, rows)
                t.append("comparisons", fresh)
                t.append("matches", listed)
            drop_stage(fresh)
        drop_stage(todo)
        both = canonical(self.table("comparisons").where(F.col("settings") == key))
        return both.join(canonical(wanted).select("lo", "hi").distinct(), ["lo", "hi"], "left_semi").drop("lo", "hi")

    def comparison(self, key: str) -> DataFrame:
        return with_matches(by_id(self.table("comparisons"), key), self.table("matches").where(F.col("comparison_id") == key))

    def by_submission(self, key: int) -> DataFrame:
        return comparisons_of(self.table("comparisons"), key).select("id", "a", "b", "overall_score", "created_at")

    def delete_comparison(self, key: str) -> None:
        """With its matches."""
        with self.transaction() as t:
            t.delete("comparisons", key)
            t.delete("matches", key, "comparison_id")

    # -- analysis and reports

    def analyze(self, workspace: str, request: AnalysisRequest = AnalysisRequest(), provider=None) -> Report:
        return analyze_cohort(self.table("submissions"), _workspace(workspace), request, self.settings, provider)

    def capabilities(self, provider_key: str | None = None) -> dict:
        return {"references_configured": bool((provider_key or "").strip()), "default_references": self.settings.reference_default, "max_references": self.settings.reference_max}

    def save_lab(self, label: str, password: str, report: str | Report) -> str:
        """Keeps a report, or its JSON, under a new name."""
        if isinstance(report, Report):
            report = report.to_json().first()["report"]
        json.loads(report)
        label = label.strip()
        if not label or label_is(self.table("labs"), label).count():
            raise ValueError("the name is blank or taken")
        key = uuid.uuid4().hex
        row = self.spark.createDataFrame([(key, label, hash_password(password), report)], "id string, label string, password_hash string, report string")
        with self.transaction() as t:
            t.append("labs", row.withColumn("created_at", F.current_timestamp()))
        return key

    def unlock_lab(self, label: str, password: str) -> dict | None:
        """The report of that name, or None if there is none or the password is wrong."""
        row = label_is(self.table("labs"), label).first()
        return json.loads(row["report"]) if row and verify_password(password, row["password_hash"]) else None

    def labs(self) -> DataFrame:
        return summary_of_reports(self.table("labs"))

    def ready(self) -> bool:
        return self.spark.sql("SELECT 1").first()[0] == 1


def _workspace(name: str) -> str:
    name = (name or "").strip()
    if not name:
        raise ValueError("a workspace is needed")
    return name
