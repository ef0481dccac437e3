"""Stored postings: which shapes hold a fingerprint, bucketed by the fingerprint.

New shapes are looked up in the postings of all stored ones: the new side is shuffled into the buckets of the postings, which stay where
they are, so a lookup costs a scan of the postings and a shuffle of what is new.  Each shape is in the table once, however many functions
have it; shapes that no function has any more do no harm, as what is found is joined with the functions.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treekin.plans.generations import Generations
from treekin.shared import drop_stage, stage

#: Buckets of a folder of postings that is written now; a folder's name has the number it was written with.
BUCKETS = 64


class Postings:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.parts = Generations(spark, path, "postings")

    def _name(self, folder: str) -> str:
        return "treekin_postings_" + hashlib.sha256(folder.encode()).hexdigest()[:32]

    def _write(self, folder: str, shapes: DataFrame | None, postings: DataFrame) -> None:
        if shapes is not None:
            shapes.write.parquet(f"{folder}/shapes")
        rows = postings.select("fingerprint", "tree_id", "k").repartition(self.buckets, "fingerprint")
        rows.write.format("parquet").bucketBy(self.buckets, "fingerprint").sortBy("fingerprint").option("path", f"{folder}/postings").saveAsTable(self._name(folder))

    def _postings(self, folder: str) -> DataFrame:
        """Postings of one folder, as a table of this session's catalog: a plain read would not know of the buckets."""
        buckets, where = folder.rsplit("/", 1)[1].split("-")[1], f"{folder}/postings".replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._name(folder)} (fingerprint BIGINT, tree_id STRING, k BIGINT) USING parquet "
            f"CLUSTERED BY (fingerprint) SORTED BY (fingerprint) INTO {buckets} BUCKETS LOCATION '{where}'"
        )
        return self.spark.table(self._name(folder))

    def shapes(self) -> DataFrame:
        """(tree_id) of all shapes, those without a fingerprint included."""
        folders = self.parts.folders()
        return self.spark.read.schema("tree_id string").parquet(*[f"{f}/shapes" for f in folders]) if folders else self.spark.createDataFrame([], "tree_id string")

    def add(self, functions: DataFrame) -> None:
        """functions: (tree_id, fingerprints).  Shapes that are here already, and repeated ones, change nothing."""
        asked = stage(functions.where("tree_id IS NOT NULL").groupBy("tree_id").agg(F.first("fingerprints").alias("fingerprints")), "new-shapes")
        # the asked ones are broadcast if their staged size allows it; otherwise both sides are shuffled
        known = self.shapes().join(asked.select("tree_id"), "tree_id", "left_semi")
        fresh = stage(asked.join(known, "tree_id", "left_anti"), "fresh-shapes")
        if not fresh.isEmpty() or not self.parts.folders():
            prints = F.array_distinct("fingerprints")
            rows = fresh.select("tree_id", F.size(prints).cast("long").alias("k"), F.explode(prints).alias("fingerprint"))
            self._write(self.parts.new(mark=str(self.buckets)), fresh.select("tree_id"), rows)
        for done in (asked, fresh):
            drop_stage(done)

    def probe(self, functions: DataFrame) -> DataFrame:
        """functions: (tree_id, fingerprints).  (x, y, winnow) of each stored shape x and each shape y of functions that have a common
        fingerprint, themselves included; winnow is the Jaccard similarity of their fingerprints."""
        prints = F.array_distinct("fingerprints")
        asked = functions.groupBy(F.col("tree_id").alias("y")).agg(F.first("fingerprints").alias("fingerprints"))
        asked = stage(asked.select("y", F.size(prints).cast("long").alias("ky"), F.explode(prints).alias("fingerprint")), "asked-prints")
        found = [self._postings(f).join(asked, "fingerprint").groupBy(F.col("tree_id").alias("x"), "y", F.col("k").alias("kx"), "ky").agg(F.count(F.lit(1)).alias("shared")) for f in self.parts.folders()]
        if not found:
            return self.spark.createDataFrame([], "x string, y string, winnow double")
        # a shape is in one folder, so counts of folders need no sum
        return reduce(DataFrame.union, found).select("x", "y", (F.col("shared") / (F.col("kx") + F.col("ky") - F.col("shared"))).alias("winnow"))

    def compact(self) -> None:
        """Writes all folders into one, after many small additions."""
        folders = self.parts.folders()
        if len(folders) > 1:
            self._write(self.parts.new(True, str(self.buckets)), self.shapes(), reduce(DataFrame.union, [self._postings(f) for f in folders]))
            for gone in self.parts.drop_older():
                self.spark.sql(f"DROP TABLE IF EXISTS {self._name(gone)}")
