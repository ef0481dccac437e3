"""Stored components of a graph that only gains edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treekin.operators.components import extend_components
from treekin.plans.generations import Generations
from treekin.shared import stage


class Components:
    """(node, component) in folders.  A batch of edges adds rows for the nodes whose component it changes; as a component is named by its
    smallest node, and components only merge, the smallest name that a node has anywhere is the valid one, and adding a batch again is harmless."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "long"):
        self.spark, self.schema = spark, f"node {kind}, component {kind}"
        self.parts = Generations(spark, path)

    def read(self) -> DataFrame:
        """(node, component) of every node of an edge so far."""
        folders = self.parts.folders()
        rows = self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)
        return rows if len(folders) < 2 else rows.groupBy("node").agg(F.min("component").alias("component"))

    def add(self, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
        """Returns the rows that changed; edges that join nothing new write nothing."""
        kind = self.read().schema["node"].dataType
        changed = stage(extend_components(self.read(), edges.select(F.col(src).cast(kind).alias("src"), F.col(dst).cast(kind).alias("dst"))), "changed-components")
        if not changed.isEmpty():
            changed.write.parquet(self.parts.new())
        return changed

    def compact(self) -> None:
        """Writes each node once, after many additions."""
        if len(self.parts.folders()) > 1:
            self.read().write.parquet(self.parts.new(True))
            self.parts.drop_older()
