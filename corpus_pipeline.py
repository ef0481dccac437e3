"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, token output.

Each stage's result is a table of its own, and the one before goes as soon as it is written; the token file stays, as the result reads it.

Edge cases.  Null and empty texts have too few words and go in the first stage.  Rows that share a doc_id are one document to the second stage
and rows of their own to the others; a null doc_id links nothing and stays.  Null sources are one source.  An empty table gives an empty
result.  Documents may have more columns, of any names: all stages but the last keep them, in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treekin.llm.decontaminate import decontaminate
from treekin.llm.mixing import mix_documents
from treekin.llm.ngram_join import ngram_jaccard_join
from treekin.llm.quality import quality_filter
from treekin.llm.tokens import read_token_file, write_token_file
from treekin.operators.prefilter import anti_join
from treekin.shared import drop_stage, new_path, stage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays.

    Rows that share a doc_id are one document and stay or go together; a null doc_id links nothing and stays.
    """
    groups = ngram_jaccard_join(docs)
    return anti_join(docs, groups.where("component_id != doc_id"), "doc_id")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written and read back."""
    path = new_path(spark, "token-file")
    write_token_file(docs, path)
    return read_token_file(spark, path)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("mixing", mixed),
    ("token output", token_output),
]

#: Fuzzy joins, BM25 and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage_of) in enumerate(STAGES):
        docs = stage_of(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
        if before is not None:
            drop_stage(before)
        before = docs if k < len(STAGES) - 1 else None
    return docs
