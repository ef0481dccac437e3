"""SQL names of the engine's functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from treekin.functions.hashing import LONGS, grams_of, minima_of, token_hash, token_hashes, winnower
from treekin.operators.trees import _annotated, _distance
from treekin.sources.ast_json import ast_to_json

#: SQL bodies: name and parameters, type, expression.
_EXPRESSIONS = (
    ("round6(x DOUBLE)", "DOUBLE", None),
    ("jaccard(a ARRAY<BIGINT>, b ARRAY<BIGINT>)", "DOUBLE", "CASE WHEN size(a) = 0 AND size(b) = 0 THEN 1D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END"),
    ("tree_signatures(ast ARRAY<STRUCT<label: STRING, value: STRING, depth: INT, n_children: INT>>)", "ARRAY<STRING>", "transform(ast, x -> concat_ws(':', x.label, x.value))"),
    (
        "annotated_tree(ast ARRAY<STRUCT<label: STRING, value: STRING, depth: INT, n_children: INT>>)",
        "STRUCT<labels: ARRAY<BIGINT>, leftmost: ARRAY<INT>, keyroots: ARRAY<INT>, bag: ARRAY<BIGINT>, branches: ARRAY<BIGINT>>",
        "annotate_codes(transform(ast, x -> xxhash64(concat_ws(':', x.label, x.value))), transform(ast, x -> x.n_children))",
    ),
    (
        "tree_distance(a ARRAY<STRUCT<label: STRING, value: STRING, depth: INT, n_children: INT>>, b ARRAY<STRUCT<label: STRING, value: STRING, depth: INT, n_children: INT>>)",
        "INT",
        "annotated_distance(annotated_tree(a), annotated_tree(b), CAST(NULL AS INT))",
    ),
    (
        "tree_similarity(a ARRAY<STRUCT<label: STRING, value: STRING, depth: INT, n_children: INT>>, b ARRAY<STRUCT<label: STRING, value: STRING, depth: INT, n_children: INT>>)",
        "DOUBLE",
        "CASE WHEN size(a) + size(b) = 0 THEN 1D ELSE greatest(0D, 1 - tree_distance(a, b) / (size(a) + size(b))) END",
    ),
)
_ROUND6 = (
    "CASE WHEN x IS NULL THEN NULL ELSE transform(array(named_struct('h', floor(x * 67108864D) / 67108864D, 'k', CAST(floor(x * 1e6D) AS DOUBLE))), p -> "
    "transform(array(named_struct('m', floor((x - p.h) * 1125899906842624D) / 1125899906842624D)), q -> "
    "transform(array(((p.h * 2e6D - (2 * p.k + 1)) + q.m * 2e6D) + (x - p.h - q.m) * 2e6D), s -> "
    "CASE WHEN s > 0 THEN p.k + 1 WHEN s < 0 THEN p.k ELSE p.k + p.k % 2 END / 1e6D)[0])[0])[0] END"
)


def register(spark: SparkSession) -> None:
    """Functions of SQL: token_hash(token), token_hashes(tokens), kgram_hashes(hashes, k), winnow(grams, window), fingerprints(tokens) with the
    default k and window, jaccard(a, b), round6(x), tree_signatures(ast), tree_distance(a, b), tree_similarity(a, b), ast_to_json(ast); and parse_c(source)
    as a table function."""
    from pyspark.sql.functions import udtf

    from treekin.sources.normalize import FUNCTION, each_function

    class ParseC:
        def eval(self, source: str):
            for f in each_function(source or ""):
                yield f["name"], f["order_index"], f["ast"], f["callees"]

    def by_size(apply):
        """Of (array<long>, size): the arrays of one size together; a size below 1 is an error."""

        def run(column: pa.Array, size: pa.Array) -> pa.Array:
            import numpy as np

            from treekin.functions.hashing import _lists, _longs, _ragged

            sizes, out = np.asarray(size.fill_null(0)), [None] * len(column)
            if len(sizes) and sizes.min() < 1:
                raise ValueError("the size must be at least 1")
            for k in set(sizes.tolist()):
                rows = np.flatnonzero(sizes == k)
                values, first = _ragged(column.take(pa.array(rows)))
                for i, x in zip(rows.tolist(), _lists(*apply(_longs(values), first, k)), strict=True):
                    out[i] = x.as_py()
            return pa.array(out, pa.list_(pa.int64()))

        return F.arrow_udf(run, LONGS)

    for name, function in (
        ("token_hash", token_hash), ("token_hashes", token_hashes), ("kgram_hashes", by_size(grams_of)), ("winnow", by_size(minima_of)), ("fingerprints", winnower()),
        ("ast_to_json", ast_to_json), ("annotate_codes", _annotated), ("annotated_distance", _distance),
    ):
        spark.udf.register(name, function)
    for signature, kind, body in _EXPRESSIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body or _ROUND6}")
    spark.udtf.register("parse_c", udtf(ParseC, returnType=FUNCTION))
