"""The pipeline's stages on the smallest tables, each held against brute force on its own input; and the operators' SQL."""

import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_text_operators import alnum, components, stats
from treekin.llm import mixing, tokens
from treekin.llm.registry import ORACLES, QUERIES
from treekin.shared import stage, table


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    steps = [f for _, f in corpus_pipeline.STAGES]
    good = stage(steps[0](spark, docs, SMALL), "t0")
    rows = {r["doc_id"]: r["text"] for r in good.collect()}
    assert good.columns == docs.columns and all(not stats(t)[5] for t in rows.values())
    single = stage(steps[1](spark, good, SMALL), "t1")
    ids, texts = zip(*sorted(rows.items()), strict=True)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c for _, _, c in components(texts, list(ids))})
    free = stage(steps[2](spark, single, SMALL), "t2")
    items = [alnum(r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    dirty = {r["doc_id"] for r in single.collect() if any(f" {' '.join(i)} " in f" {' '.join(alnum(r['text']))} " for i in items)}
    assert {r["doc_id"] for r in free.collect()} == {r["doc_id"] for r in single.collect()} - dirty
    mixed = stage(steps[3](spark, free, SMALL), "t3")
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3
    sized = free.select("doc_id", "source", mixing.text_size(F.col("text")).alias("size"), mixing.text_quality(F.col("text")).alias("quality"))
    targets = {r["source"]: (r["target"], r["size"]) for r in mixing.mix(sized).groupBy("source").agg(F.max("target").alias("target"), F.max("size").alias("size")).collect()}
    words = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(mixing.text_size(F.col("text"))).alias("n")).collect()}
    assert all(abs(words.get(s, 0) - target) <= size / 2 + 1 for s, (target, size) in targets.items())
    out, t = [tuple(r) for r in steps[4](spark, mixed, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()], Tokenizer.from_file(tokens.tokenizer_path())
    want, start = [], 0
    for r in sorted(mixed.collect(), key=lambda r: (r["doc_id"], r["text"])):
        ids = np.array([*t.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert out == want


def test_run_drops_its_stages(spark):
    before = set(stages())
    out = corpus_pipeline.run(spark, SMALL)
    n = out.count()
    left = {p.split("-")[0] for p in set(stages()) - before}
    assert n > 0 and "pipeline" not in left and "token" in left
    documents = stage(table(spark, SMALL, "documents"), "t")
    for _, f in corpus_pipeline.STAGES[:-1]:
        documents = stage(f(spark, documents, SMALL), "t")
    assert n == documents.count()


def stages():
    import treekin.shared as shared
    from pyspark.sql import SparkSession

    folder = Path(shared.shared_dir(SparkSession.active()).removeprefix("file://")) / "treekin" / shared._RUN
    return [p.name for p in folder.iterdir()] if folder.exists() else []


@pytest.mark.parametrize("rows", ["empty", "odd"])
def test_odd_tables(spark, tmp_path, rows):
    """Nulls in any column, repeated rows, equal ids, and columns whose names the operators use."""
    rng = random.Random(61)
    good = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(80)) for _ in range(6)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, _bits string, _maybe string, key string, component_id long, label long, place string, `a.b` int, document string, copies long"
    extra = ("b", "m", "k", 9, 8, "p", 3, "d", 7)
    data = [(1, good[0], "en", "s", 5), (1, good[0], "en", "s", 5), (None, good[0], None, None, None), (2, good[0] + " tail", "en", "s", 5), (3, good[1], None, "t", None), (3, good[2], "en", "t", 1), (4, None, None, None, None), (5, "", "en", "s", 0), (6, good[3] + " " + good[4], "en", None, 2), (7, good[5], "en", "u", 2)]
    df = spark.createDataFrame([(*r, *extra) for r in (data if rows == "odd" else [])], kind)
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, good[4]), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = table(spark, f"file://{tmp_path}", "documents")
    seen = []
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = stage(f(spark, docs, f"file://{tmp_path}"), "t")
        assert docs.columns == df.columns and all(tuple(r)[5:] == extra for r in docs.collect())
        seen.append(sorted((str(r["doc_id"]) for r in docs.collect())))
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert out.count() == docs.count()
    if rows == "odd":
        assert seen[0] == ["1", "1", "2", "3", "3", "6", "7", "None"] and seen[1] == ["1", "1", "3", "3", "6", "7", "None"] and seen[2] == ["1", "1", "3", "3", "7", "None"]
        assert set(seen[3]) <= set(seen[2])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(map(str, (tuple(r) for r in QUERIES[name](spark, SMALL).select(*names).collect()))) == sorted(map(str, want.fetchall()))
