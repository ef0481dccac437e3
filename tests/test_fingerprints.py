import random

import pytest
from pyspark.sql import functions as F

from treekin.functions import hashing

P, M = 1_000_003, (1 << 61) - 1


def poly(xs):
    h = 0
    for x in xs:
        h = (h * P + x) % M
    return h


def literal(tokens, k, w):
    hs = [poly(map(ord, t)) for t in tokens]
    if not hs:
        return set()
    grams = [poly(hs[i : i + k]) for i in range(max(1, len(hs) - k + 1))]
    return {min(grams[i : i + w]) for i in range(max(1, len(grams) - w + 1))}


def run(spark, rows, k, w):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, t array<string>")
    out = df.select("id", hashing.fingerprints(F.col("t"), k, w).alias("f")).collect()
    return {r["id"]: r["f"] for r in out}


def test_token_hash_values(spark):
    want = {"identifier": 348638641506766093, "if_statement": 18062459147732763, "binary_expression:+": 661456148245138213, "größe": 2256358942226314391, "": 0, "a😀b": poly(map(ord, "a😀b"))}
    want[None] = None
    df = spark.createDataFrame([(t,) for t in want], "t string").select("t", hashing.token_hash(F.col("t")).alias("h"))
    assert {r["t"]: r["h"] for r in df.collect()} == want


def test_winnowing_equals_the_literal_algorithm(spark):
    rng = random.Random(4)
    rows = [[rng.choice(["if", "expr", "größe", "x" * 40, "", "call", "id"]) for _ in range(n)] for n in [0, 1, 2, 4, 5, 6, 8, 9, 30, 70] * 3]
    for k, w in ((5, 4), (3, 3), (2, 2), (1, 1)):
        got = run(spark, rows, k, w)
        for i, row in enumerate(rows):
            assert set(got[i]) == literal(row, k, w) and got[i] == sorted(got[i])


def test_winnowing_properties(spark):
    words = "open read parse check store close".split()
    moved = run(spark, [words, words[3:] + words[:3]], 2, 2)
    assert set(moved[0]) & set(moved[1])
    apart = run(spark, [words, "alpha beta gamma delta epsilon zeta".split()], 2, 2)
    assert not set(apart[0]) & set(apart[1])
    assert len(run(spark, [["alone"]], 5, 4)[0]) == 1 and run(spark, [None], 5, 4)[0] == []


def test_parts_of_the_hash(spark):
    rng = random.Random(5)
    rows = [None, [], *([rng.choice(["", "a", "é", "x" * 200, "😀" * 70, "if"]) for _ in range(n)] for n in (1, 3, 4, 5, 30))]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, t array<string>")
    out = df.select("id", hashing.token_hashes("t").alias("h")).select("id", "h", hashing.kgram_hashes(F.col("h"), 4).alias("g")).select("*", hashing.winnow(F.col("g"), 3).alias("w"))
    for r in out.collect():
        hs = [poly(map(ord, t)) for t in rows[r["id"]] or []]
        grams = [poly(hs[i : i + 4]) for i in range(max(1, len(hs) - 3))] if hs else []
        assert r["h"] == hs and r["g"] == grams and r["w"] == sorted({min(grams[i : i + 3]) for i in range(max(1, len(grams) - 2))} if grams else [])


def test_batches_are_handled_in_parts(monkeypatch):
    """So that what a task needs does not grow with the batch that it is given."""
    import pyarrow as pa

    monkeypatch.setattr(hashing, "TOGETHER", 10)
    column = pa.array([[1] * n if n is not None else None for n in (3, 7, None, 0, 25, 4, 4, 4, 0)], pa.list_(pa.int64()))
    seen = []

    def run(part):
        seen.append(len(part.flatten()))
        return part

    assert hashing._in_parts(run)(column).to_pylist() == column.to_pylist() and seen == [10, 25, 8, 4]
    assert hashing._in_parts(run)(column[:0]).to_pylist() == []


@pytest.mark.parametrize("k, w", [(0, 4), (5, 0)])
def test_parameters_are_checked(k, w):
    with pytest.raises(ValueError):
        hashing.kgram_hashes(None, k) if k < 1 else hashing.winnow(None, w)
