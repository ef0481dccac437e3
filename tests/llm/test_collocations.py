"""Operator 11 against brute force, with many and few slots, and with hashes that collide."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.conftest import SMALL
from treekin.llm import collocations
from treekin.llm.wordhash import mix

LOWER = {c: c + 32 for c in range(65, 91)}


def expected(rows, least, top):
    f, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = []
        for phrase, a in counts.items():
            if len(phrase) == 1 or a < least:
                continue
            l, r, score = min(((counts[phrase[:k]], counts[phrase[k:]], 10**6 * a * a // (counts[phrase[:k]] * counts[phrase[k:]])) for k in range(1, len(phrase))), key=lambda x: x[2])
            if len(phrase) == 2 and any(b >= least and 2 * b >= a and phrase in (p[:2], p[1:]) for p, b in counts.items() if len(p) == 3):
                continue
            found.append((-score, -a, " ".join(phrase).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def corpus(rng, n=120):
    words = [f"w{k}" for k in range(40)] + ["é", "Übung", "a\x00b", "😀", "x" * 300, "\x1c", "5:en"]
    fixed = ["New York City", "ad hoc", "per se", "w1 W2 w3", "a\x00b é 😀", "new york city hall"]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 60)):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words))
            parts.append(rng.choice([" ", " ", " ", "\t ", ". ", ", ", "\n", "!", ":", "  "]))
        rows.append((rng.choice(["en", "en", "en", "de", None, "und", "", "l:x"]), "".join(parts)))
    return rows + [("en", None), ("en", ""), ("en", " \t.,"), ("only", "one"), ("fr", "la la la " * 500)] + rows[:10]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, "x", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, name string, phrase string, a int")


def got(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("slots", [1 << 20, 40, 0])
def test_brute_force(spark, slots):
    """All candidates in slots, some of them, none; arrays in pieces."""
    small = {"slots": slots, "piece": 64, "most": 6000}
    rows = corpus(random.Random(slots + 1))
    docs = frame(spark, rows).repartition(9)
    assert got(collocations.phrase_collocations(docs, **small)) == expected(rows, 10, 2000)
    assert got(collocations.phrase_collocations(docs, least=3, top=7, **small)) == expected(rows, 3, 7)


def test_a_task_holds_few_phrases(spark, monkeypatch):
    """A task writes its counts whenever it holds many phrases, not once at its end: the result is the same."""
    rows = corpus(random.Random(5))
    staged = {}
    stage = collocations.stage

    def noted(df, name, *more):
        out = stage(df, name, *more)
        staged.setdefault(name, out.count() if name == "slot-arrays" else 0)
        return out

    monkeypatch.setattr(collocations, "stage", noted)
    docs = frame(spark, rows).coalesce(1)
    monkeypatch.setattr(collocations, "spread", lambda df: df)
    assert got(collocations.phrase_collocations(docs, most=2000, held=500)) == expected(rows, 10, 2000)
    assert staged["slot-arrays"] > 2


@pytest.mark.parametrize("slots", [1 << 20, 40, 0])
def test_rows_of_phrases_are_short(spark, monkeypatch, slots):
    """However many phrases a batch has, with slots or without, no row that is written holds all of them, and the result is the same."""
    from pyspark import cloudpickle
    from pyspark.sql import functions as F

    monkeypatch.setattr(collocations, "ROW_BYTES", 4000, raising=False)
    monkeypatch.setattr(collocations, "NAMED", 30, raising=False)
    longest, stage = [], collocations.stage

    def noted(df, name, *more):
        out = stage(df, name, *more)
        if name == "slot-arrays":
            bytes_of = [F.coalesce(F.octet_length(F.concat_ws("", c)), F.lit(0)) for c in ("names", "other")]
            longest.append(out.select(F.max(bytes_of[0] + bytes_of[1])).first()[0])
        return out

    monkeypatch.setattr(collocations, "stage", noted)
    rows = corpus(random.Random(6)) + [("long", " ".join(f"word{k}" for k in range(600)))] * 10
    # tasks import the module anew, unless it goes with the functions that run there
    cloudpickle.register_pickle_by_value(collocations)
    try:
        assert got(collocations.phrase_collocations(frame(spark, rows).repartition(2), slots=slots)) == expected(rows, 10, 2000)
    finally:
        cloudpickle.unregister_pickle_by_value(collocations)
    assert len(longest) == 3 and max(longest) < 5000


def test_colliding_hashes():
    """Phrases with one hash: each slot counts its own, the others are counted by name."""
    import pyarrow as pa

    sums = collocations.SlotCounts(4)
    names = pa.array(["a", "b", "c", "a"], pa.large_string())
    assert sums.own(np.array([1, 1, 2, 1]), names).tolist() == [True, False, True, True]
    assert sums.own(np.array([1, 2, 0]), pa.array(["b", "c", "d"], pa.large_string())).tolist() == [False, True, True]


def test_collisions_in_the_whole(spark, monkeypatch):
    """Words share hashes in the tasks: the result is the same."""
    real = collocations.words_of

    def weak(*args, **kwargs):
        w = real(*args, **kwargs)
        w.hashes = w.hashes % np.uint64(23)
        return w

    rows = corpus(random.Random(4), 60)
    # tasks import the module anew, unless it goes with the functions that run there
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(collocations)
    monkeypatch.setattr(collocations, "words_of", weak)
    try:
        assert got(collocations.phrase_collocations(frame(spark, rows).repartition(5), slots=200, most=6000)) == expected(rows, 10, 2000)
    finally:
        cloudpickle.unregister_pickle_by_value(collocations)


def test_perfect_hash():
    rng = np.random.Generator(np.random.PCG64(1))
    keys = np.unique(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64))
    mph = collocations.PerfectHash(keys)
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))
    others = mix(keys) | np.uint64(1 << 63)
    assert (mph.slots(others) == -1).all() and (collocations.PerfectHash(keys[:0]).slots(keys[:5]) == -1).all()


def test_exact_arithmetic(spark):
    """Products beyond 64 bits, and ties after flooring: the first cut."""
    rows = [("en", "a b c", 3, 3_000_000_007, 3_000_000_011, 4_000_000_000, 3_000_000_009, 3_500_000_000), ("en", "d e f", 3, 10, 100, 10, 10, 100), ("en", "g h", 2, 10, 12, 13, None, None)]
    df = spark.createDataFrame(rows, "lang string, phrase string, words int, a long, l1 long, r1 long, l2 long, r2 long")
    found = {r["phrase"]: (r["l"], r["r"], r["score"]) for r in collocations.scored(df).collect()}
    a, l, r = rows[0][3:6]
    assert found == {"a b c": (l, r, 10**6 * a * a // (l * r)), "d e f": (100, 10, 100_000), "g h": (12, 13, 641_025)}


def test_empty(spark):
    assert got(collocations.phrase_collocations(frame(spark, []))) == [] == got(collocations.phrase_collocations(frame(spark, [(None, None), ("en", "a b")])))


def test_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    want = sorted(db.execute(f"SELECT {', '.join(names)} FROM ({collocations.ORACLE})").fetchall())
    assert len(want) > 100 and got(collocations.op11_phrase_collocations(spark, SMALL)) == want
