"""Operator 12: held-out accuracy, its compiled expression against the rules, and edge cases."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.test_text_operators import ODD, frame
from treekin.llm import rule_model
from treekin.shared import table


def made(rng, good):
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(60, 200))]
    if good:
        return " ".join(words) + "."
    kind = rng.randrange(4)
    if kind == 0:
        return " ".join(w + rng.choice(["###", "&&&", "$$$"]) for w in words)
    if kind == 1:
        return " ".join(words[:3] * 40)
    return " ".join(words).upper() + "!!" if kind == 2 else "\n".join([" ".join(words[:9])] * 20)


def labelled(spark, n=900, seed=5):
    rng = random.Random(seed)
    marks = [int(rng.random() < 0.7) for _ in range(n)]
    docs = frame(spark, [made(rng, m) for m in marks])
    labels = spark.createDataFrame([(i, m, 0, "x") for i, m in enumerate(marks)] + [(None, 1, 0, "x"), (3, None, 0, "x"), (4, 7, 1, "x")], "doc_id long, quality int, toxic int, text string")
    return docs, labels, marks


def test_held_out_accuracy(spark):
    docs, labels, marks = labelled(spark)
    model = rule_model.train(docs, labels)
    found = {r["doc_id"]: r["score"] for r in rule_model.quality_scores(docs, model).collect()}
    held = [i for i in range(len(marks)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and sum((found[i] >= 0.3) == marks[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in found.values())
    # sparse: far fewer rules than paths, each a conjunction of statistics
    assert 0 < len(model.rules) and all(1 <= len(r) <= 6 and {n for n, _, _ in r} <= set(rule_model.STATISTICS) for _, r in model.rules)
    # the compiled expression and the rules agree
    rows = rule_model.statistics(docs.select("doc_id", "text"), F.col("text")).orderBy("doc_id").collect()
    x = np.array([[r[c] for c in rule_model.STATISTICS] for r in rows])
    assert np.allclose(model.scores(x), [found[r["doc_id"]] for r in rows])


def test_labels_that_are_held_out_change_nothing(spark):
    docs, labels, _ = labelled(spark, 300)
    turned = labels.withColumn("quality", F.when(rule_model.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    model = rule_model.train(docs, labels)
    assert model == rule_model.train(docs, turned) == rule_model.train(docs.repartition(7), labels.repartition(3))


def test_lasso_is_sparse_and_right():
    rng = np.random.Generator(np.random.PCG64(3))
    z = (rng.random((2000, 30)) < 0.5).astype(float)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(3 * z[:, 4] - 2 * z[:, 9])))).astype(float)
    b, w = rule_model.lasso(z, y, 0.01)
    assert set(np.argsort(-np.abs(w))[:2].tolist()) == {4, 9} and w[4] > 1 > 0 > w[9] and (np.abs(w) < 1e-9).sum() > 15
    # optimality: the gradient is within the penalty, and at it where a weight isn't 0
    g = z.T @ (1 / (1 + np.exp(-(z @ w + b))) - y) / len(y)
    assert np.abs(g).max() < 0.0102 and np.allclose(g[w != 0], -0.01 * np.sign(w[w != 0]), atol=2e-4)


def test_rules_keep_the_strictest_condition():
    rule = rule_model._simple([("upper", True, 0.1), ("upper", True, 0.4), ("upper", False, 0.9), ("words", False, 3.0), ("words", False, 2.0)])
    assert rule == (("upper", False, 0.9), ("upper", True, 0.4), ("words", False, 2.0))


def test_odd_texts_and_empty_tables(spark):
    docs, labels, _ = labelled(spark, 300)
    model = rule_model.train(docs, labels)
    odd = frame(spark, ODD + ODD[:3], ids=[*range(len(ODD)), None, 0, 1])
    rows = rule_model.quality_scores(odd, model).collect()
    assert len(rows) == len(ODD) + 3 and all(0 <= r["score"] <= 1 for r in rows)
    assert rule_model.quality_scores(frame(spark, []), model).collect() == []
    # no labels, labels of one class, no documents
    one = labels.where("quality = 1 OR quality IS NULL")
    n = sum(1 for r in one.collect() if r["quality"] == 1 and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5)
    share = lambda m: rule_model.quality_scores(odd, m).first()["score"]
    assert abs(share(rule_model.train(docs, one)) - (n + 1) / (n + 2)) < 1e-12
    assert share(rule_model.train(docs, labels.where("false"))) == 0.5 == share(rule_model.train(frame(spark, []), labels))


def test_query(spark):
    rows = rule_model.op12_quality_classifier(spark, SMALL).collect()
    assert len(rows) == table(spark, SMALL, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
