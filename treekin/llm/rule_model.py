"""Quality classifier (operator 12): a sparse ensemble of rules over a text's statistics.

Method.  Statistics of a text (lengths, shares of kinds of characters, distinct words, repeated lines) are Spark expressions.  Shallow
boosted trees are grown on a sample of labelled rows; the path to each of their nodes is a conjunctive rule.  A logistic regression with an
L1 penalty over the rules leaves few of them, and these are compiled into one Spark expression: the score of a text is the logistic
function of an intercept and the weights of the rules that hold.  So every text is scored by the JVM alone, in the scan.

Learning.  Only rows of labels whose ``crc32(doc_id)`` isn't divisible by 5 are read, ``SAMPLE_ROWS`` of them at most, the first ones in
the order of a hash of the id (a documented bound of what comes to the driver, 8 bytes a statistic); the penalty is chosen on
a fifth of that sample.  Scores see the text alone.

Edge cases.  Null text is empty text, whose statistics are 0.  Labels other than 0 and 1 (null among them) are left out; a document that is labelled
twice counts twice.  Without labels of both classes every score is the share of label 1, (n1 + 1) / (n + 2).  A null doc_id is held out.
Repeated rows are scored alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treekin.shared import table

SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, LEAST_ROWS = 24, 3, 24, 20
PENALTIES = (0.0003, 0.001, 0.003, 0.01)
THRESHOLD = 0.3


# --- statistics


def _count(text: Column, others: str) -> Column:
    """Characters that are left when those of the class `others` go."""
    return F.char_length(F.regexp_replace(text, others, ""))


def statistics(rows: DataFrame, text: Column) -> DataFrame:
    """rows with one double column for each of STATISTICS, of a text that isn't null."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    counts = {
        "chars": F.char_length(text), "letters": _count(text, r"[^\p{L}]+"), "upper": _count(text, r"[^\p{Lu}]+"), "digits": _count(text, "[^0-9]+"), "symbols": _count(text, r"[^#*$%&|<>@^~=+\\/{}\[\]_-]+"),
        "stops": _count(text, r"[^.,;:!?]+"), "shouts": _count(text, "[^!?]+"), "words": words, "lines": lines,
    }
    keep = [F.col(f"`{c}`") for c in rows.columns]
    a = rows.select(*keep, *[v.alias(f"_{k}") for k, v in counts.items()])
    sizes = {
        "n_words": F.size("_words"), "n_distinct": F.size(F.array_distinct("_words")), "longest": F.coalesce(F.array_max(F.transform("_words", F.char_length)), F.lit(0)),
        "n_lines": F.size("_lines"), "n_distinct_lines": F.size(F.array_distinct("_lines")),
    }
    b = a.select("*", *[v.alias(f"_{k}") for k, v in sizes.items()])
    c = {k: F.col(f"_{k}").cast("double") for k in ("chars", "letters", "upper", "digits", "symbols", "stops", "shouts", *sizes)}
    per = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    spaceless = F.greatest(c["letters"] + c["digits"] + c["symbols"] + c["stops"], F.lit(1.0))
    made = {
        "words": F.log1p(c["n_words"]), "distinct": per(c["n_distinct"], c["n_words"]), "richness": per(c["n_distinct"], F.sqrt(c["n_words"])), "word_length": per(c["letters"], c["n_words"]),
        "longest": F.log1p(c["longest"]), "letters": c["letters"] / spaceless, "upper": per(c["upper"], c["letters"]), "digits": c["digits"] / spaceless, "symbols": per(c["symbols"], c["n_words"]),
        "stops": per(c["stops"], c["n_words"]), "shouts": per(c["shouts"], c["n_words"]), "spaces": per(c["chars"] - spaceless, c["n_words"]), "line_words": F.log1p(per(c["n_words"], c["n_lines"])),
        "repeated_lines": per(c["n_lines"] - c["n_distinct_lines"], c["n_lines"]),
    }
    return b.select(*keep, *[made[k].alias(k) for k in STATISTICS])


STATISTICS = ("words", "distinct", "richness", "word_length", "longest", "letters", "upper", "digits", "symbols", "stops", "shouts", "spaces", "line_words", "repeated_lines")


# --- rules

#: A rule: conditions (statistic, above, threshold), each `value > threshold` or `value <= threshold`.
Rule = tuple[tuple[str, bool, float], ...]


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[float, Rule], ...] = ()

    def column(self) -> Column:
        """The score, over columns named like the statistics."""
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            total = total + F.when(_holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The same, over an array with a column for each of STATISTICS."""
        total = np.full(len(x), self.intercept)
        for weight, rule in self.rules:
            total += weight * _mask(x, rule)
        return 1 / (1 + np.exp(-total))


def _holds(rule: Rule) -> Column:
    out = None
    for name, above, at in rule:
        one = F.col(name) > F.lit(at) if above else F.col(name) <= F.lit(at)
        out = one if out is None else out & one
    return out


def _mask(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, at in rule:
        v = x[:, STATISTICS.index(name)]
        out &= v > at if above else v <= at
    return out


def _simple(conditions: Iterable[tuple[str, bool, float]]) -> Rule:
    """Of several conditions on one side of one statistic the strictest."""
    best: dict[tuple[str, bool], float] = {}
    for name, above, at in conditions:
        key = (name, above)
        best[key] = at if key not in best else max(best[key], at) if above else min(best[key], at)
    return tuple((n, up, at) for (n, up), at in sorted(best.items()))


def _tree(bins: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, rows: np.ndarray, depth: int, path: tuple) -> list[tuple[tuple, np.ndarray]]:
    """(path, rows) of all nodes below one: each split is the best one of the residuals' squared error."""
    if not depth or len(rows) < 2 * LEAST_ROWS:
        return []
    best, g = (1e-9, 0, 0), gradient[rows]
    for k in range(bins.shape[1]):
        n = np.cumsum(np.bincount(bins[rows, k], minlength=len(edges[k]) + 1))[:-1]
        s = np.cumsum(np.bincount(bins[rows, k], g, minlength=len(edges[k]) + 1))[:-1]
        ok = (n >= LEAST_ROWS) & (len(rows) - n >= LEAST_ROWS)
        if ok.any():
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (g.sum() - s) ** 2 / np.maximum(len(rows) - n, 1), -1)
            at = int(gain.argmax())
            best = max(best, (float(gain[at] - g.sum() ** 2 / len(rows)), k, at))
    if best[0] <= 1e-9:
        return []
    _, k, at = best
    low, out = bins[rows, k] <= at, []
    for above, part in ((False, rows[low]), (True, rows[~low])):
        here = (*path, (STATISTICS[k], above, float(edges[k][at])))
        below = _tree(bins, edges, gradient, part, depth - 1, here)
        out += [(here, part), *below]
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 12) -> list[Rule]:
    """The paths to all nodes of boosted trees, each once."""
    rng = np.random.Generator(np.random.PCG64(seed))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    total, found = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        drawn = np.flatnonzero(rng.random(len(y)) < 0.6)
        nodes = _tree(bins, edges, y - p, drawn, DEPTH, ())
        inner = {path[:-1] for path, _ in nodes}
        for path, rows in nodes:
            rule = _simple(path)
            found.setdefault(rule)
            if path not in inner:  # a leaf: one Newton step, over all rows that it holds
                step = (y[rows] - p[rows]).sum() / ((p[rows] * (1 - p[rows])).sum() + 1.0)
                total += 0.3 * step * _mask(x, rule)
    return list(found)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of the logistic regression of y on z with an L1 penalty, by accelerated proximal steps."""
    n = len(y)
    step = 4 * n / (np.linalg.norm(z, 2) ** 2 + n) if z.shape[1] else 4.0
    w = v = np.zeros(z.shape[1])
    b = c = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    t = 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(z @ v + c))) - y
        w0, b0 = w, b
        w = v - step * (z.T @ r) / n
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        b = c - step * r.mean()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c, t = w + (t - 1) / s * (w - w0), b + (t - 1) / s * (b - b0), s
    return float(b), w


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """x: a column for each of STATISTICS; y: 0 or 1."""
    if not y.any() or y.all():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(share / (1 - share))))
    rules = tree_rules(x, y)
    z = np.stack([_mask(x, r) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    test = np.arange(len(y)) % 5 == 0

    def loss(penalty: float) -> float:
        b, w = lasso(z[~test], y[~test], penalty, 200)
        s = z[test] @ w + b
        return float(np.mean(np.logaddexp(0, s) - y[test] * s)) if test.any() else 0.0

    b, w = lasso(z, y, min(PENALTIES, key=lambda p: (round(loss(p), 4), -p)))
    return RuleModel(b, tuple((float(a), r) for a, r in zip(w, rules, strict=True) if abs(a) > 1e-6))


# --- documents


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def _text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    """labels: (id_col, label).  The model of rows that aren't held out."""
    mine = labels.select(F.col(id_col).alias("key"), F.col(label).alias("y")).where(F.col("y").isin(0, 1) & F.col("key").isNotNull())
    order = [F.xxhash64(F.col("key"), F.lit(12)), F.col("key"), F.col("y")]
    # sample_rows rows of two numbers, so they can be broadcast
    chosen = mine.where(~held_out(F.col("key"))).orderBy(*order).limit(sample_rows)
    rows = _text(docs, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("key"))
    made = statistics(rows.select("key", "y", "text"), F.col("text")).select("key", "y", *STATISTICS)
    # documents may share an id
    found = made.orderBy(*order, *STATISTICS).limit(sample_rows).toPandas()
    return fit(found[list(STATISTICS)].to_numpy(float).reshape(-1, len(STATISTICS)), found["y"].to_numpy(float))


def quality_scores(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: (doc_id, score), from its text alone."""
    rows = statistics(_text(docs, id_col, text_col), F.col("text"))
    return rows.select("doc_id", model.column().alias("score"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
