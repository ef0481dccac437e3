"""Operator 5: quality rules as a short-circuit cascade, with DataFrame functions only.

Method.  Every rule is one expression of the text and of its counts.  Its cost and its selectivity (share of rows it rejects) are estimated
on a sample of about ``SAMPLE_ROWS`` rows drawn over the whole table: one job evaluates all rules on each row and reads the executor's clock
before and after each, so the cost is that of the rule and not of a job.  The rules are then ordered by rejection per cost, and one CASE
expression tests them in that order and stops at the first that rejects.  The order changes the time only: a document is kept if no rule
rejects it.  Words are counted once for all rules; counts that a report has anyway cost its rules nothing.

Counts that need the words of a text at several places bind them once, by ``transform(array(x), x -> ...)``; so an
expression stays linear in the text, whatever the optimiser moves or merges.

Edge cases.  Null text counts as empty: all counts 0, rejected for having under 50 words.  Very long texts are handled
whole, in O(n log n).  Repeated rows and clashing extra columns keep their place: rules see the text column only.  An empty
table gives an empty result (the order is then that of the list).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treekin.shared import drop_stage, stage, table

SAMPLE_ROWS = 2000
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def bind(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeats(words: Column) -> Column:
    """Words in three-word windows found twice or more."""

    def count(windows: Column) -> Column:
        m = F.size(windows)

        def spread(s: Column) -> Column:
            same = lambda a, b: s[a]["h"] == s[b]["h"]
            hit = lambda k: ((k > 0) & same(F.greatest(k - 1, F.lit(0)), k)) | ((k < m - 1) & same(F.least(k + 1, m - 1), k))
            places = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), m - 1), hit), lambda k: s[k]["p"]))
            return bind(places, lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"]))

        marked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(windows)) < m, bind(marked, spread)).otherwise(F.lit(0))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) >= 3, bind(windows, count)).otherwise(F.lit(0)).cast("long")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_stats(text: Column) -> Column:
    """(n_words, n_repeat_words) from one split of the text."""
    return bind(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeats(w).alias("n_repeat_words")))


def word_chars(text: Column) -> Column:
    spaces = sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in " \t\n\x0b\x0c\r"), F.lit(0))
    return (F.char_length(text) - spaces).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")


def line_stats(text: Column) -> Column:
    """(n_lines, n_dup_lines) over lines with a word."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))


def base_failed(n: Column, repeats: Column) -> Column:
    return (n < 50) | (100 * repeats > 50 * n)


class Counts:
    """Counts of a text: those that are known, and expressions for the others."""

    def __init__(self, text: Column, **known: Column):
        self._text, self._known = text, known

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._known[name] if name in self._known else _COUNTS[name](self._text)


_COUNTS: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols,
    "n_repeat_words": lambda t: word_stats(t)["n_repeat_words"], "lines": line_stats,
}


@dataclass(frozen=True)
class Rule:
    """reject: of a text column that isn't null and its Counts, whether the rule rejects it."""

    name: str
    reject: Callable[[Column, Counts], Column]


def _repeated_lines(lines: Column) -> Column:
    """Over 30 of 100 lines, and three at least: one line that comes back in a short text is no sign of anything."""
    return bind(lines, lambda s: (s["n_dup_lines"] >= 3) & (100 * s["n_dup_lines"] > 30 * s["n_lines"]))


def _shouting(text: Column) -> Column:
    """Over 60 of 100 ASCII letters in upper case, where case is in use at all."""
    upper = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    lower = F.char_length(F.regexp_replace(text, "[^a-z]+", ""))
    return (upper > 0) & (100 * upper > 60 * (upper + lower))


BASE_RULES = (Rule("few_words", lambda t, c: c.n_words < 50), Rule("repeated_words", lambda t, c: 100 * c.n_repeat_words > 50 * c.n_words))
RULES = (
    Rule("symbols", lambda t, c: 100 * c.n_symbols > 30 * c.n_words),
    Rule("repeated_lines", lambda t, c: _repeated_lines(c.lines)),
    Rule("word_length", lambda t, c: bind(c.word_chars, lambda n: (n < 2 * c.n_words) | (n > 15 * c.n_words))),
    Rule("shouting", lambda t, c: _shouting(t)),
    Rule("few_letters", lambda t, c: 2 * F.char_length(F.regexp_replace(t, r"[^\p{L}]+", "")) < c.word_chars),
)


def _clock() -> Column:
    return F.call_function("reflect", F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")


def measured(sample: DataFrame, rules: Sequence[Rule]) -> list[tuple[float, float]]:
    """sample: (text), none null.  Of each rule the share of rows that it rejects and its nanoseconds a row.

    Fields of a struct are evaluated in their order, so a rule runs between two readings of the clock.
    """

    def timed(rule: Rule, text: Column, counts: Counts) -> Column:
        hit = F.coalesce(rule.reject(text, counts), F.lit(False)).cast("long")
        return bind(_clock(), lambda began: F.struct(hit.alias("hit"), (_clock() - began).alias("ns")))

    t = F.col("text")
    each = bind(n_words(t), lambda n: F.array(*[timed(rule, t, Counts(t, n_words=n)) for rule in rules]))
    rows = sample.select(each.alias("r"))
    out = rows.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("r")[i][c]).alias(f"{c}{i}") for i in range(len(rules)) for c, f in (("hit", F.sum), ("ns", F.sum))]).first()
    return [(out[f"hit{i}"] / out["n"], out[f"ns{i}"] / out["n"]) if out["n"] else (0.0, 1.0) for i in range(len(rules))]


def ordered_rules(df: DataFrame, text_col: str, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per cost on a sample, best first; ties and rules that reject nothing keep their order."""
    total = df.count()
    if not total or not rules:
        return list(rules)
    part = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = stage(part.sample(min(1.0, sample_rows / total), seed=5).repartition(8) if total > sample_rows else part, "quality-sample")
    gains = [share / max(ns, 1.0) for share, ns in measured(sample, rules)]
    drop_stage(sample)
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -gains[i])]


def cascade(text: Column, rules: Sequence[Rule], counts: Counts) -> Column:
    """Whether no rule rejects; rules after the first that does aren't evaluated."""
    case = None
    for rule in rules:
        hit = rule.reject(text, counts)
        case = F.when(hit, False) if case is None else case.when(hit, False)
    return case.otherwise(True) if case is not None else F.lit(True)


def quality_filter(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = BASE_RULES + RULES) -> DataFrame:
    """The rows that no rule rejects, with the columns they had."""
    order, t = ordered_rules(df, text_col, rules), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.where(bind(n_words(t), lambda n: cascade(t, order, Counts(t, n_words=n))))


def quality_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per row: the base counts, whether they fail, and the cascade's verdict."""
    order = ordered_rules(df, text_col, rules)
    t = F.col("text")
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", word_stats(t).alias("w"), word_chars(t).alias("word_chars"), n_symbols(t).alias("n_symbols"), line_stats(t).alias("lines"))
    known = {"n_words": F.col("w.n_words"), "n_repeat_words": F.col("w.n_repeat_words"), **{c: F.col(c) for c in ("word_chars", "n_symbols", "lines")}}
    failed = base_failed(known["n_words"], known["n_repeat_words"])
    return rows.select(
        "doc_id", "w.n_words", "word_chars", "n_symbols", F.col("lines.n_dup_lines").alias("n_dup_lines"), "w.n_repeat_words", failed.alias("base_failed"),
        F.when(failed, False).otherwise(cascade(t, order, Counts(t, **known))).alias("kept"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS row_no, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, row_no, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t
), c AS (
  SELECT doc_id, row_no, text, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower,
         length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters
  FROM w
), g AS (
  SELECT row_no, words, unnest(range(1, len(words) - 1)) AS p FROM w
), h AS (
  SELECT row_no, p, count(*) OVER (PARTITION BY row_no, words[p], words[p + 1], words[p + 2]) AS n FROM g
), r AS (
  SELECT row_no, CAST(count(DISTINCT q) AS BIGINT) AS n_repeat_words
  FROM (SELECT row_no, p + unnest([0, 1, 2]) AS q FROM h WHERE n > 1) GROUP BY row_no
), s AS (
  SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM c LEFT JOIN r USING (row_no)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 30 * n_words OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR (n_upper > 0 AND 100 * n_upper > 60 * (n_upper + n_lower)) OR 2 * n_letters < word_chars) AS kept
FROM f
"""
