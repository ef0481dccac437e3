"""Operator 4: personal data by weak supervision, with DataFrame functions only.

Method.  Regular expressions find candidate spans of four kinds: those of the base, and other forms (``EXTRA``), which are never base spans:
addresses written out (``name [at] host [dot] org``), IPv6, cards with dots, phone numbers in national forms or with 00.  Three labelers vote
on each candidate, or abstain: a pattern labeler (does the span meet the kind's own check), a gazetteer labeler (top-level domains, calling
codes, issuers of cards, reserved address ranges) and a context labeler (words just before the span).  Expectation-maximisation over the
counts of vote patterns, of which there are at most 27 for each kind, estimates every labeler's reliability and each pattern's
posterior.  A naive Bayes span classifier is then trained on all candidates, weighted by those posteriors; it sees the span's form (which
pattern, length, separators) and the characters on both sides, not the votes.  Candidates it scores at ``threshold`` or more are added to
the base spans, which always stay.

Base spans, leftmost and not overlapping within a kind:
email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip: four groups of digits joined by dots, none above 255;
card: digits with single spaces or hyphens between, 12 to 19 of them, that pass Luhn's test; phone: ``+`` and a digit, then
digits, spaces and ``().-`` up to a digit, 9 to 15 digits.  The expressions below find the same spans in time linear in the
text: a run of characters is tried from its beginning only, and loops are possessive where backtracking cannot help.

Places are code points, the end exclusive.  They come from the lengths of the matches and of the pieces between them.

Edge cases.  Null text is empty and has no span.  Very long texts are handled whole.  Repeated rows give repeated results.  An
empty table gives an empty result, and with no candidate of a kind nothing is added.  Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treekin.llm.quality import bind
from treekin.shared import drop_stage, stage, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_AT, _DOT = r" ?(?:\[at\]|\(at\)|\{at\}) ?", r" ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?"
_HOST = "[A-Za-z0-9-]++"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Other forms of each kind, candidates that are never base spans.
EXTRA = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+(?:{_AT}{_HOST}(?:{_DOT}{_HOST}){{1,4}}+| at {_HOST}(?: dot {_HOST}){{1,4}}+)",
    "ip": rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9.])[0-9]{4}(?:\.[0-9]{4}){3}(?![0-9.])",
    "phone": "(?<![0-9+().-])(?<![0-9+().-] )(?:"
    r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"  # North America
    r"|00 ?[1-9][0-9]{0,2}[ .-][0-9](?:[ .-]?[0-9]){5,11}"  # with an international prefix
    r"|\(0[1-9][0-9]{0,4}\) ?[0-9](?:[ .-]?[0-9]){4,8}"  # an area code in brackets
    r"|0[1-9](?:[ .-][0-9]{2}){4}|0[1-9][0-9]{1,4}[ /-][0-9]{3,4}(?:[ .-]?[0-9]{2,4}){1,2}"  # groups after a leading zero
    ")(?![0-9])(?!-[0-9])",
}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
#: Country codes of the numbering plan, zone by zone: of one, two or three digits.
_CODES = r"(?:1|7|2(?:[07]|[1-689][0-9])|3(?:[0-469]|[578][0-9])|4(?:[013-9]|2[0-9])|5(?:[1-8]|[09][0-9])|6(?:[0-6]|[7-9][0-9])|8(?:[1246]|[0578][0-9])|9(?:[0-58]|[679][0-9]))"
GAZETTEER = {
    # country domains have two letters, and no others do; then generic ones
    "email": r"\.(?:[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|pro|aero|coop|museum|jobs|mobi|travel|cat|tel|post|asia|app|dev|xyz|online|site|shop|store|blog|cloud|tech|email)$",
    # not in a range reserved for special use; for version 6, global unicast
    "ip": r"^(?!0\.|10\.|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|127\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.0\.[02]\.|192\.168\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|22[4-9]\.|2[3-5][0-9]\.|[0-9a-f]*:)|^[23][0-9a-f]{3}:",
    # issuers' ranges and lengths
    "card": r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}|3(?:0[0-5]|[689][0-9])[0-9]{11,13}|35(?:2[89]|[3-8][0-9])[0-9]{12}"
    r"|6(?:011|4[4-9][0-9]|5[0-9]{2})[0-9]{12}|62[0-9]{14,17}|(?:50|5[6-9]|6[0-9])[0-9]{10,17})$",
    "phone": rf"^(?:\+|00 ?){_CODES}|^(?!00)\(?0?[1-9]",
}
CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|write|adresse|correo|courriel)\P{L}*$",
    "ip": r"(?i)(?:\bip(?:v[46])?|host|server|addr\w*|client|login from)\P{L}*$",
    "card": r"(?i)(?:card|visa|mastercard|credit|debit|karte|carte|tarjeta)\P{L}*$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|telefon|téléphone|teléfono)\w*\P{L}*$",
}
CANDIDATE = "array<struct<start:bigint,kind:int,end:bigint,base:boolean,a:int,b:int,c:int,form:int,shape:int,seps:int,before:int,after:int>>"
ROUNDS = 25


def running_sums(lengths: Column) -> Column:
    """Sums of the elements before each one.  Two levels of 64, so that long arrays take no quadratic copying."""

    def scan(x: Column, base: Column) -> Column:
        start = F.struct(base.cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(x, start, lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def blocks(x: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 64).cast("int"))
        sums = F.transform(numbers, lambda i: F.aggregate(F.slice(x, i * 64 + 1, F.lit(64)), F.lit(0).cast("long"), lambda s, v: s + v))
        return bind(scan(sums, F.lit(0)), lambda bases: F.flatten(F.transform(bases, lambda base, i: scan(F.slice(x, i * 64 + 1, F.lit(64)), base))))

    return F.when(F.size(lengths) > 0, bind(lengths, blocks)).otherwise(F.array().cast("array<long>"))


def _check(kind: str, m: Column, digits: Column) -> Column:
    """Whether a match of the kind's pattern is a base span."""
    if kind == "ip":
        return m.rlike(OCTETS)
    if kind == "card":
        return F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _plain(kind: str, m: Column) -> Column:
    """A match as the gazetteer has it."""
    if kind == "email":
        at = F.regexp_replace(F.lower(m), r" ?(?:\[at\]|\(at\)|\{at\}) ?| at ", "@")
        return F.regexp_replace(at, r" ?(?:\[dot\]|\(dot\)|\{dot\}) ?| dot | ?\. ?", ".")
    return F.regexp_replace(m, "[ .-]", "") if kind == "card" else F.lower(m)


def _side(c: Column) -> Column:
    """Kinds of neighbouring characters: none, white space, punctuation that leads up to a value, brackets and quotes, letters and digits, others."""
    case = F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[:=,;.]"), 2)
    return case.when(c.rlike(r"[()\[\]{}<>\"']"), 3).when(c.rlike(r"[\p{L}\p{N}]"), 4).otherwise(5).cast("int")


def _candidates(text: Column, kind: str, pattern: str, base: bool, gate: Column) -> Column:
    number = KINDS.index(kind)

    def described(matches: Column) -> Column:
        def located(pieces: Column) -> Column:
            lengths = F.transform(matches, lambda m, i: (F.length(pieces[i]) + F.length(m)).cast("long"))

            def spans(before: Column) -> Column:
                def one(m: Column, i: Column) -> Column:
                    start = before[i] + F.length(pieces[i])
                    digits = F.regexp_replace(m, "[^0-9]", "")
                    seps = F.least(F.length(m) - F.length(F.regexp_replace(m, r"[ .:@()\[\]{}/-]", "")), F.lit(9)).cast("int")
                    # what comes just before, by bytes of the piece: linear in the text
                    near = F.right(pieces[i], F.lit(32))
                    if base:
                        ok = _check(kind, m, digits)
                        strict = (ok & m.rlike(r"\.[A-Za-z]{2,}$")) if kind == "email" else (ok & ~m.rlike(r"(?:^|\.)0[0-9]")) if kind == "ip" else ok
                    else:
                        strict = _plain(kind, m).rlike(r"@.+\.[a-z]{2,}$") if kind == "email" else F.lit(True) if kind == "ip" else _check(kind, m, digits)
                    return F.struct(
                        start.alias("start"), F.lit(number).alias("kind"), (start + F.length(m)).alias("end"), (ok if base else F.lit(False)).alias("base"),
                        strict.cast("int").alias("a"), _plain(kind, m).rlike(GAZETTEER[kind]).cast("int").alias("b"), F.when(near.rlike(CONTEXT[kind]), 1).otherwise(-1).alias("c"),
                        F.lit(0 if base else 1).alias("form"), F.least(F.length(m if kind in ("email", "ip") else digits), F.lit(40)).cast("int").alias("shape"), seps.alias("seps"),
                        _side(F.right(near, F.lit(1))).alias("before"), _side(F.left(pieces[i + 1], F.lit(1))).alias("after"),
                    )

                return F.transform(matches, one)

            return bind(running_sums(lengths), spans)

        return F.when(F.size(matches) > 0, bind(F.split(text, pattern, -1), located)).otherwise(F.array().cast(CANDIDATE))

    found = bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), described)
    return F.when(gate, found).otherwise(F.array().cast(CANDIDATE)).cast(CANDIDATE)


def candidates(text: Column) -> Column:
    digit = text.rlike("[0-9]")
    dots = text.contains(".") & digit
    return F.concat(
        _candidates(text, "email", PATTERNS["email"], True, text.contains("@")),
        _candidates(text, "ip", PATTERNS["ip"], True, dots),
        _candidates(text, "card", PATTERNS["card"], True, digit),
        _candidates(text, "phone", PATTERNS["phone"], True, text.contains("+") & digit),
        _candidates(text, "email", EXTRA["email"], False, text.rlike(r"[\[({]at[\])}]| at [^ ]++ dot ")),
        _candidates(text, "ip", EXTRA["ip"], False, text.rlike(r"[0-9A-Fa-f]::?[0-9A-Fa-f]")),
        _candidates(text, "card", EXTRA["card"], False, dots),
        _candidates(text, "phone", EXTRA["phone"], False, digit),
    )


def reliabilities(patterns: DataFrame) -> DataFrame:
    """patterns: (kind, a, b, c, n), n candidates with these votes (1 for, 0 against, -1 none).  Adds p, the posterior.

    Expectation-maximisation over one array of at most 27 patterns for each kind.  State: the share of true spans, and of each
    labeler the rates of votes for among true and among false spans, smoothed by one vote.
    """
    votes = ("a", "b", "c")

    def posterior(s: Column, p: Column) -> Column:
        yes, no = s["prior"], 1 - s["prior"]
        for v in votes:
            yes = yes * F.when(p[v] < 0, 1.0).when(p[v] == 1, s[f"t{v}"]).otherwise(1 - s[f"t{v}"])
            no = no * F.when(p[v] < 0, 1.0).when(p[v] == 1, s[f"f{v}"]).otherwise(1 - s[f"f{v}"])
        return yes / (yes + no)

    def step(s: Column, rows: Column) -> Column:
        weighed = F.transform(rows, lambda p: F.struct(p["n"].cast("double").alias("n"), (p["n"] * posterior(s, p)).alias("y"), *[p[v].alias(v) for v in votes]))

        def rates(w: Column) -> Column:
            total = lambda f: F.aggregate(w, F.lit(0.0), lambda t, p: t + f(p))
            out = [((total(lambda p: p["y"]) + 1.0) / (total(lambda p: p["n"]) + 2.0)).alias("prior")]
            for v in votes:
                cast = lambda p, x, v=v: F.when(p[v] >= 0, x).otherwise(0.0)
                for name, weight, start in (("t", lambda p: p["y"], 1.6), ("f", lambda p: p["n"] - p["y"], 0.4)):
                    fors = total(lambda p, v=v, weight=weight: F.when(p[v] == 1, weight(p)).otherwise(0.0))
                    out.append(((fors + start) / (total(lambda p, cast=cast, weight=weight: cast(p, weight(p))) + 2.0)).alias(f"{name}{v}"))
            return F.struct(*out)

        return bind(weighed, rates)

    start = F.struct(F.lit(0.5).alias("prior"), *[F.lit(x).alias(f"{k}{v}") for v in votes for k, x in (("t", 0.8), ("f", 0.2))])
    rows = patterns.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct(*votes, "n"))).alias("rows"))
    rows = rows.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: step(s, F.col("rows"))))
    rows = rows.select("kind", "s", F.explode("rows").alias("r"))
    return rows.select("kind", "r.*", posterior(F.col("s"), F.col("r")).alias("p"))


FEATURES = ("form", "shape", "seps", "before", "after")


def _classifier(counts: DataFrame) -> dict:
    """Log odds by (kind, feature, value), and by (kind,): at most 4 * (2 + 41 + 10 + 6 + 6) + 4 numbers, so the driver can hold them."""
    votes = counts.groupBy("kind", "a", "b", "c").agg(F.sum("n").alias("n"))
    weighed = counts.join(reliabilities(votes).select("kind", "a", "b", "c", "p"), ["kind", "a", "b", "c"])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("int").alias("value")) for f in FEATURES])).alias("x")
    rows = weighed.select("kind", "n", "p", pairs).groupBy("kind", "x").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum("n").alias("n")).select("kind", "x.*", "yes", "n").collect()
    model: dict = {}
    for kind in {r["kind"] for r in rows}:
        mine = [r for r in rows if r["kind"] == kind]
        total = {f: (sum(r["yes"] for r in mine if r["feature"] == f), sum(r["n"] for r in mine if r["feature"] == f)) for f in FEATURES}
        yes, n = total[FEATURES[0]]
        model[kind,] = math.log((yes + 1) / (n - yes + 1))
        for r in mine:
            size = len([x for x in mine if x["feature"] == r["feature"]])
            model[kind, r["feature"], r["value"]] = math.log((r["yes"] + 0.5) / (yes + 0.5 * size)) - math.log((r["n"] - r["yes"] + 0.5) / (n - yes + 0.5 * size))
    return model


def _score(model: dict, x: Column) -> Column:
    """Probability that a candidate is personal data."""
    odds = F.lit(0.0)
    for key, value in sorted(model.items(), key=str):
        here = x["kind"] == key[0]
        if len(key) == 3:
            here &= x[key[1]] == key[2]
        odds = odds + F.when(here, value).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-odds))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """Per row: (doc_id, spans); a span has start, kind (a place in KINDS), end and base."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = stage(rows.select("doc_id", candidates(F.col("text")).alias("found")), "pii-candidates")
    counts = stage(found.select(F.explode("found").alias("x")).groupBy(*[F.col(f"x.{c}").alias(c) for c in ("kind", "a", "b", "c", *FEATURES)]).agg(F.count(F.lit(1)).alias("n")), "pii-counts")
    model = _classifier(counts)
    drop_stage(counts)
    # a candidate may lie within a base span of its kind; only those apart are added
    def apart(x: Column) -> Column:
        return ~F.exists("found", lambda y: y["base"] & (y["kind"] == x["kind"]) & (y["start"] < x["end"]) & (x["start"] < y["end"]))

    table_ = sorted({k[0] for k in model})
    keep = lambda x: x["base"] | ((_score(model, x) >= threshold) & apart(x)) if table_ else x["base"]
    spans = F.transform(F.filter("found", keep), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["base"].alias("base")))
    return found.select("doc_id", F.sort_array(spans).alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    of_kind = lambda i: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == i))).cast("long")
    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), (F.size("spans") > 0).alias("has_personal_data"))


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_pii that SQL can express."""
    return op4_pii(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in KINDS])
