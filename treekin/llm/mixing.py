"""Operator 2: mixing sources to target weights, with DataFrame functions only.

Method.  Targets: the sources share the total of all sizes by weight, none above ``max_epochs`` times its own size; what is
above is shared out again by weight.  That fixed point is found in closed form: with sources in ascending order of
limit / weight, a source is at its limit if that ratio is at most (total - limits before) / (weights from here on).

Selection (Efraimidis and Spirakis): a document gets the exponential key -ln(u) / w, u from a hash of its id, w its
quality weight.  Of a source, target div size complete epochs take every document as often; the rest of the target is
filled in ascending order of the keys, by prefix sums of the sizes.

No source is sorted in one task.  Keys are dealt into ``BINS`` bins of equal probability; sums by source and bin, which
are small, give the prefix sum at which each bin begins.  Bins below the budget are taken whole, bins above not at all,
and only the one bin of each source in which the budget ends is sorted.

Edge cases.  Null or empty text has size 0 and takes 0 words.  Null sources are one source, after all others.  A null or
non-positive quality weight counts as 1.  A null doc_id has a key of its own, like any value.  Rows with equal keys are
taken by doc_id, then by size; equal rows are interchangeable, so reruns agree as sets of rows.  ``mix_documents`` orders
rows of equal id and size by a hash of their text, and counts off rows that are equal in that as well, so that budgets
hold.  Sizes of 0 in all rows, or an empty table, give targets of 0.  Other columns pass through under their names; a
name that the operator itself uses is kept apart in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treekin.llm.quality import bind, line_stats
from treekin.shared import drop_stage, stage, table

BINS = 4096
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_size(text: Column) -> Column:
    """Words of a text, without making an array of them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_: Column, seed: int = 0) -> Column:
    """A number in (0, 1) from 52 bits of a hash of the id."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def order_key(id_: Column, quality: Column, seed: int = 0) -> Column:
    """The exponential key: a document of weight w comes before others with a probability in proportion to w."""
    return -F.log(uniform(id_, seed)) / F.when(quality > 0, quality).otherwise(F.lit(1.0))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """sizes: (source, source_size), a row for each source.  Adds weight and target.

    The windows run over one row for each source, never over documents.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("weight", F.array(*[F.lit(w) for w in weights])[at].cast("long")).withColumn("limit", F.col("source_size") * max_epochs)
    order = [(F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(onward)
    rows = rows.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("limit"))
    # beyond the first source that is not at its limit the levels only fall
    share = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return rows.select("source", "source_size", "weight", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(share * F.col("weight")).alias("target"))


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: int = 0, whole: bool = False) -> DataFrame:
    """rows: (doc_id, source, size, quality, ...); a column tie orders rows of equal id and size.  Adds source_size, target and taken: how many words of the row the mix takes.

    whole: a document is taken as a whole or not at all in an incomplete epoch, whichever is nearer to the budget;
    otherwise the last one gives the words that are left.  The columns copies and epochs hold the whole copies of the row and the
    complete epochs of its source.
    """
    extra = [c for c in rows.columns if c not in ("doc_id", "source", "size", "quality")]
    key = order_key(F.col("doc_id"), F.col("quality"), seed)
    # 1 - exp(-key) is uniform for weight 1, and monotone in the key for all
    place = F.least(F.floor((F.lit(1.0) - F.exp(-key)) * BINS), F.lit(BINS - 1)).cast("int")
    keyed = rows.select("doc_id", "source", "size", F.struct(F.lit(0).alias("_"), *[_quoted(c) for c in extra]).alias("rest"), key.alias("k"), place.alias("bin"))
    bins = stage(keyed.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "mix-bins")
    targets = source_targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("left", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    # the bin of each source in which the budget ends, and the words before it
    to = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.withColumn("before", F.coalesce(F.sum("bin_size").over(to), F.lit(0)))
    b, t = starts.alias("b"), targets.alias("t")
    ends = (
        t.join(b, F.col("b.source").eqNullSafe(F.col("t.source")) & (F.col("before") <= F.col("left")) & (F.col("before") + F.col("bin_size") > F.col("left")), "left")
        .groupBy(F.col("t.source").alias("source"), "source_size", "target", "epochs", "left")
        .agg(F.min("bin").alias("end_bin"), F.min_by("before", "bin").alias("end_before"))
    )
    ends = stage(ends, "mix-targets")
    k, e = keyed.alias("k"), ends.alias("e")
    joined = k.join(e, F.col("k.source").eqNullSafe(F.col("e.source"))).select("k.*", "source_size", "target", "epochs", "left", "end_bin", "end_before")
    open_ = F.col("end_bin").isNotNull() & (F.col("bin") == F.col("end_bin"))
    whole_bin = F.when(F.col("end_bin").isNull() | (F.col("bin") > F.col("end_bin")), 0).otherwise(F.col("size"))
    whole_bin = F.when(F.col("left") == 0, 0).otherwise(whole_bin).cast("long")
    sure = joined.where(~open_).select("*", whole_bin.alias("part"))
    last = Window.partitionBy("source").orderBy("k", "doc_id", "size", *([F.col("rest")["tie"]] if "tie" in extra else [])).rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("left") - F.col("end_before") - F.coalesce(F.sum("size").over(last), F.lit(0))
    part = F.when(2 * room >= F.col("size"), F.when(room > 0, F.col("size")).otherwise(0)).otherwise(0) if whole else F.greatest(F.least(room, F.col("size")), F.lit(0))
    fine = joined.where(open_).select("*", part.cast("long").alias("part"))
    out = sure.union(fine)
    copies = F.col("epochs") + F.when((F.col("part") == F.col("size")) & (F.col("size") > 0) & (F.col("left") > 0), 1).otherwise(0)
    return out.select(
        "doc_id", "source", "size", *[F.col("rest")[c].alias(c) for c in extra], "source_size", "target",
        (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), copies.cast("int").alias("copies"), "epochs",
    )


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): documents labelled good weigh 2, those labelled bad 1/2; of several labels the best holds."""
    good = F.when(F.max("quality") > 0, 2.0).otherwise(0.5)
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(good.alias("quality"))


def with_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with the column quality added; unlabelled documents weigh 1."""
    return docs.join(quality_weights(labels), "doc_id", "left").withColumn("quality", F.coalesce("quality", F.lit(1.0)))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", text_size(F.col("text")).alias("size"))
    rows = stage(with_quality(docs, table(spark, sf_dir, "labels")), "mix-sizes")
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken", "source")


def text_quality(text: Column) -> Column:
    """A weight from the text itself: the share of its lines that come for the first time, 1/20 at least."""
    share = bind(line_stats(F.coalesce(text, F.lit(""))), lambda s: 1 - s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)))
    return F.greatest(share, F.lit(0.05))


def _ranked_in_source(rows: DataFrame) -> DataFrame:
    """rows with rank, 1, 2, 3 ... within each source, in the order in which they lie: nothing is shuffled but a count of each partition."""
    rows = stage(rows.sortWithinPartitions("source").withColumn("at", F.monotonically_increasing_id()), "mix-ties")
    counts = rows.groupBy("source", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = stage(counts.select(F.col("source").alias("s"), "part", "first", before.alias("before")), "mix-ties")
    found = rows.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("at", 33) == F.col("part")))
    return found.withColumn("rank", F.col("before") + F.col("at") - F.col("first") + 1).drop("at", "s", "part", "first", "before")


def mix_documents(docs: DataFrame, quality: Column | None = None, seed: int = 0) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with the columns it had.

    The mix is made of the documents' sizes alone.  What it takes of an incomplete epoch is all up to one place of each source's order, so
    the texts are read once more and compared with it, and never shuffled.  Rows at that place have one id, size and text; where only some
    of them are taken they are counted off, and so many are.
    """
    names = docs.columns
    text = F.col("text").cast("string")
    weight = text_quality(text) if quality is None else quality
    rows = docs.select("doc_id", "source", text_size(F.col("text")).alias("size"), weight.alias("quality"), F.xxhash64(text).alias("tie"), F.struct(*[_quoted(c) for c in names]).alias("document"))
    rows = rows.withColumn("place", F.struct(order_key(F.col("doc_id"), F.col("quality"), seed).alias("k"), "doc_id", "size", "tie"))
    sizes = stage(rows.select("doc_id", "source", "size", "quality", "place", "tie"), "mix-sizes")
    mixed = stage(mix(sizes, seed=seed, whole=True).select("source", "place", "copies", "epochs"), "mix-places")
    drop_stage(sizes)
    once_more = F.col("copies") > F.col("epochs")
    cuts = mixed.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(F.when(once_more, F.col("place"))).alias("cut"))
    m, c = mixed.alias("m"), cuts.alias("c")
    there = m.join(c, F.col("m.source").eqNullSafe(F.col("c.source")) & (F.col("m.place") == F.col("c.cut")))
    there = there.groupBy(F.col("c.source").alias("s")).agg(F.count(F.lit(1)).alias("every"), F.count(F.when(F.col("m.copies") > F.col("m.epochs"), 1)).alias("some"))
    cuts = stage(cuts.join(there, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mix-cuts")
    drop_stage(mixed)
    r, c = rows.select("source", "size", "place", "document").alias("r"), cuts.alias("c")
    joined = r.join(c, F.col("r.source").eqNullSafe(F.col("c.source"))).select("r.source", "document", "size", "place", "epochs", "cut", "every", "some")
    tied = F.coalesce((F.col("place") == F.col("cut")) & (F.col("some") < F.col("every")), F.lit(False))
    up_to = F.when(F.col("cut").isNotNull() & (F.col("size") > 0) & (F.col("place") <= F.col("cut")), 1).otherwise(0)
    out = joined.where(~tied).select("document", (F.col("epochs") + up_to).alias("taken"))
    if not cuts.where("some < every").isEmpty():
        counted = _ranked_in_source(joined.where(tied))
        out = out.union(counted.select("document", (F.col("epochs") + F.when(F.col("rank") <= F.col("some"), 1).otherwise(0)).alias("taken")))
    copies = F.explode(F.sequence(F.lit(1), F.col("taken").cast("int")))
    return out.where("taken > 0").select("document", copies.alias("copy")).select("document.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), q AS (
  SELECT doc_id, CASE WHEN max(quality) > 0 THEN 2.0 ELSE 0.5 END AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 3 * source_size AS lim FROM s
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w
), f AS (
  SELECT *, level * weight >= lim AS full_ FROM l
), t AS (
  SELECT source, source_size, CASE WHEN full_ THEN CAST(lim AS DOUBLE) ELSE max(CASE WHEN NOT full_ THEN level END) OVER () * weight END AS target FROM f
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), k AS (
  SELECT d.doc_id, d.source, d.size,
         -ln((CAST(('0x' || substr(md5('0:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)
           / coalesce(q.quality, 1.0) AS key
  FROM d LEFT JOIN q USING (doc_id)
), p AS (
  SELECT k.*, e.source_size, e.target, e.epochs, CAST(floor(e.target) AS BIGINT) - e.epochs * e.source_size AS budget,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(least(budget - before, size), 0) AS BIGINT) AS taken, source FROM p
"""
