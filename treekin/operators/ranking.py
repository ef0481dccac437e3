"""Places of rows in a total order, without sorting all of them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treekin.shared import drop_stage, stage

#: monotonically_increasing_id has the partition above so many bits, the row within it below.
_ROW_BITS = 33


def global_rank(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """rows with a column `name`: 1, 2, 3 ... in the order, which should be total.

    The rows are range-partitioned and sorted, and each partition's count tells how many stand before the next one; these counts,
    one small row a partition, are all that is added up in one place.
    """
    at = stage(rows.orderBy(*order).select(F.struct(*rows.columns).alias("row"), F.monotonically_increasing_id().alias("at")), "ranked")
    part = F.shiftright("at", _ROW_BITS)
    sizes = sorted((r[0], r[1]) for r in at.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect())
    if not sizes:
        drop_stage(at)
        return rows.withColumn(name, F.lit(0).cast("long"))
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    starts = rows.sparkSession.createDataFrame(before, "p long, before long")
    place = (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1).cast("long")
    return at.join(F.broadcast(starts), part == F.col("p")).select("row.*", place.alias(name))
