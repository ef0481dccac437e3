"""Anti-joins of wide rows with many keys: rows that surely have no partner stay where they are."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treekin.shared import stage

#: Up to so many keys are broadcast as they are (8 bytes each).
MOST_KEYS = 1 << 19
#: Bits of a map for each member, and the most bits of one (16 MB); with more members than a quarter of them a map lets too much through.
BITS_A_MEMBER, MOST_BITS = 8, 1 << 27
#: Words of 64 bits in a row of the map.
WORDS = 128


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("long")), F.lit(bits))


def _bit(key: Column, bits: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(_place(key, bits), F.lit(64)).cast("int"))


def bitmap(members: DataFrame, key: str, bits: int) -> DataFrame:
    """(chunk, words): the bits of all members' keys, WORDS * 64 of them in a row; chunks without a bit are left out."""
    word = F.shiftright(_place(_quoted(key), bits), 6)
    set_ = members.select(word.alias("word"), _bit(_quoted(key), bits).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    chunk = set_.groupBy(F.floor(F.col("word") / WORDS).alias("chunk")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("word") % WORDS).cast("int"), "bit"))).alias("at"))
    return chunk.select("chunk", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.element_at("at", i), F.lit(0).cast("long"))).alias("words"))


def maybe_member(rows: DataFrame, key: str, members: DataFrame, bits: int) -> tuple[DataFrame, Column]:
    """rows with columns of new names, and a condition on them: false where the key is surely none of members' keys, true for all that are,
    and few others as long as the members are few against the bits.  The broadcast side has `bits` bits."""
    chunk, words = (f"{x}-{uuid.uuid4().hex}" for x in ("chunk", "words"))
    held = stage(bitmap(members, key, bits), "bitmap").select(F.col("chunk").alias(chunk), F.col("words").alias(words))
    word = F.shiftright(_place(_quoted(key), bits), 6)
    joined = rows.join(F.broadcast(held), F.floor(word / WORDS) == _quoted(chunk), "left")
    return joined, F.coalesce(_quoted(words)[(word % WORDS).cast("int")].bitwiseAND(_bit(_quoted(key), bits)) != 0, F.lit(False))


def anti_join(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """The rows whose key, a whole number, is none of members' keys; null keys stay.

    Few members are broadcast.  More of them make a bitmap, and only rows that it lets through are shuffled; beyond MOST_BITS / 4 members
    all rows are.  Columns keep their names and order, whatever the names are.
    """
    own = f"key-{uuid.uuid4().hex}"
    gone = stage(members.select(_quoted(key).cast("long").alias(own)).where(_quoted(own).isNotNull()).distinct(), "members")
    count, columns = gone.count(), [_quoted(c) for c in rows.columns]
    if not count:
        return rows

    def left(df: DataFrame, side: DataFrame) -> DataFrame:
        return df.join(side, _quoted(key).cast("long") == _quoted(own), "left_anti").select(*columns)

    if count <= MOST_KEYS:
        return left(rows, F.broadcast(gone))
    if 4 * count > MOST_BITS:
        return left(rows, gone)
    bits = min(MOST_BITS, 1 << (BITS_A_MEMBER * count - 1).bit_length())
    flagged, maybe = maybe_member(rows, key, gone.select(_quoted(own).alias(key)), bits)
    return flagged.where(~maybe).select(*columns).union(left(flagged.where(maybe).select(*columns), gone))


def known_members(asked: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key): the asked keys that are among the stored ones, each once.  The stored table is scanned for its key and never shuffled while
    the asked keys fit a broadcast or a bitmap; of a bitmap only rows that it lets through go on."""
    own = stage(asked.select(_quoted(key).cast("long").alias(key)).where(_quoted(key).isNotNull()).distinct(), "asked-keys")
    count = own.count()
    rows = stored.select(_quoted(key).cast("long").alias(key))
    if count <= MOST_KEYS:
        return rows.join(F.broadcast(own), key, "left_semi").distinct()
    if 4 * count > MOST_BITS:
        return own.join(rows, key, "left_semi")
    bits = min(MOST_BITS, 1 << (BITS_A_MEMBER * count - 1).bit_length())
    flagged, maybe = maybe_member(rows, key, own, bits)
    return own.join(flagged.where(maybe).select(key), key, "left_semi")
