"""Operator 13 against brute force, in batches and in stretches."""

import functools
import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from treekin.llm import repair, sql
from treekin.shared import table

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, repaired lines) by search from the end: rows are (role, text, fault)."""

    @functools.cache
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        if inserted < 3:
            for role in "ua":
                if (state, role) in NEXT:
                    cost, audit, lines = best(i, NEXT[state, role], inserted + 1)
                    found.append((cost + 3, "I" + audit, (ROLES[role] + ":", *lines)))
        if i < len(rows):
            role, text, fault = rows[i]
            more = [(4, "D", state, None)]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if (state, role[:1]) in NEXT:
                    more.append((extra, "K", NEXT[state, role[:1]], role))
                more += [(3 + extra, "R", NEXT[state, r], ROLES[r]) for r in "ua" if (state, r) in NEXT]
            for cost, edit, to, name in more:
                rest = best(i + 1, to, 0)
                found.append((cost + rest[0], edit + rest[1], rest[2] if name is None else (f"{name}:{text}", *rest[2])))
        return min(found, key=lambda x: x[:2], default=(10**9, "~", ()))

    for i in range(len(rows), 0, -50):  # from the end, as Python's stack is short
        for state in range(4):
            best(i, state, 0)
    return best(0, 0, 0)


def expected(rows):
    """rows: (conv_id, turn, role, text), damaged here; the contract's rows."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        how = zlib.crc32(key.encode()) % 20
        if how:
            text = "" if how == 1 else re.sub(r"[.!?]", "", text) if how == 2 else text
            mine += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    result = {}
    for conv, mine in out.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, lines = cheapest(tuple((r, x, f) for (_, r, x), f in zip(mine, faults, strict=True)))
        numbers = [t for t, _, _ in mine if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        result[conv] = (min(gaps, (1 << 63) - 1), *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return result


KIND = "conv_id long, turn long, role string, text string, seg long, i string, cost double, gone2 string, copy long"


def table_of(rng, n=60):
    roles = ["user", "assistant", "system", "user", "assistant", "", "tool", None, "ünder", "s"]
    texts = ["Yes.", "No", "What? ", "", " \t", "ok!\n", "a\x00b.", "naïve 😀.", None, "x" * 5000 + ".", "Done.\n\n", "line\nline."]
    rows = []
    for conv in [*range(n), None, -5]:
        length = rng.choice([0, 1, 2, 3, 5, 8, 13])
        for t in range(length):
            turn = rng.choice([t, t, t, t, None, t - 1, -(1 << 63), (1 << 63) - 1]) if conv is not None and conv % 5 == 0 else t
            rows.append((conv, turn, rng.choice(roles[:3] if rng.random() < 0.7 else roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randrange(20)}."))
    rows += rows[:15]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0.5, "y", 2) for r in rows], KIND).repartition(5)


def got(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


@pytest.mark.parametrize("turns", [256, 3, 1])
def test_brute_force(spark, turns):
    """Whole conversations, and conversations of which some or all are cut into stretches."""
    for seed in (1, 2):
        rows = table_of(random.Random(seed))
        found = repair.repair_conversations(repair.damage(frame(spark, rows)), turns)
        assert found.count() == len({r[0] for r in rows}) and got(found) == expected(rows)


def test_long_conversation(spark):
    """One conversation with most of the rows."""
    rng = random.Random(7)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"t{t}.", "", "cut"])) for t in range(2500)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Hello.")]
    assert got(repair.repair_conversations(repair.damage(frame(spark, rows)))) == expected(rows)


def test_empty_and_other_keys(spark):
    assert got(repair.repair_conversations(repair.damage(frame(spark, [])))) == {}
    nan = float("nan")
    rows = spark.createDataFrame([(nan, 0, "user", "a."), (nan, 1, "assistant", "b."), (1.0, 0, "user", "a.")], "conv_id double, turn long, role string, text string")
    for turns in (256, 1):
        found = sorted((str(r["conv_id"]), r["audit"], r["cost"]) for r in repair.repair_conversations(rows, turns).collect())
        assert found == [("1.0", "KI", 3), ("nan", "KK", 0)]
    # all rows of a conversation dropped
    gone = rows.union(rows.where("conv_id = 1.0")).withColumn("gone", F.col("conv_id") == 1.0)
    for turns in (256, 1):
        assert [r["audit"] for r in repair.repair_conversations(gone, turns).orderBy("conv_id").collect()] == ["", "KK"]


def test_sql(spark):
    conversations = f"{SMALL}/conversations.parquet"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{conversations}'")
    want = {r[0]: tuple(r[1:]) for r in db.execute(sql.REPAIR).fetchall()}
    assert got(repair.op13_conversation_repair(spark, SMALL)) == want
    rows = [tuple(r) for r in table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert expected(rows) == want
