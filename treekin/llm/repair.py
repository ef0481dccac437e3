"""Conversation structure repair (operator 13): the cheapest edits that make a conversation's roles follow a grammar.

The grammar is ``(s?(ua)+)?`` over the first letters of roles.  Edits: Keep 0, Rerole to user or assistant 3, Delete 4, Insert an empty
turn of user or assistant 3; a truncated turn that stays costs 3 more, and blank and repeated turns must go.  Of equally cheap edits the
ones whose initials come first in ASCII win.

Method.  Conversations are dealt by a hash of their ids.  Each batch of whole conversations is one DuckDB query: a recursive CTE whose
every step takes one turn of all conversations and keeps, for each state of the grammar, the least (cost, audit).  That is exact: audits
of equal cost that have read the same turns and reached the same state are never prefixes of each other, as one more Insert costs 3, so what
follows cannot change their order.

A conversation of more than ``turns`` rows or ``LONG_BYTES`` bytes is cut into stretches that are solved on their own, from every state to
every state; a fold over the stretches' small results picks the audit of each, and the repaired text is made stretch by stretch and hashed as
a stream.  So no task holds a conversation's texts; the audit, one letter a row, is one value of the result and has to fit in memory.

Damage (the query): rows are dropped, emptied, stripped of ``[.!?]``, repeated or given the role user, by a checksum of their key.

Edge cases.  Null roles and texts are one space, a null conv_id or turn is one space in the key.  Rows without a conv_id are one
conversation.  Turns are ordered nulls first, those of equal turn by role and text.  A conversation whose rows are all dropped has zeros, an
empty audit and the hash of an empty string, as has one whose turns all go.  gaps beyond 64 bits are the largest long.  An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treekin.operators.grouped import whole_groups
from treekin.operators.ranking import global_rank
from treekin.shared import small_batches, stage, table

#: A conversation of more rows, or more bytes, is solved in stretches of so many rows.
TURNS, LONG_BYTES = 256, 16 << 20
#: Rows and bytes of one DuckDB query.
QUERY_ROWS, QUERY_BYTES = 20_000, 16 << 20
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of the grammar: 0 nothing yet, 1 after s, 2 after u, 3 after a.
STATES, ACCEPTING = range(4), (0, 3)
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _with_inserts(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, letters) reached by inserting turns; none is worth inserting that leads back."""
    out, seen = [(state, 0, "")], {state}
    for now, cost, letters in out:  # grows while it is read
        for role in "ua":
            to = _NEXT.get((now, role))
            if to is not None and to not in seen:
                seen.add(to)
                out.append((to, cost + INSERT, letters + "I"))
    return out


@functools.cache
def moves() -> list[tuple[str, int, int, int, str]]:
    """(kind, state, next state, cost, letters): one turn and the insertions after it, the best for each pair of states.

    A kind is the role's letter (x for any other) and the fault: - none, t truncated, d one that has to be deleted.
    """
    best: dict[tuple[str, int, int], tuple[int, str]] = {}
    for letter in "suax":
        for fault in "-td":
            for state in STATES:
                extra, own = TRUNCATED * (fault == "t"), [(state, DELETE, "D")]
                if fault != "d":
                    if (state, letter) in _NEXT:
                        own.append((_NEXT[state, letter], KEEP + extra, "K"))
                    own += [(_NEXT[state, role], REROLE + extra, "R") for role in "ua" if (state, role) in _NEXT]
                for to, cost, edit in own:
                    for end, more, letters in _with_inserts(to):
                        key, found = (letter + fault, state, end), (cost + more, edit + letters)
                        best[key] = min(best.get(key, found), found)
    return [(*key, *value) for key, value in sorted(best.items())]


# --- the queries on a batch

_WALK = """
CREATE OR REPLACE TEMP TABLE walked AS
WITH RECURSIVE walk(seg, began, state, i, cost, audit) USING KEY (seg, began, state) AS (
  SELECT seg, began, state, 0, cost, audit FROM sizes, starts
  UNION
  SELECT seg, began, state, i, best.cost, best.audit FROM (
    SELECT w.seg, w.began, m.next AS state, w.i + 1 AS i, min(struct_pack(cost := w.cost + m.cost, audit := w.audit || m.letters)) AS best
    FROM walk w JOIN turns t ON t.seg = w.seg AND t.i = w.i JOIN moves m ON m.kind = t.kind AND m.state = w.state
    GROUP BY w.seg, w.began, m.next, w.i
  )
)
SELECT walk.* FROM walk JOIN sizes USING (seg) WHERE walk.i = sizes.n
"""

_TURNS = """
CREATE OR REPLACE TEMP TABLE turns AS
SELECT seg, row_number() OVER (PARTITION BY seg ORDER BY spot) - 1 AS i, turn, role, text, fault, left(role, 1) AS letter,
       CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END || CASE fault WHEN 'truncated' THEN 't' WHEN '' THEN '-' ELSE 'd' END AS kind
FROM given WHERE NOT gone
"""

_SIZES = """
CREATE OR REPLACE TEMP TABLE sizes AS
SELECT seg, count(turns.i) AS n FROM (SELECT DISTINCT seg FROM given) LEFT JOIN turns USING (seg) GROUP BY seg
"""

#: Each letter of an audit with its turn, and the role that its turn gets.
_REPAIRED = """
CREATE OR REPLACE TEMP TABLE repaired AS
WITH letters AS (
  SELECT seg, began, p, audit[p] AS edit FROM (SELECT seg, began, audit, unnest(range(1, length(audit) + 1)) AS p FROM chosen)
), placed AS (
  SELECT seg, began, p, edit, count(*) FILTER (edit <> 'I') OVER (PARTITION BY seg ORDER BY p) - 1 AS i, count(*) FILTER (edit <> 'D') OVER (PARTITION BY seg ORDER BY p) AS place FROM letters
), items AS (
  SELECT l.seg, l.began, l.p, l.edit, l.place, t.role, t.text,
         max(CASE WHEN l.edit = 'K' AND l.place = 1 AND l.began = 0 AND t.letter = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.seg) AS head
  FROM placed l LEFT JOIN turns t ON t.seg = l.seg AND t.i = l.i AND l.edit <> 'I' WHERE l.edit <> 'D'
)
SELECT seg, string_agg(CASE WHEN edit = 'K' THEN role ELSE CASE WHEN (place - 1 - head + CASE WHEN began = 2 THEN 1 ELSE 0 END) % 2 = 0 THEN 'user' ELSE 'assistant' END END
                       || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS text
FROM items GROUP BY seg
"""

_FAULTS = """
SELECT sizes.seg, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
       count(*) FILTER (i > 0 AND before || letter NOT IN ('su', 'ua', 'au')) AS illegal, arg_min(letter, i) AS first, arg_max(letter, i) AS last,
       least(coalesce(max(turn)::HUGEINT - min(turn) + 1 - count(DISTINCT turn), 0), 9223372036854775807)::BIGINT AS gaps
FROM sizes LEFT JOIN (SELECT *, lag(letter) OVER (PARTITION BY seg ORDER BY i) AS before FROM turns) t USING (seg) GROUP BY sizes.seg
"""

_BEST = f"CREATE OR REPLACE TEMP TABLE chosen AS SELECT seg, 0 AS began, best.cost AS cost, best.audit AS audit FROM (SELECT seg, min(struct_pack(cost := cost, audit := audit)) AS best FROM walked WHERE state IN {ACCEPTING} GROUP BY seg)"
#: What a batch gives the queries.
GIVEN = pa.schema([("seg", pa.int64()), ("spot", pa.int64()), ("turn", pa.int64()), ("role", pa.large_string()), ("text", pa.large_string()), ("fault", pa.string()), ("gone", pa.bool_())])


@functools.cache
def _duck():
    """This worker's database: in memory, with one thread, and nothing on disk."""
    import duckdb

    db = duckdb.connect(config={"threads": 1, "memory_limit": "768MB", "temp_directory": ""})
    db.execute("SET preserve_insertion_order = false")
    db.execute("CREATE TABLE moves(kind VARCHAR, state INT, next INT, cost BIGINT, letters VARCHAR)")
    db.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?)", moves())
    # a whole conversation begins in state 0, where turns may be inserted at once; a stretch begins in any state
    db.execute("CREATE TABLE whole_starts(began INT, state INT, cost BIGINT, audit VARCHAR)")
    db.executemany("INSERT INTO whole_starts VALUES (0, ?, ?, ?)", _with_inserts(0))
    db.execute("CREATE TABLE stretch_starts AS SELECT s::INT AS began, s::INT AS state, 0::BIGINT AS cost, '' AS audit FROM range(4) t(s)")
    return db


def _load(rows: pa.Table, begin: list[int], columns: dict[str, str], starts: str | None):
    """A database with the tables turns and sizes of whole groups of rows, and with the walk over them."""
    import numpy as np

    sizes = np.diff(begin)
    data = {"seg": pa.array(np.repeat(np.arange(len(sizes)), sizes)), "spot": pa.array(np.arange(rows.num_rows))}
    data |= {name: rows.column(columns[name]) if name in columns else pa.array([False] * rows.num_rows) for name in GIVEN.names[2:]}
    db = _duck()
    db.register("given", pa.table({f.name: data[f.name].cast(f.type) for f in GIVEN}))
    db.execute(_TURNS)
    db.execute(_SIZES)
    if starts:
        db.execute(_WALK.replace("FROM sizes, starts", f"FROM sizes, {starts}"))
    return db


def _batches(batches, keys: int, text: str) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups with about QUERY_ROWS rows or QUERY_BYTES bytes of text."""
    held: list[pa.Table] = []
    begin, rows, size = [0], 0, 0
    for part, at in whole_groups(batches, keys):
        held.append(part)
        begin += [rows + x for x in at[1:]]
        rows, size = rows + part.num_rows, size + part.column(text).nbytes
        if rows >= QUERY_ROWS or size >= QUERY_BYTES:
            yield pa.concat_tables(held), begin
            held, begin, rows, size = [], [0], 0, 0
    if held:
        yield pa.concat_tables(held), begin


def _result(db, query: str, schema: pa.Schema, keys: list[tuple[str, pa.ChunkedArray]], begin: list[int]) -> list[pa.RecordBatch]:
    """A query's rows as batches; its column seg becomes the group's keys."""
    out = db.sql(query).to_arrow_table()
    at = pa.array(begin[:-1]).take(out.column("seg").combine_chunks().cast(pa.int64()))
    named = [column.take(at) for _, column in keys]
    rest = [out.column(f.name).cast(f.type) for f in schema]
    return pa.table([*named, *rest], [*(n for n, _ in keys), *schema.names]).combine_chunks().to_batches()


_SOLVED = pa.schema([(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())])


def _solve(batches):
    """Of rows (conv_id, turn, role, text, fault, gone), sorted: one row for each conversation."""
    for rows, begin in _batches(batches, 1, "text"):
        db = _load(rows, begin, {c: c for c in ("turn", "role", "text", "fault", "gone")}, "whole_starts")
        db.execute(_BEST)
        db.execute(_REPAIRED)
        query = f"SELECT f.*, c.cost, c.audit, sha256(coalesce(r.text, '')) AS repaired_sha256 FROM ({_FAULTS}) f JOIN chosen c USING (seg) LEFT JOIN repaired r USING (seg)"
        yield from _result(db, query, _SOLVED, [("conv_id", rows.column(0))], begin)


# --- conversations in stretches

_STRETCH = pa.schema([(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "began", "state", "cost")] + [("first", pa.string()), ("last", pa.string()), ("audit", pa.string())])


def _solve_stretches(batches):
    """Of rows (conv_id, stretch, turn, role, text, fault), sorted: the stretch's counts, and its best audit from each state to each."""
    for rows, begin in _batches(batches, 2, "text"):
        db = _load(rows, begin, {c: c for c in ("turn", "role", "text", "fault")}, "stretch_starts")
        query = f"SELECT f.*, w.began, w.state, w.cost, w.audit FROM ({_FAULTS}) f JOIN walked w USING (seg)"
        yield from _result(db, query, _STRETCH, [("conv_id", rows.column(0)), ("stretch", rows.column(1))], begin)


def _text_after(node, other) -> tuple[str, str]:
    """The audits of two paths of one length, from where they part."""
    a, b = [], []
    while node is not other:
        a.append(node[1])
        b.append(other[1])
        node, other = node[0], other[0]
    return "".join(reversed(a)), "".join(reversed(b))


class _Fold:
    """The stretches of one conversation, in order: the best path to each state, as a linked list of (before, audit, state it began in, stretch)."""

    def __init__(self):
        self.best = {s: (cost, (None, letters, 0, None)) for s, cost, letters in _with_inserts(0)}
        self.counts, self.last = [0, 0, 0, 0], None

    def add(self, stretch: int, counts: list[int], first: str, last: str, paths: list[tuple[int, int, int, str]]):
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        self.counts[3] += self.last is not None and self.last + first not in ("su", "ua", "au")
        self.last = last
        new: dict[int, tuple] = {}
        for began, state, cost, audit in paths:
            if began in self.best:
                cost, node = self.best[began][0] + cost, (self.best[began][1], audit, began, stretch)
                if state not in new or cost < new[state][0] or (cost == new[state][0] and (t := _text_after(node, new[state][1]))[0] < t[1]):
                    new[state] = (cost, node)
        self.best = new

    def chosen(self) -> tuple[int, list[tuple[int | None, int, str]]]:
        """The cost, and (stretch, the state it begins in, its audit) in order; the first, without a stretch, has the insertions before."""
        found = [self.best[s] for s in ACCEPTING if s in self.best]
        cost, node = found[0]
        for c, other in found[1:]:
            if c < cost or (c == cost and (t := _text_after(other, node))[0] < t[1]):
                cost, node = c, other
        out = []
        while node is not None:
            out.append((node[3], node[2], node[1]))
            node = node[0]
        return cost, out[::-1]


def _fold(batches):
    """Of the stretches' rows, sorted by conv_id and stretch: (conv_id, stretch, began, audit) of each, and a row without a stretch with the totals."""
    fold, now, kind = None, None, None

    def done():
        cost, path = fold.chosen()
        total = [*fold.counts, cost]
        out = [(now, None, None, "".join(a for _, _, a in path), *total)]
        out += [(now, stretch, began, audit, None, None, None, None, None) for stretch, began, audit in path if stretch is not None]
        head = path[0][2]
        if head:  # turns inserted before the first one belong to the first stretch
            out[1] = (now, out[1][1], -len(head), head + out[1][3], *out[1][4:])
        names = ["conv_id", "stretch", "began", "audit", "blank", "duplicate", "truncated", "illegal", "cost"]
        kinds = [kind, pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 5]
        columns = zip(*out, strict=True)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    for rows, begin in whole_groups(batches, 2):
        kind = rows.schema.field("conv_id").type
        for a, b in zip(begin, begin[1:], strict=False):
            part = rows.slice(a, b - a).to_pylist()
            conv = part[0]["conv_id"]
            if fold is None or not (conv == now or (conv != conv and now != now)):
                if fold is not None:
                    yield done()
                fold, now = _Fold(), conv
            r = part[0]
            fold.add(r["stretch"], [r[c] for c in ("blank", "duplicate", "truncated", "illegal")], r["first"], r["last"], [(p["began"], p["state"], p["cost"], p["audit"]) for p in part])
    if fold is not None:
        yield done()


def _render(batches):
    """Of rows (conv_id, stretch, place, role, text), sorted; the row without a place has the stretch's audit as text, and where it begins as role.
    (conv_id, stretch, text): the repaired turns."""
    for rows, begin in _batches(batches, 2, "text"):
        heads = rows.take(pa.array(begin[:-1]))
        keep = sorted(set(range(rows.num_rows)) - set(begin[:-1]))
        body = rows.take(pa.array(keep, pa.int64()))
        marks = [b - k for k, b in enumerate(begin)]
        body = body.append_column("fault", pa.array([""] * body.num_rows))
        db = _load(body, marks, {c: c for c in ("role", "text", "fault")} | {"turn": "place"}, None)
        # a stretch that begins with inserted turns begins as the conversation does, in state 0
        chosen = pa.table({"seg": pa.array(range(heads.num_rows), pa.int64()), "began": pa.array([max(0, int(x)) for x in heads.column("role").to_pylist()], pa.int64()), "audit": heads.column("text")})
        db.register("chosen_given", chosen)
        db.execute("CREATE OR REPLACE TEMP TABLE chosen AS SELECT seg, began, 0 AS cost, audit FROM chosen_given")
        db.execute(_REPAIRED)
        yield from _result(db, "SELECT seg, text FROM repaired", pa.schema([("text", pa.large_string())]), [("conv_id", rows.column(0)), ("stretch", rows.column(1))], begin)


def _hash(batches):
    """Of (conv_id, stretch, text), sorted: the hash of each conversation's repaired turns, as a stream."""
    h, now, some, kind = None, None, False, None

    def done():
        return pa.record_batch([pa.array([now], kind), pa.array([h.hexdigest()])], ["conv_id", "repaired_sha256"])

    for batch in batches:
        kind = batch.column(0).type
        for conv, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            if h is None or not (conv == now or (conv != conv and now != now)):
                if h is not None:
                    yield done()
                h, now, some = hashlib.sha256(), conv, False
            if some:
                h.update(b"\n")
            h.update(text.as_buffer())
            some = True
    if h is not None:
        yield done()


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _in_stretches(rows: DataFrame, ids: DataFrame, turns: int) -> DataFrame:
    """The result for long conversations.  rows: (conv_id, turn, role, text, blank, truncated), those that are left; ids: (conv_id) of all."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    ranked = global_rank(rows, *[F.col(c) for c in ("conv_id", "turn", "role", "text")], name="place")
    ranked = stage(ranked.withColumn("place", F.col("place").cast("long")).withColumn("stretch", F.expr(f"place div {int(turns)}")), "long-conversations")
    # the first of equal turns, found without bringing them together
    firsts = ranked.where("NOT blank").groupBy("conv_id", "role", "text").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("new"))
    known = ranked.join(firsts, "place", "left").withColumn("fault", _fault(F.col("new").isNull()))
    known = stage(known.drop("new"), "long-conversations")
    solved = known.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "place").select("conv_id", "stretch", "turn", "role", "text", "fault")
    schema = f"conv_id {kind}, stretch long, " + ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _STRETCH)
    solved = stage(solved.mapInArrow(_solve_stretches, schema), "stretches")
    paths = solved.repartition("conv_id").sortWithinPartitions("conv_id", "stretch")
    folded = stage(paths.mapInArrow(_fold, f"conv_id {kind}, stretch long, began long, audit string, blank long, duplicate long, truncated long, illegal long, cost long"), "folded")
    audits = folded.where("stretch IS NOT NULL").select("conv_id", "stretch", F.lit(None).cast("long").alias("place"), F.col("began").cast("string").alias("role"), F.col("audit").alias("text"))
    both = known.select("conv_id", "stretch", "place", "role", "text").union(audits).repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "place")
    made = stage(both.mapInArrow(_render, f"conv_id {kind}, stretch long, text string"), "repaired")
    hashes = made.repartition("conv_id").sortWithinPartitions("conv_id", "stretch").mapInArrow(_hash, f"conv_id {kind}, repaired_sha256 string")
    hashes = hashes.withColumnRenamed("conv_id", "h")
    span = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.countDistinct("turn")
    gaps = known.groupBy(F.col("conv_id").alias("g")).agg(F.least(F.coalesce(span, F.lit(0)), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("gaps"))
    totals = folded.where("stretch IS NULL").drop("stretch", "began").withColumnRenamed("conv_id", "t")
    out = ids.join(totals, _same("conv_id", "t"), "left").join(gaps, _same("conv_id", "g"), "left").join(hashes, _same("conv_id", "h"), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def _fault(again: Column) -> Column:
    return F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("truncated"), "truncated").otherwise("")


def repair_conversations(rows: DataFrame, turns: int = TURNS) -> DataFrame:
    """rows: (conv_id, turn, role, text), and gone where a row counts for its conv_id alone.  Per conversation: conv_id, the numbers of gaps and of
    blank, duplicate, truncated and illegal turns, the cost of the cheapest edits, their audit, and the SHA-256 of the repaired turns."""
    if turns < 1:
        raise ValueError("a stretch has one turn at least")
    spark = rows.sparkSession
    small_batches(spark)
    kind = rows.schema["conv_id"].dataType.simpleString()
    space, gone = F.lit(" "), F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"), gone.alias("gone"))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = rows.withColumn("blank", bare == "").withColumn("truncated", ~F.right(bare, F.lit(1)).isin(".", "!", "?"))
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = stage(sizes.where((F.col("n") > turns) | (F.col("bytes") > LONG_BYTES)).select("conv_id"), "long-ids")
    some = not long.isEmpty()
    other = long.withColumnRenamed("conv_id", "long_id")
    short = rows.join(other, _same("conv_id", "long_id"), "left_anti") if some else rows
    # the window needs no further shuffle, as rows of one conversation are in one partition
    dealt = short.repartition("conv_id")
    numbered = dealt.withColumn("nth", F.row_number().over(_window()))
    named = numbered.withColumn("fault", _fault((F.col("nth") > 1) & ~F.col("gone"))).sortWithinPartitions("conv_id", "turn", "role", "text", "nth")
    out = named.select("conv_id", "turn", "role", "text", "fault", "gone").mapInArrow(_solve, f"conv_id {kind}, {RESULT}")
    if some:
        left = rows.where(~F.col("gone")).join(other, _same("conv_id", "long_id"), "left_semi").drop("gone")
        out = out.union(_in_stretches(left, long, turns))
    return out


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id", "role", "text", "gone").orderBy("turn")


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by the checksum of their key; dropped ones stay with gone set."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.encode(F.concat(word("conv_id"), F.lit(":"), word("turn")), "UTF-8")) % 20
    rows = rows.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), how.alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("how") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(table(spark, sf_dir, "conversations")))
