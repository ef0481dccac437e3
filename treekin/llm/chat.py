"""Operator 7: chat formatting with minimum-cost role repair.

Method.  A conversation is legal if it is an optional system turn, then user and assistant turns in alternation, from a user turn to
an assistant turn.  For each turn in order, a dynamic program over that automaton's states chooses the role it gets
(relabelling has a cost), whether it is merged into the turn before, which must have that role, or opens a turn of its own,
and which empty turns are put in before it; at the end, which empty turns close the conversation.  The cheapest sequence of
choices is rendered; of equally cheap ones, the first in the fixed order of choices.

A step depends on the turn's role only, so it is a small matrix in the (min, +) algebra, and a stretch of turns is the product of its
matrices.  The turns are range-partitioned by (conversation, turn), so one huge conversation lies over many partitions.  In one pass,
each partition chooses and renders on its own for all conversations that begin and end in it; its first and its last one may go on elsewhere,
so of these it gives the turns as they are, and the products of their matrices.  The driver scans the products, two matrices at most for
each partition, and tells each partition the states in which it begins and ends; then the turns left over are rendered.  Texts are
shuffled once, but for those of first and last conversations.

Rendering: ``<|im_start|>role``, a line feed and the text; ``<|im_end|>`` and a line feed at a turn's end.  A row's piece
ends what is open, holds inserted turns, and begins or continues its own turn; the pieces of a conversation, joined in order,
are its rendering.

Edge cases.  Null text is empty.  Roles are compared in lower case; ``human`` and ``prompter`` mean user, ``bot``, ``model`` and ``gpt``
assistant, ``developer`` system; null or other roles can become any role at the cost ``unknown``.  Turns of equal number are
ordered by role, then text, and null numbers come first; repeated rows stay, and are merged like other neighbours of one role.
Null conversation ids are one conversation; ids are of any type that can be sorted, and keep it.  An empty table gives an empty result.  Other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treekin.shared import small_batches, stage, table

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "model": "assistant", "gpt": "assistant", "developer": "system"}
INF = float("inf")
#: States: nothing yet, then after a system, user, assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


@dataclass(frozen=True)
class Costs:
    relabel: float = 2.0
    unknown: float = 0.5
    merge: float = 1.0
    insert: float = 3.0


def role_number(role: str | None) -> int:
    """1, 2, 3 for the known roles, 0 for others."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else 0


def _inserts(a: int, b: int) -> list[int] | None:
    """The fewest empty turns between state a and a turn of role b."""
    todo, seen = [(a, [])], {a}
    while todo:
        s, path = todo.pop(0)
        if b in LEGAL[s]:
            return path
        for x in LEGAL[s]:
            if x not in seen:
                seen.add(x)
                todo.append((x, [*path, x]))
    return None


INSERTS = {(a, b): _inserts(a, b) for a in range(4) for b in (1, 2, 3)}


def choices(state: int, role: int, costs: Costs) -> list[tuple[float, int, str, list[int]]]:
    """(cost, next state, action, inserted roles) of every choice for a turn of the role in the state."""
    out = []
    for to in (1, 2, 3):
        label = 0.0 if to == role else costs.unknown if role == 0 else costs.relabel
        ins = INSERTS[state, to]
        if ins is not None:
            out.append((label + costs.insert * len(ins), to, "keep" if to == role else "relabel", ins))
        if to == state:
            out.append((label + costs.merge, to, "merge", []))
    return out


def ending(state: int, costs: Costs) -> tuple[float, list[int]]:
    """The empty turns that close a conversation in the state."""
    if state == ASSISTANT:
        return 0.0, []
    path = [*(INSERTS[state, ASSISTANT] or []), ASSISTANT]
    return costs.insert * len(path), path


def matrix(role: int, costs: Costs) -> np.ndarray:
    m = np.full((4, 4), INF)
    for s in range(4):
        for cost, to, _, _ in choices(s, role, costs):
            m[s, to] = min(m[s, to], cost)
    return m


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).min(1)


def to_go(roles: list[int], after: np.ndarray, mats: list[np.ndarray]) -> np.ndarray:
    """Row i: the least cost from before turn i on, by state; the last row is `after`."""
    out = np.empty((len(roles) + 1, 4))
    out[-1] = after
    for i in range(len(roles) - 1, -1, -1):
        out[i] = (mats[roles[i]] + out[i + 1]).min(1)
    return out


def decide(roles: list[int], state: int, rest: np.ndarray, costs: Costs) -> list[tuple[int, int, str, list[int], float]]:
    """(state before, state after, action, inserts, cost) of each turn; the first of the cheapest choices."""
    out = []
    for i, role in enumerate(roles):
        cost, to, action, ins = min(choices(state, role, costs), key=lambda c: c[0] + rest[i + 1, c[1]])
        out.append((state, to, action, ins, cost))
        state = to
    return out


def _end_costs(costs: Costs) -> np.ndarray:
    return np.array([ending(s, costs)[0] for s in range(4)])


def boundaries(edges: list[tuple[int, int, int | None, np.ndarray]], costs: Costs) -> dict[int, tuple[int, bool, np.ndarray, bool]]:
    """edges: (part, place, conv, matrix) in order.  Per part: the state in which it begins, whether its first conversation began
    before, the cost after its last conversation's last turn by state, and whether that goes on in a later part."""
    end = _end_costs(costs)
    chains: list[list[int]] = []
    for i, (part, _, conv, _) in enumerate(edges):
        if i and edges[i - 1][2] == conv and edges[i - 1][0] != part:
            chains[-1].append(i)
        else:
            chains.append([i])
    out = {e[0]: [START, False, end, False] for e in edges}
    for chain in chains:
        rest = [end]
        for i in reversed(chain):
            rest.append((edges[i][3] + rest[-1]).min(1))
        rest.reverse()
        state = START
        for k, i in enumerate(chain):
            part = edges[i][0]
            if k:
                out[part][0], out[part][1] = state, True
            state = int(np.argmin(edges[i][3][state] + rest[k + 1]))
            if k + 1 < len(chain):  # of equally cheap ways, one that ends where the next part begins
                out[part][2], out[part][3] = np.where(np.arange(4) == state, 0.0, INF), True
    return {k: tuple(v) for k, v in out.items()}


def _open(role: int) -> str:
    return f"<|im_start|>{ROLES[role - 1]}\n"


CLOSE = "<|im_end|>\n"


def render(turns: list[tuple[int, str]], state: int, rest_after: np.ndarray, last: bool, began: bool, costs: Costs):
    """turns: (role, text).  Rows (role, action, inserted, cost, piece) of one conversation's stretch."""
    roles = [r for r, _ in turns]
    mats = [matrix(r, costs) for r in range(4)]
    chosen = decide(roles, state, to_go(roles, rest_after, mats), costs)
    for i, ((_, text), (before, to, action, ins, cost)) in enumerate(zip(turns, chosen, strict=True)):
        if action == "merge":
            piece = "\n" + text
        else:
            piece = CLOSE if before != START and (i or began) else ""
            piece += "".join(_open(x) + CLOSE for x in ins) + _open(to) + text
        n = len(ins)
        if last and i == len(turns) - 1:
            more, path = ending(to, costs)
            piece += CLOSE + "".join(_open(x) + CLOSE for x in path)
            n, cost = n + len(path), cost + more
        yield ROLES[to - 1], action, n, cost, piece


OUT = ["conv_id", "place", "turn", "role", "action", "n_inserted", "cost", "piece"]


def _schema(conv: str) -> str:
    return f"conv_id {conv}, place long, turn long, role string, action string, n_inserted int, cost double, piece string"


def _rows(conv, kind: pa.DataType, at: int, turns: list, columns: list) -> pa.RecordBatch:
    """Rows of one conversation with places from `at` on; columns: role, action, n_inserted, cost, piece."""
    kinds = (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.string())
    n = len(turns)
    return pa.record_batch([pa.array([conv] * n, kind), pa.array(np.arange(at, at + n)), pa.array(turns, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], OUT)


def _rendered(conv, kind: pa.DataType, at: int, turns: list[tuple], *how) -> pa.RecordBatch:
    """turns: (turn, role number, text) of one conversation's stretch; how: see render."""
    rows = list(render([(r, t) for _, r, t in turns], *how))
    return _rows(conv, kind, at, [t for t, _, _ in turns], [[r[k] for r in rows] for k in range(5)])


def _first_pass(costs: Costs):
    """Of a sorted partition (conv_id, turn, role, text): rendered rows, with the columns part, edge and matrix null.  Of its first and its last
    conversation (edge 0 and 1) the turns as they are, with the role's number in n_inserted and the text in piece; and one row without a place
    for each, with the product of their matrices."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        mats, end = [matrix(r, costs) for r in range(4)], _end_costs(costs)
        at, now, turns, number, total, kind = part << 40, None, [], 0, None, None

        def out(rows: pa.RecordBatch, edge: int | None = None, values: list | None = None) -> pa.RecordBatch:
            n = rows.num_rows
            more = [pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.int32()), pa.array([values] * n, pa.list_(pa.float64()))]
            return pa.record_batch([*rows.columns, *more], [*OUT, "part", "edge", "matrix"])

        def left(edge: int) -> pa.RecordBatch:
            n = len(turns)
            return out(_rows(now, kind, at, [t for t, _, _ in turns], [[None] * n, [None] * n, [r for _, r, _ in turns], [None] * n, [x for _, _, x in turns]]), edge)

        def product_of(edge: int) -> pa.RecordBatch:
            row = _rows(now, kind, 0, [None], [[None]] * 5)
            return out(row.set_column(1, "place", pa.nulls(1, pa.int64())), edge, total.ravel().tolist())

        for batch in batches:
            kind = batch.column(0).type
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if number == 0 or conv != now:
                    if number == 1:
                        yield left(0)
                        yield product_of(0)
                    elif number > 1:
                        yield out(_rendered(now, kind, at, turns, START, end, True, False, costs))
                    at, now, turns, number, total = at + len(turns), conv, [], number + 1, None
                r = role_number(role)
                turns.append((turn, r, text or ""))
                total = mats[r] if total is None else product(total, mats[r])
            if number == 1:  # the first conversation's turns go on as they come
                yield left(0)
                at, turns = at + len(turns), []
        if number:
            yield left(min(1, number - 1))
            yield product_of(min(1, number - 1))

    return run


def _second_pass(where, costs: Costs):
    """Of the turns left over, (conv_id, place, turn, role number, text, edge) sorted by place: rendered rows."""

    def run(batches):
        known, end = where.value, _end_costs(costs)
        key, now, at, turns, kind = None, None, 0, [], None

        def done() -> pa.RecordBatch:
            part, edge = key
            state, began, rest, goes_on, lone = known[part]
            if edge:
                state, began = START, False
            elif not lone:
                rest, goes_on = end, False
            return _rendered(now, kind, at, turns, state, rest, not goes_on, began, costs)

        for batch in batches:
            kind = batch.column(0).type
            for conv, place, turn, role, text, edge in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if key != (place >> 40, edge):
                    if turns:
                        yield done()
                    key, now, at, turns = (place >> 40, edge), conv, place, []
                turns.append((turn, role, text))
        if turns:
            yield done()

    return run


def format_chats(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Per row of turns: (conv_id, place, turn, role, action, n_inserted, cost, piece); place orders the pieces of a conversation."""
    spark = turns.sparkSession
    small_batches(spark)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    schema = _schema(rows.schema["conv_id"].dataType.simpleString())
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_first_pass(costs), f"{schema}, part int, edge int, matrix array<double>")
    dealt = stage(dealt, "chat-turns")
    found = dealt.where("place IS NULL").select("part", "edge", "conv_id", "matrix").collect()
    edges = sorted(((r[0], r[1], r[2], np.array(r[3]).reshape(4, 4)) for r in found), key=lambda r: r[:2])
    several = {p for p, edge, _, _ in edges if edge}
    where = spark.sparkContext.broadcast({p: (*known, p not in several) for p, known in boundaries(edges, costs).items()})
    rest = dealt.where("edge IS NOT NULL AND place IS NOT NULL").repartitionByRange("part").sortWithinPartitions("place")
    rest = rest.select("conv_id", "place", "turn", "n_inserted", "piece", "edge").mapInArrow(_second_pass(where, costs), schema)
    return dealt.where("edge IS NULL").select(*OUT).union(rest)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
