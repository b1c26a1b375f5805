"""Chat formatting by minimum-cost role repair.

The legal turns form an automaton: an optional system turn, then user and assistant
in turn, ending with the assistant.  Dynamic programming over its states picks, for
each given turn, the cheapest of keeping its role, relabelling it, merging it into the
turn before it, or inserting an empty turn in front of it; at the end an empty turn
may be inserted too.  Costs are fixed numbers below; ties take the earliest choice in
the order system, user, assistant (of equally cheap repairs of a conversation that
crosses ranges, the states at the ranges' ends are chosen first).

A conversation may be of any length: rows are dealt by ranges of (conversation, turn),
so a long one spans several tasks.  Every task folds the turns of a conversation that
crosses its ends into one state-to-state cost matrix (min-plus products), at most two
for each range.  ``FAN`` ranges at a time are folded the same way, and so on, until one
group is left; from there down every group is told the states in which its crossing
conversations enter and leave, and tells its members theirs, until each range traces
back its own turns.  No task and not the driver ever holds more than ``FAN`` ranges'
matrices.

The result has one row for each repaired turn part, in order: the concatenation of
``rendered`` over a conversation in the order of (turn, piece) is the formatted
conversation.  Defined results: unknown or null roles cost little to relabel; a null
text is empty; rows of the same conversation and turn stay in the order of role and
text, repeated rows repeat; a null conversation id is one conversation of its own and
null turns come first; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import columns_of, written

ROLES = ("system", "user", "assistant")
#: Fixed synonyms of roles.
SYNONYMS = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system", "instruction": "system"}
START, SYSTEM, USER, ASSISTANT = range(4)
MERGE, RELABEL, GUESS, INSERT = 1.0, 2.0, 0.5, 1.5
ROWS_PER_RANGE = 4096
FAN = 2048
_BIG = 1e18
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def _path(state: int, target: int) -> list[int] | None:
    """Roles to insert between a state and a next turn of role ``target``; None if none lead there."""
    if target in _NEXT[state]:
        return []
    for middle in _NEXT[state]:
        if target in _NEXT[middle]:
            return [middle]
    for middle in _NEXT[state]:
        for second in _NEXT[middle]:
            if target in _NEXT[second]:
                return [middle, second]
    return None


#: For a state and the role that a turn is given: (cost, merged, inserted roles).
MOVES: dict[tuple[int, int], list[tuple[float, bool, list[int]]]] = {}
for _s in range(4):
    for _t in (SYSTEM, USER, ASSISTANT):
        MOVES[_s, _t] = [(MERGE, True, [])] if _s == _t else []
        if (_inserted := _path(_s, _t)) is not None:
            MOVES[_s, _t].append((INSERT * len(_inserted), False, _inserted))
STEP = np.full((4, 4), _BIG)
CHOICE: dict[tuple[int, int], tuple[float, bool, list[int]]] = {}
for (_s, _t), _m in MOVES.items():
    if _m:
        CHOICE[_s, _t] = min(_m, key=lambda x: (x[0], not x[1]))
        STEP[_s, _t] = CHOICE[_s, _t][0]
#: Cost of ending in a state, and what is inserted then.
END = {START: (0.0, []), SYSTEM: (2 * INSERT, [USER, ASSISTANT]), USER: (INSERT, [ASSISTANT]), ASSISTANT: (0.0, [])}


def canonical(role: str | None) -> int | None:
    """The state of a given role, or None for one that says nothing."""
    name = (role or "").strip().lower()
    name = SYNONYMS.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else None


def _costs(role: int | None) -> np.ndarray:
    """Cost from each state (row) to each role given to the turn (column)."""
    change = np.array([_BIG] + [GUESS if role is None else 0.0 if role == t else RELABEL for t in (1, 2, 3)])
    return STEP + change


_BY_ROLE = {r: _costs(r) for r in (None, SYSTEM, USER, ASSISTANT)}


def transfer(roles: list[int | None]) -> np.ndarray:
    """Min-plus product of the turns' cost matrices: the cheapest way from state to state."""
    total = np.full((4, 4), _BIG)
    np.fill_diagonal(total, 0.0)
    for role in roles:
        total = (total[:, :, None] + _BY_ROLE[role][None]).min(axis=1)
    return total


def trace(roles: list[int | None], enter: int, leave: int | None) -> list[int]:
    """The cheapest role for each turn from state ``enter``; to ``leave``, or to the end if that is None."""
    cost = np.full(4, _BIG)
    cost[enter] = 0.0
    back = np.zeros((len(roles), 4), np.int8)
    for i, role in enumerate(roles):
        step = cost[:, None] + _BY_ROLE[role]
        back[i] = step.argmin(axis=0)
        cost = step.min(axis=0)
    state = leave if leave is not None else int(np.argmin(cost + np.array([END[s][0] for s in range(4)])))
    out = []
    for i in range(len(roles) - 1, -1, -1):
        out.append(state)
        state = int(back[i, state])
    return out[::-1]


def open_turn(role: int) -> str:
    return f"<|im_start|>{ROLES[role - 1]}\n"


CLOSE = "<|im_end|>\n"
SCHEMA = "conv_id bigint, turn bigint, piece int, given string, role string, action string, rendered string"


def _pieces(given: list[str | None], texts: list[str | None], roles: list[int], enter: int, last: bool) -> Iterator[tuple[int, int, str | None, str, str, str]]:
    """(index, piece, given role, role, action, rendered) of the turns; the closing mark leads the next piece."""
    state = enter
    for i, (name, text, role) in enumerate(zip(given, texts, roles, strict=True)):
        _, merged, inserted = CHOICE[state, role]
        piece = 0
        for extra in inserted:
            yield i, piece, None, ROLES[extra - 1], "insert", (CLOSE if state else "") + open_turn(extra)
            state, piece = extra, piece + 1
        kept = canonical(name) == role
        action = ("keep" if kept else "relabel") if not merged else ("merge" if kept else "relabel+merge")
        yield i, piece, name, ROLES[role - 1], action, ("\n" if merged else (CLOSE if state else "") + open_turn(role)) + (text or "")
        state = role
        if i == len(roles) - 1 and last:
            for extra in END[state][1]:
                piece += 1
                yield i, piece, None, ROLES[extra - 1], "insert", CLOSE + open_turn(extra)
            yield i, piece + 1, None, ROLES[(END[state][1] or [state])[-1] - 1], "close", CLOSE


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", ranges: int | None = None, fan: int = FAN) -> DataFrame:
    """conv_id, turn, piece, given, role, action and rendered of every repaired turn part."""
    rows = columns_of(turns, {conv_col: "bigint", turn_col: "bigint", role_col: "string", text_col: "string"}).toDF("conv_id", "turn", "role", "text")
    ranges = ranges or max(1, -(-rows.select("conv_id").count() // ROWS_PER_RANGE))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(ranges, *order, "tie").sortWithinPartitions(*order, "tie")
    dealt = written(dealt.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), "conv_id", "turn", "role", "text"), "chat-ranges")

    def segments(block: pa.Table):
        block = block.sort_by("place")
        conv = block.column("conv_id").to_pylist()
        cuts = [0, *[i for i in range(1, len(conv)) if conv[i] != conv[i - 1]], len(conv)]
        return block, conv, list(zip(cuts, cuts[1:], strict=False)) if conv else []

    def crossing(block: pa.Table) -> pa.Table:
        block, conv, parts = segments(block)
        names = block.column("role").to_pylist()
        number = block.column("part")[0].as_py()
        return _rims([(number, conv[a], a == 0, b == len(conv), transfer([canonical(r) for r in names[a:b]])) for a, b in sorted({parts[0], parts[-1]})] if parts else [])

    rims = dealt.select("part", "place", "conv_id", "role").groupBy("part").applyInArrow(crossing, RIMS)
    states = crossings(rims, ranges, fan)

    def render(block: pa.Table, told: pa.Table) -> pa.Table:
        known = {r["conv_id"]: (r["enter"], r["leave"], r["ends"]) for r in told.to_pylist()}
        out: list[tuple] = []
        if block.num_rows:
            block, conv, parts = segments(block)
            names, texts, numbers = (block.column(c).to_pylist() for c in ("role", "text", "turn"))
            for a, b in parts:
                enter, leave, last = known.get(conv[a], (START, None, True))
                roles = trace([canonical(r) for r in names[a:b]], enter, leave)
                out += [(conv[a], numbers[a + i], piece, given, role, action, text) for i, piece, given, role, action, text in _pieces(names[a:b], texts[a:b], roles, enter, last)]
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 4]
        columns = list(zip(*out, strict=True)) or [()] * 7
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "turn", "piece", "given", "role", "action", "rendered"])

    return dealt.groupBy("part").cogroup(states.groupBy("part")).applyInArrow(render, SCHEMA)


RIMS = "part int, conv_id bigint, first boolean, last boolean, cost array<double>"
STATES = "part int, conv_id bigint, enter int, leave int, ends boolean"


def _rims(rows: list[tuple]) -> pa.Table:
    """(part, conversation, whether it holds the part's first turn, its last turn, cost matrix) as a table."""
    columns = list(zip(*rows, strict=True)) or [()] * 5
    costs = pa.array([c.ravel().tolist() for c in columns[4]], pa.list_(pa.float64()))
    return pa.table({"part": pa.array(columns[0], pa.int32()), "conv_id": pa.array(columns[1], pa.int64()), "first": pa.array(columns[2], pa.bool_()), "last": pa.array(columns[3], pa.bool_()), "cost": costs})


def crossings(rims: DataFrame, parts: int, fan: int) -> DataFrame:
    """(part, conv_id, enter, leave, ends): the states of the conversations that cross the ends of parts."""
    if parts <= fan:
        group = rims.withColumn("group", F.lit(0))
        return group.groupBy("group").applyInArrow(lambda block: _assigned(block.to_pylist(), {}), STATES)
    rims = written(rims, "chat-rims").withColumn("group", F.floor(F.col("part") / fan).cast("int"))
    above = crossings(rims.groupBy("group").applyInArrow(_folded, RIMS), -(-parts // fan), fan)
    above = above.withColumnRenamed("part", "group")

    def down(block: pa.Table, told: pa.Table) -> pa.Table:
        return _assigned(block.to_pylist(), {r["conv_id"]: (r["enter"], r["leave"], r["ends"]) for r in told.to_pylist()})

    return rims.groupBy("group").cogroup(above.groupBy("group")).applyInArrow(down, STATES)


def _runs(rims: list[dict]) -> list[list[dict]]:
    """The rims in order, those of one conversation that goes on from part to part together."""
    runs: list[list] = []
    for r in sorted(rims, key=lambda r: (r["part"], not r["first"])):
        linked = runs and runs[-1][-1]["conv_id"] == r["conv_id"] and runs[-1][-1]["part"] != r["part"] and runs[-1][-1]["last"] and r["first"]
        runs[-1].append(r) if linked else runs.append([r])
    return runs


def _folded(block: pa.Table) -> pa.Table:
    """The rims of a group of parts: its first and its last conversation, each with the product of its matrices."""
    runs, out = _runs(block.to_pylist()), []
    for i in sorted({0, len(runs) - 1}):
        total = np.array(runs[i][0]["cost"]).reshape(4, 4)
        for r in runs[i][1:]:
            total = (total[:, :, None] + np.array(r["cost"]).reshape(4, 4)[None]).min(axis=1)
        out.append((block.column("group")[0].as_py(), runs[i][0]["conv_id"], i == 0, i == len(runs) - 1, total))
    return _rims(out)


def _assigned(rims: list[dict], given: dict[int | None, tuple[int, int | None, bool]]) -> pa.Table:
    """(enter, leave, whether the conversation ends there) of the parts' crossing conversations; ``given``: those of the whole group's."""
    rows = []
    for run in _runs(rims):
        if len(run) == 1 and run[0]["conv_id"] not in given:
            continue
        enter, leave, ends = given.get(run[0]["conv_id"], (START, None, True))
        cost = np.full(4, _BIG)
        cost[enter] = 0.0
        backs = []
        for r in run:
            step = cost[:, None] + np.array(r["cost"]).reshape(4, 4)
            backs.append(step.argmin(axis=0))
            cost = step.min(axis=0)
        state = leave if leave is not None else int(np.argmin(cost + np.array([END[s][0] for s in range(4)])))
        for i in range(len(run) - 1, -1, -1):
            before = int(backs[i][state])
            rows.append((run[i]["part"], run[i]["conv_id"], before, state, ends and i == len(run) - 1))
            state = before
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "conv_id", "enter", "leave", "ends"])
