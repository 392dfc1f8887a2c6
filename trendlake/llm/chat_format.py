"""Chat formatting with minimum-cost role repair.

A conversation should be an optional system turn, then user and assistant in turn, user first.
Each turn of the input is either started as a turn of some role (a relabel costs), after as many
empty turns as make that legal (each costs), or merged into the turn before (costs). The cheapest
sequence of choices comes from dynamic programming over the states of the automaton, the role of
the last turn written.

A conversation may be of any length, so it is not gathered: rows are dealt out by ranges of
(conversation, turn), the stretch of a conversation inside a partition is summed up by a 4 x 4
matrix of least costs between states and the order of equal ones, the few matrices of
conversations that cross partitions are joined on the driver (two a partition at most), and each
stretch is then repaired on its own between known states.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import checkpoint, input_bytes, partitions_for, positional

ROLES = ("system", "user", "assistant")
#: States: nothing written yet, then the role of the last turn.
START, STATES = 0, 4
RELABEL, INSERT, MERGE_SAME, MERGE_OTHER = 4, 5, 1, 7
_FAR = 1 << 60
#: Rows of a batch that goes out.
_OUT_ROWS = 4096
#: Which roles (numbered from 1 as states) may follow a state.
_LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
SCHEMA = "conv_id long, turn long, role string, new_role string, action string, n_inserted int, cost int, piece string"


def _fillers(state: int, role: int) -> tuple[int, ...] | None:
    """The least empty turns after `state` that make `role` legal; None if there are none."""
    for n in range(3):
        for path in itertools.product(range(1, STATES), repeat=n):
            steps = (state, *path, role)
            if all(b in _LEGAL[a] for a, b in zip(steps, steps[1:])):
                return path
    return None


FILLERS = {(s, r): _fillers(s, r) for s in range(STATES) for r in range(1, STATES)}


def role_number(role: str | None) -> int:
    """1 to 3 for a known role (case and outer white space aside), 0 for any other and for null."""
    name = (role or "").strip().lower()
    return ROLES.index(name) + 1 if name in ROLES else 0


def _step(role: int) -> list[list[tuple[int, str]]]:
    """[state][next state]: the cheapest way to take a turn of this role, (cost, action); the first action by name of equal ones."""
    ways = [[(_FAR, "")] * STATES for _ in range(STATES)]
    for state, new in itertools.product(range(STATES), range(1, STATES)):
        filler = FILLERS[state, new]
        found = []
        if filler is not None:
            found.append((INSERT * len(filler) + (RELABEL if new != role else 0), "keep" if new == role else "relabel"))
        if state == new:
            found.append((MERGE_SAME if state == role else MERGE_OTHER, "merge"))
        ways[state][new] = min(found, default=(_FAR, ""))
    return ways


STEPS = [_step(role) for role in range(STATES)]


def costs_after(costs: list[int], role: int) -> list[int]:
    """Least cost of each state after one more turn."""
    step = STEPS[role]
    return [min(min(c + step[s][to][0] for s, c in enumerate(costs)), _FAR) for to in range(STATES)]


class Stretch:
    """What a stretch of turns does to any state before it.

    Of all sequences of states that cost least, the one counts whose last state is least, then
    whose last but one is least, and so on back. `costs[i][j]` is the least cost from state i
    before to state j after; `place[j][i]` orders the states before by what counts among the best
    ways from them to j. Both together are enough to join stretches in any grouping, with the
    same sequence in the end.
    """

    def __init__(self, costs: list[list[int]], place: list[list[int]]):
        self.costs, self.place = costs, place

    @classmethod
    def turn(cls, role: int) -> Stretch:
        return cls([[way[0] for way in ways] for ways in STEPS[role]], [list(range(STATES)) for _ in range(STATES)])

    def between(self, later: Stretch, i: int, j: int) -> int:
        """The state between the two stretches on the way from i to j."""
        return min(range(STATES), key=lambda k: (min(self.costs[i][k] + later.costs[k][j], _FAR), later.place[j][k]))

    def then(self, later: Stretch) -> Stretch:
        through = [[self.between(later, i, j) for j in range(STATES)] for i in range(STATES)]
        costs = [[min(self.costs[i][through[i][j]] + later.costs[through[i][j]][j], _FAR) for j in range(STATES)] for i in range(STATES)]
        place = []
        for j in range(STATES):
            order = sorted(range(STATES), key=lambda i: (later.place[j][through[i][j]], self.place[through[i][j]][i]))
            place.append([order.index(i) for i in range(STATES)])
        return Stretch(costs, place)

    def best_end(self, i: int) -> int:
        return min(range(STATES), key=lambda j: (self.costs[i][j], j))

    def written(self) -> list[int]:
        return [x for rows in (*self.costs, *self.place) for x in rows]

    @classmethod
    def read(cls, values: list[int]) -> Stretch:
        rows = [list(values[i : i + STATES]) for i in range(0, len(values), STATES)]
        return cls(rows[:STATES], rows[STATES:])


@functools.lru_cache(100_000)
def _longer(stretch: tuple[int, ...], role: int) -> tuple[tuple[int, ...], int]:
    """A stretch and one more turn, with the least cost taken off; there are few different ones."""
    out = Stretch.read(list(stretch)).then(Stretch.turn(role)).written()
    least = min(out[: STATES * STATES])
    return tuple(x - least if i < STATES * STATES and x < _FAR else x for i, x in enumerate(out)), least


def whole_stretch(roles: Iterable[int]) -> Stretch:
    """All of one turn or more."""
    rest = iter(roles)
    out, total = tuple(Stretch.turn(next(rest)).written()), 0
    for role in rest:
        out, more = _longer(out, role)
        total += more
    return Stretch.read([x + total if i < STATES * STATES and x < _FAR else x for i, x in enumerate(out)])


def best_path(roles: list[int], entry: int, exit_: int | None) -> list[tuple[int, str, int, int]]:
    """For each turn (state before, action, state after, cost) on the cheapest way; None: any end.

    Of ways of equal cost the one whose last state is least, then whose last but one is, and so on.
    """
    costs = [_FAR] * STATES
    costs[entry] = 0
    layers = [costs]
    for role in roles:
        layers.append(costs_after(layers[-1], role))
    state = exit_ if exit_ is not None else min(range(STATES), key=lambda s: (layers[-1][s], s))
    path = []
    for i in range(len(roles) - 1, -1, -1):
        step = STEPS[roles[i]]
        before = next(s for s in range(STATES) if layers[i][s] + step[s][state][0] == layers[i + 1][state])
        cost, action = step[before][state]
        path.append((before, action, state, cost))
        state = before
    return path[::-1]


def render(before: int, action: str, after: int, text: str | None, last: bool) -> str:
    """What a turn adds to the conversation's text; pieces of all turns make up the whole."""
    body = text or ""
    if action == "merge":
        out = "\n" + body
    else:
        out = "<|end|>\n" if before != START else ""
        out += "".join(f"<|{ROLES[r - 1]}|>\n<|end|>\n" for r in FILLERS[before, after])
        out += f"<|{ROLES[after - 1]}|>\n{body}"
    return out + ("<|end|>\n" if last else "")


def _stretches(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[list]]:
    """The first columns of each run of rows with one conversation, the id first."""
    held: list[list] = [[] for _ in range(columns)]
    for batch in batches:
        found = [batch.column(i).to_pylist() for i in range(columns)]
        start = 0
        for conv, run in itertools.groupby(found[0]):
            end = start + sum(1 for _ in run)
            if held[0] and held[0][-1] != conv:
                yield held
                held = [[] for _ in range(columns)]
            for kept, new in zip(held, found):
                kept.extend(new[start:end])
            start = end
    if held[0]:
        yield held


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", n_parts: int | None = None) -> DataFrame:
    """Repairs the roles of every conversation at the least cost and renders it.

    One row for each input row: conv_id, turn, role, new_role, action (keep, relabel, merge),
    n_inserted (empty turns before it), cost, piece. The pieces of a conversation in the order of
    (turn, role, text), nulls first, are its rendered text. Of repairs of equal cost
    the one counts that Stretch names, whatever the partitions. Unknown and null roles always cost
    a relabel or a merge; null texts are empty; rows with a null conv_id form one conversation;
    repeated rows are turns of their own. An empty table gives no rows.

    A task holds one conversation's stretch within its partition, and partitions are cut to a size.
    """
    spark, (table, names) = turns.sparkSession, positional(turns)
    column = lambda name: F.col(f"_c{names.index(name)}")
    rows = table.select(column(conv_col).cast("long").alias("conv_id"), column(turn_col).cast("long").alias("turn"), column(role_col).alias("role"), column(text_col).alias("text"))
    n_parts = n_parts or partitions_for(spark, input_bytes(rows, F.col("text")), 64 << 20)
    # The bounds of ranges are a sample that Spark brings to the driver: of texts, 64 characters.
    dealt = rows.repartitionByRange(n_parts, "conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    dealt = checkpoint(dealt.select("conv_id", "role", "turn", "text"))

    def sum_up(batches):
        """The first and the last stretch of the partition; others lie in it as a whole."""
        number, ends = TaskContext.get().partitionId(), []
        for ids, roles in _stretches(batches, 2):
            ends = [*ends[:1], (ids[0], roles)]
        kept = [(number, conv, whole_stretch(map(role_number, roles)).written()) for conv, roles in ends]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["part", "conv_id", "stretch"])

    # Two rows a partition at most.
    edges = sorted(dealt.select("conv_id", "role").mapInArrow(sum_up, "part int, conv_id long, stretch array<long>").collect(), key=lambda r: (r["part"], r["conv_id"] is not None, r["conv_id"] or 0))
    between: dict[tuple[int, int | None], tuple[int, int, bool]] = {}
    for conv, group in itertools.groupby(edges, key=lambda r: r["conv_id"]):
        parts = list(group)
        found = [Stretch.read(x["stretch"]) for x in parts]
        until = list(itertools.accumulate(found, Stretch.then))
        state = until[-1].best_end(START)
        for i in range(len(found) - 1, -1, -1):
            before = until[i - 1].between(found[i], START, state) if i else START
            between[parts[i]["part"], conv] = (before, state, i == len(found) - 1)
            state = before

    def repair(batches):
        number = TaskContext.get().partitionId()
        names_ = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for ids, roles, order, texts in _stretches(batches, 4):
            entry, exit_, ends = between.get((number, ids[0]), (START, None, True))
            path = best_path(list(map(role_number, roles)), entry, exit_)
            for start in range(0, len(path), _OUT_ROWS):
                some = path[start : start + _OUT_ROWS]
                out = [
                    (ids[i], order[i], roles[i], ROLES[after - 1], action, 0 if action == "merge" else len(FILLERS[before, after]), cost, render(before, action, after, texts[i], ends and i == len(path) - 1))
                    for i, (before, action, after, cost) in enumerate(some, start)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names_)

    return dealt.mapInArrow(repair, SCHEMA)
