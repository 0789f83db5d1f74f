"""Minimum-cost role repair of conversations, then rendering.

A legal conversation is an optional system message, then user and assistant messages
in turn, ending with the assistant.  Every turn keeps its role or is relabelled; two
neighbours of one role are merged into one message; where a message is missing, an
empty one is inserted.  Dynamic programming over the automaton of the last role finds
the cheapest repair.

The turns are sorted once, in range partitions that may cut a conversation.  A task
repairs all conversations that lie inside its partition, one turn of all of them at a
time.  The first and the last conversation of a partition may go on in another one:
their turns stay open, and each such part gives a (min, +) matrix from the automaton's
state before the part to the state after it.  The matrices (two a partition at most) of
a conversation are multiplied, which gives every part its first and last state, and
only the open turns are moved again to be repaired between these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import with_long_ids, written

#: States of the automaton: what the conversation's last message is.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ["", "system", "user", "assistant"]
STATES = 4
MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0
#: Messages that must be inserted between a state and a role, None where no repair is legal.
GAPS: dict[tuple[int, int], list[int] | None] = {
    (START, SYSTEM): [], (START, USER): [], (START, ASSISTANT): [USER],
    (SYSTEM, USER): [], (SYSTEM, ASSISTANT): [USER],
    (USER, ASSISTANT): [], (USER, SYSTEM): None,
    (ASSISTANT, USER): [], (ASSISTANT, SYSTEM): None,
}
CLOSING = {START: [USER, ASSISTANT], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}


def move(before: int, role: int, after: int) -> float:
    """The cost of making a turn of `role` the message `after`, when `before` was the last."""
    cost = RELABEL if role != after else 0.0
    if before == after:
        return cost + MERGE
    gap = GAPS[before, after]
    return float("inf") if gap is None else cost + INSERT * len(gap)


MOVES = np.full((STATES, STATES, STATES), np.inf)  # [role, before, after]; role 0 is an unknown one
for _r in range(STATES):
    for _b in range(STATES):
        for _a in (SYSTEM, USER, ASSISTANT):
            MOVES[_r, _b, _a] = move(_b, _r, _a)
CLOSE = np.array([INSERT * len(CLOSING[s]) for s in range(STATES)])


def header(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


FOOTER = "<|end|>\n"


def lead(before: int, state: int) -> str:
    """What is rendered before a turn's text."""
    if before == state:
        return "\n"
    gap = GAPS.get((before, state)) or []
    return (FOOTER if before != START else "") + "".join(header(g) + FOOTER for g in gap) + header(state)


#: By state before and after: text before the turn, number of messages inserted; by last state: text after it.
LEAD = [lead(b, s) for b in range(STATES) for s in range(STATES)]
INSERTED = np.array([0 if b == s else len(GAPS.get((b, s)) or []) for b in range(STATES) for s in range(STATES)], np.int32)
TAIL = [FOOTER + "".join(header(g) + FOOTER for g in CLOSING[s]) for s in range(STATES)]
ACTIONS = ["keep", "merge", "relabel", "relabel+merge"]


def repaired(role: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's state on a cheapest way of its run, and each run's cost with what closes it.

    Runs start in state `begin`; they end in `end`, or in the cheapest state (closing
    counted) where it is negative.  Ties take the lower state.
    """
    run = np.repeat(np.arange(len(begin)), np.diff(first))
    cost = np.full((len(begin), STATES), np.inf)
    cost[np.arange(len(begin)), begin] = 0.0
    back = np.zeros((len(role), STATES), np.int8)
    # Row k of all runs that have one, for k = 0, 1, ...: these are the longest runs.
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    having = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left").tolist()
    for k, n in enumerate(having):
        at = first[:-1][order[:n]] + k
        way = cost[run[at]][:, :, None] + MOVES[role[at]]
        back[at] = way.argmin(axis=1)
        cost[run[at]] = way.min(axis=1)
    free = (cost + CLOSE).argmin(axis=1)
    last = np.where(end < 0, free, end)
    state = np.zeros(len(role), np.int64)
    now = last.copy()
    for k, n in enumerate(having):
        some = order[:n]
        at = first[1:][some] - 1 - k
        state[at] = now[some]
        now[some] = back[at, now[some]]
    return state, (cost + CLOSE)[np.arange(len(begin)), last]


def matrix(role: np.ndarray) -> np.ndarray:
    """The (min, +) product of the rows' moves: cost from the state before to the state after."""
    out = np.where(np.eye(STATES, dtype=bool), 0.0, np.inf)
    for r in role.tolist():
        out = (out[:, :, None] + MOVES[r][None]).min(axis=1)
    return out


def rendered(text: pa.Array, state: np.ndarray, before: np.ndarray, final: np.ndarray) -> pa.Array:
    """Each turn's piece of the rendered conversation; markers inside texts get a backslash, so that no text makes a turn."""
    text = pc.replace_substring_regex(pc.fill_null(text.cast(pa.large_string()), ""), r"<(\\*)\|", r"<\1\\|")
    head = pa.array(LEAD, pa.large_string()).take(pa.array(before * STATES + state))
    tail = pa.array([*TAIL, ""], pa.large_string()).take(pa.array(np.where(final, state, STATES)))
    return pc.binary_join_element_wise(head, text, tail, pa.scalar("", pa.large_string())).cast(pa.string())


OUT = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("position", pa.int64()), ("new_role", pa.string()), ("action", pa.string()), ("n_inserted", pa.int32()), ("conv_cost", pa.float64()), ("rendered", pa.string())])
OPEN = pa.schema([("open", pa.bool_()), ("part", pa.int32()), ("run", pa.int32()), ("role_no", pa.int32()), ("text", pa.string()), ("matrix", pa.list_(pa.float64()))])
WITH_OPEN = pa.schema([*OUT, *OPEN])


def finished(batch: pa.RecordBatch, first: np.ndarray, begin: np.ndarray, end: np.ndarray, final: np.ndarray, offset: np.ndarray, cost: np.ndarray | None = None) -> list[pa.Array]:
    """The columns of OUT for whole runs of a batch."""
    role = batch.column("role_no").to_numpy(zero_copy_only=False).astype(np.int64)
    state, total = repaired(role, first, begin, end)
    size = np.diff(first)
    before = np.concatenate(([0], state[:-1]))
    before[first[:-1]] = begin
    last = np.zeros(len(role), bool)
    last[first[1:] - 1] = final
    action = (state == before) + 2 * (state != role)
    position = np.arange(len(role)) - np.repeat(first[:-1] - offset, size)
    return [
        batch.column("conv_id"), batch.column("turn"), pa.array(position), pa.array(ROLES).take(pa.array(state)), pa.array(ACTIONS).take(pa.array(action)),
        pa.array(INSERTED[before * STATES + state]), pa.array(np.repeat(total if cost is None else cost, size)), rendered(batch.column("text"), state, before, last),
    ]


def whole(batch: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
    """Runs that are whole conversations, repaired."""
    n = len(first) - 1
    zero = np.zeros(n, np.int64)
    columns = finished(batch, first, zero + START, zero - 1, np.ones(n, bool), zero)
    return pa.record_batch([*columns, pa.array(np.zeros(len(batch), bool)), *(pa.nulls(len(batch), f.type) for f in list(OPEN)[1:])], schema=WITH_OPEN)


def left_open(batch: pa.RecordBatch, part: int, run: int) -> pa.RecordBatch:
    """One run that may go on elsewhere; its last row carries its matrix."""
    n = len(batch)
    role = batch.column("role_no").to_numpy(zero_copy_only=False)
    costs = pa.array([*[None] * (n - 1), matrix(role).ravel()], pa.list_(pa.float64()))
    constant = lambda v, t: pa.array(np.full(n, v), t)
    return pa.record_batch(
        [batch.column("conv_id"), batch.column("turn"), pa.array(np.arange(n)), *(pa.nulls(n, OUT.field(i).type) for i in range(3, 8)), constant(True, pa.bool_()), constant(part, pa.int32()), constant(run, pa.int32()), batch.column("role_no"), batch.column("text"), costs],
        schema=WITH_OPEN,
    )


def run_starts(batch: pa.RecordBatch, *names: str) -> np.ndarray:
    """Starts of the runs of equal values, and the number of rows; nulls equal each other."""
    new = np.zeros(len(batch), bool)
    new[:1] = True
    for name in names:
        column = batch.column(name)
        null, value = column.is_null().to_numpy(zero_copy_only=False), pc.fill_null(column, 0).to_numpy(zero_copy_only=False)
        new[1:] |= (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    return np.concatenate((np.flatnonzero(new), [len(batch)]))


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if len(batches) > 1 else batches[0]


def held_runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole runs with the runs' starts; a run that goes on in the next batch is held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        if held:
            # A long run is put together once, when it ends.
            edge = run_starts(joined([held[-1].slice(len(held[-1]) - 1), batch]), *names)
            if len(edge) == 2:
                held.append(batch)
                continue
            cut = int(edge[1]) - 1
            one = joined([*held, batch.slice(0, cut)] if cut else held)
            yield one, run_starts(one, *names)
            batch = batch.slice(cut)
        first = run_starts(batch, *names)
        if len(first) > 2:
            yield batch.slice(0, int(first[-2])), first[:-1]
        held = [batch.slice(int(first[-2]))]
    if held:
        one = joined(held)
        yield one, run_starts(one, *names)


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs all but the first and the last run of a partition."""
    part = TaskContext.get().partitionId()
    last = None
    first_done = False
    for batch, first in held_runs(batches, "conv_id"):
        if last is not None:
            if first_done:
                yield whole(*last)
            else:
                yield left_open(last[0], part, 0)
                first_done = True
            last = None
        begin = 0
        if not first_done and len(first) > 2:
            yield left_open(batch.slice(0, int(first[1])), part, 0)
            first_done, begin = True, 1
        if len(first) - 2 > begin:
            a, z = int(first[begin]), int(first[-2])
            yield whole(batch.slice(a, z - a), first[begin:-1] - a)
        tail = batch.slice(int(first[-2]))
        last = (tail, np.array([0, len(tail)]))
    if last is not None:
        yield left_open(last[0], part, 1)


ENDS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("run", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("final", pa.bool_()), ("offset", pa.int64()), ("total", pa.float64())])


def _join_parts(table: pa.Table) -> pa.Table:
    """First and last state of each part of one conversation: two rows for each partition at most."""
    table = table.sort_by([("part", "ascending"), ("run", "ascending")])
    ms = [np.array(c).reshape(STATES, STATES) for c in table.column("matrix").to_pylist()]
    cost = [np.where(np.arange(STATES) == START, 0.0, np.inf)]
    for m in ms:
        cost.append((cost[-1][:, None] + m).min(axis=0))
    state = int((cost[-1] + CLOSE).argmin())
    total = float((cost[-1] + CLOSE)[state])
    firsts, lasts = [], []
    for c, m in zip(reversed(cost[:-1]), reversed(ms), strict=True):
        lasts.append(state)
        state = int((c + m[:, state]).argmin())
        firsts.append(state)
    size = table.column("n").to_numpy()
    columns = [table.column("conv_id"), table.column("part"), table.column("run"), pa.array(firsts[::-1], pa.int32()), pa.array(lasts[::-1], pa.int32()), pa.array([False] * (len(ms) - 1) + [True]), pa.array(np.cumsum(size) - size), pa.array([total] * len(ms))]
    return pa.table(columns, schema=ENDS)


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs parts of conversations between the states that `_join_parts` found."""
    for batch, first in held_runs(batches, "part", "run"):
        value = lambda name: batch.column(name).take(pa.array(first[:-1])).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        columns = finished(batch, first, value("first").astype(np.int64), value("last").astype(np.int64), value("final").astype(bool), value("offset"), value("total"))
        yield pa.record_batch(columns, schema=OUT)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean", pa.float64(): "double", pa.list_(pa.float64()): "array<double>"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, position, new_role, action, n_inserted, conv_cost, rendered for each turn.

    Turns go by (turn, role, hash of the text, text), nulls first, so repeated numbers
    have a fixed order and repeated rows are turns of their own.  Roles count in any
    case and with spaces around; null and other roles fit none and are relabelled.  A
    null text is empty; texts may be of any length.  A null conversation id is one
    conversation; ids are of any type that can be ordered.  `position` counts a conversation's turns from 0.  `rendered` pieces
    joined in its order are the conversation's text, which `rendered_chunks` gives;
    n_inserted counts the empty messages put before a turn.  In texts, "<|" gets a
    backslash ("<\\|") and "<\\|" one more.  Other columns are not used.  Neither
    results nor their order depend on partitions.
    """
    role = F.lower(F.trim(F.col(role_col)))
    number = F.when(role == "system", SYSTEM).when(role == "user", USER).when(role == "assistant", ASSISTANT).otherwise(START).cast("int")
    base, back = with_long_ids(turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), number.alias("role_no"), F.col(text_col).cast("string").alias("text"), F.col(role_col).alias("role"), F.xxhash64(F.col(text_col)).alias("h")), "conv_id")
    # Range partitions by the whole order also cut a conversation that is most of the table; no text is sampled.
    order = ["conv_id", "turn", "role", "h"]
    rows = base.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("conv_id", "turn", "role_no", "text")
    done = written(rows.mapInArrow(_inside, _ddl(WITH_OPEN)))
    parts = done.where("open and matrix is not null").select("conv_id", "part", "run", "matrix", (F.col("position") + 1).alias("n"))
    ends = written(parts.groupBy("conv_id").applyInArrow(_join_parts, _ddl(ENDS)))
    some = done.where("open").select("conv_id", "turn", "position", "role_no", "text", "part", "run")
    # Two rows a partition at most.
    some = some.join(F.broadcast(ends.drop("conv_id")), ["part", "run"]).repartition("part", "run").sortWithinPartitions("part", "run", "position")
    late = some.mapInArrow(_between, _ddl(OUT))
    return back(done.where("not open").select(*OUT.names).union(late), "conv_id")


def rendered_chunks(repaired_turns: DataFrame, turns_per_chunk: int = 1000) -> DataFrame:
    """(conv_id, chunk, n_turns, conversation): up to `turns_per_chunk` turns as one text, so no row grows with a conversation's length."""
    piece = F.struct("position", "rendered")
    out = repaired_turns.groupBy("conv_id", F.floor(F.col("position") / turns_per_chunk).alias("chunk")).agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(piece)).alias("p"))
    return out.select("conv_id", "chunk", "n_turns", F.array_join(F.transform("p", lambda x: x["rendered"]), "").alias("conversation"))
