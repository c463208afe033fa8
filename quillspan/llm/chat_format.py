"""Chat formatting by minimum-cost role repair.

A legal conversation is at most one system turn, then user and assistant turns in alternation, beginning
with the user and ending with the assistant.  Each given turn is placed under its role (cost 0) or
another (RELABEL), perhaps after an empty turn that is put in (INSERT), or it is merged into the turn before
(MERGE, and RELABEL if the roles differ); an empty assistant turn may end the conversation (INSERT).
Dynamic programming over the states of this automaton finds the cheapest repair, ties by a fixed order of the choices.

The programming is split like a product of matrices over (min, +).  Turns are range-partitioned by
conversation and turn, so one very long conversation lies in many tasks.  Each task sums its part of a conversation up as
the cost from every state to every state; the parts of a conversation are then chained, which fixes
the states at their ends, and each task repairs its parts between those.

Defined cases: roles are read without case and blanks, and an unknown or null role costs RELABEL wherever it is
placed; a null text is an empty turn; turns with the same number are ordered by role and text (null first); a null conv_id is a conversation of
its own; an empty table gives an empty result; other columns are ignored.  A run of one role becomes one turn, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.llm.common import stored

ROLES = ("system", "user", "assistant")
#: States: nothing yet, then after a turn of each role.
START, STATES = 0, 4
FOLLOWERS = {0: (0, 1), 1: (1,), 2: (2,), 3: (1,)}  # state: roles that may come next
ENDS = 3
MERGE, INSERT, RELABEL = 1, 2, 3
INFINITE = 1 << 40


def choices(state: int, role: int) -> list[tuple[int, int, str, int]]:
    """What can be done with a turn: next state, cost, action, role of the turn put in before (-1: none)."""
    out = []
    for q in FOLLOWERS[state]:
        out.append((q + 1, 0 if q == role else RELABEL, "keep" if q == role else "relabel", -1))
    if state != START:
        own = state - 1 == role
        out.append((state, MERGE + (0 if own else RELABEL), "merge" if own else "merge_relabel", -1))
    for x in FOLLOWERS[state]:
        for q in FOLLOWERS[x + 1]:
            out.append((q + 1, INSERT + (0 if q == role else RELABEL), "keep" if q == role else "relabel", x))
    return out


#: By role (three, and unknown), then state.
CHOICES = [[choices(state, role) for state in range(STATES)] for role in (0, 1, 2, 3)]


def role_number(role: str | None) -> int:
    try:
        return ROLES.index((role or "").strip().lower())
    except ValueError:
        return 3


def advance(cost: list[int], role: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Costs after one more turn, and for each state the state and choice it was reached by."""
    after, back = [INFINITE] * STATES, [(-1, -1)] * STATES
    for state, so_far in enumerate(cost):
        if so_far >= INFINITE:
            continue
        for k, (then, price, _, _) in enumerate(CHOICES[role][state]):
            if so_far + price < after[then]:
                after[then], back[then] = so_far + price, (state, k)
    return after, back


def summary(roles: list[int]) -> list[list[int]]:
    """The least cost from each state to each state over the turns."""
    table = []
    for start in range(STATES):
        cost = [INFINITE] * STATES
        cost[start] = 0
        for role in roles:
            cost, _ = advance(cost, role)
        table.append(cost)
    return table


def repair(roles: list[int], start: int = START, end: int | None = None) -> tuple[int, list[tuple[str, int, int]], int]:
    """Cost, (action, role, role put in before or -1) of each turn, and the last state.

    Without ``end`` the conversation ends here and a missing last assistant turn is paid for.
    """
    cost = [INFINITE] * STATES
    cost[start] = 0
    tape = []
    for role in roles:
        cost, back = advance(cost, role)
        tape.append(back)
    if end is None:
        end = min(range(STATES), key=lambda s: (cost[s] + closing_cost(s), s))
        total = cost[end] + closing_cost(end)
    else:
        total = cost[end]
    done, state = [], end
    for role, back in zip(reversed(roles), reversed(tape)):
        before, k = back[state]
        _, _, action, put_in = CHOICES[role][before][k]
        done.append((action, state - 1, put_in))
        state = before
    return total, done[::-1], end


def closing_cost(state: int) -> int:
    """What it costs to end in a state: nothing after the assistant, an empty assistant turn after the user, both after the system."""
    return {ENDS: 0, 2: INSERT, 1: 2 * INSERT}.get(state, 2 * INSERT)


def _parts(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[object, dict[str, list]]]:
    """The turns of one conversation after the other, from rows sorted by conversation."""
    now, rows = None, None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in columns]
        for values in zip(batch.column("conv_id").to_pylist(), *cols):
            if rows is None or values[0] != now:
                if rows is not None:
                    yield now, rows
                now, rows = values[0], {c: [] for c in columns}
            for c, v in zip(columns, values[1:]):
                rows[c].append(v)
    if rows is not None:
        yield now, rows


def _pieces(batch: pa.RecordBatch, columns: tuple[str, ...]) -> Iterator[tuple[object, int, int, dict[str, list]]]:
    """The turns of each conversation in each piece of a batch."""
    for conv, rows in _parts(iter([batch]), ("part", "piece", *columns)):
        keys = list(zip(rows["part"], rows["piece"]))
        at = 0
        while at < len(keys):
            to = at + 1
            while to < len(keys) and keys[to] == keys[at]:
                to += 1
            yield conv, *keys[at], {c: rows[c][at:to] for c in columns}
            at = to


def _summary_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(conv, part, piece, sum(summary([role_number(r) for r in rows["role"]]), [])) for conv, part, piece, rows in _pieces(batch, ("role",))]
        ids, parts, piece, tables = zip(*out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, batch.schema.field("conv_id").type), pa.array(parts, pa.int32()), pa.array(piece, pa.int64()), pa.array(tables, pa.list_(pa.int64()))], ["conv_id", "part", "piece", "cost"]
        )


def _chain_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last state of each part; rows come sorted by conversation and part."""
    for_type = None

    def chained() -> Iterator[tuple]:
        for conv, rows in _parts(seen(), ("part", "piece", "cost")):
            tables = [np.array(c, np.int64).reshape(STATES, STATES) for c in rows["cost"]]
            ahead = [np.array([0] + [INFINITE] * (STATES - 1), np.int64)]
            for t in tables:
                ahead.append(np.minimum((ahead[-1][:, None] + t).min(0), INFINITE))
            end = min(range(STATES), key=lambda s: (int(ahead[-1][s]) + closing_cost(s), s))
            total = int(ahead[-1][end]) + closing_cost(end)
            states = [end]
            for k in range(len(tables) - 1, -1, -1):
                states.append(int((ahead[k] + tables[k][:, states[-1]]).argmin()))
            states = states[::-1]
            for k, (part, piece) in enumerate(zip(rows["part"], rows["piece"])):
                yield conv, part, piece, states[k], states[k + 1], k == len(tables) - 1, total

    def seen() -> Iterator[pa.RecordBatch]:
        nonlocal for_type
        for batch in batches:
            for_type = batch.schema.field("conv_id").type
            yield batch

    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        cols = list(zip(*held))
        kinds = (for_type, pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "part", "piece", "first", "last", "closes", "conversation_cost"])

    for row in chained():
        held.append(row)
        if len(held) >= 10_000:
            yield out()
            held = []
    if held:
        yield out()


def _repair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for conv, part, piece, rows in _pieces(batch, ("seq", "role", "text", "first", "last", "closes")):
            last = rows["last"][0]
            _, done, _ = repair([role_number(r) for r in rows["role"]], rows["first"][0], last)
            place = 0
            for seq, text, (action, role, put_in) in zip(rows["seq"], rows["text"], done):
                if put_in >= 0:
                    place += 1
                    out.append((conv, part, piece, place, 2 * seq, ROLES[put_in], "", "insert"))
                place += not action.startswith("merge")
                out.append((conv, part, piece, place, 2 * seq + 1, ROLES[role], text or "", action))
            if rows["closes"][0] and last < ENDS:
                for k, role in enumerate((1, 2)[last - 1 :]):
                    place += 1
                    out.append((conv, part, piece, place, 2 * rows["seq"][-1] + 2 + k, ROLES[role], "", "insert"))
        cols = list(zip(*out))
        kinds = (batch.schema.field("conv_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "part", "piece", "place", "seq", "role", "text", "action"])


#: Turns of a conversation that are summed up as one piece.
PIECE_TURNS = 4096


def repaired(turns: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, position (from 0), role, text, actions, rendered.

    ``actions`` lists what was done with the given turns of this one; an inserted turn has ``insert``.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    given = turns.select("conv_id", "turn", "role", "text")
    ordered = stored(
        given.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")),
        "turns",
    ).withColumn("piece", F.floor(F.col("seq") / PIECE_TURNS))
    sums = (
        ordered.select("conv_id", "part", "piece", "role", "seq").repartition("part", "piece").sortWithinPartitions("part", "piece", "seq").drop("seq")
        .mapInArrow(_whole_pieces(_summary_batches), f"conv_id {kind}, part int, piece long, cost array<long>")
    )
    ends = stored(
        sums.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
        .mapInArrow(_chain_batches, f"conv_id {kind}, part int, piece long, first int, last int, closes boolean, conversation_cost long"),
        "ends",
    )
    a, b = ordered.alias("a"), ends.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.piece") == F.col("b.piece"))
    placed = stored(
        a.join(b, same).select("a.*", "b.first", "b.last", "b.closes")
        .repartition("part", "piece").sortWithinPartitions("part", "piece", "seq")
        .mapInArrow(_whole_pieces(_repair_batches), f"conv_id {kind}, part int, piece long, place long, seq long, role string, text string, action string"),
        "placed",
    )
    before = Window.partitionBy("conv_id").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    offset = placed.groupBy("conv_id", "part", "piece").agg(F.max("place").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    c, d = placed.alias("c"), offset.alias("d")
    same = F.col("c.conv_id").eqNullSafe(F.col("d.conv_id")) & (F.col("c.part") == F.col("d.part")) & (F.col("c.piece") == F.col("d.piece"))
    rows = c.join(d, same).select("c.*", (F.col("d.offset") + F.col("c.place") - 1).alias("position"))
    parts = F.array_sort(F.collect_list(F.struct("part", "seq", "text", "action", "role")))
    return (
        rows.groupBy("conv_id", "position").agg(parts.alias("given"))
        .select(
            "conv_id",
            "position",
            F.element_at("given", 1)["role"].alias("role"),
            F.array_join(F.transform("given", lambda t: t["text"]), "\n").alias("text"),
            F.array_join(F.transform("given", lambda t: t["action"]), ",").alias("actions"),
        )
        .withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n")))
    )


def _whole_pieces(f):
    """Hand f batches that each hold whole pieces (at most PIECE_TURNS turns), whatever way the rows arrive."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def regrouped() -> Iterator[pa.RecordBatch]:
            rest: pa.Table | None = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                table = pa.Table.from_batches([batch])
                rest = table if rest is None else pa.concat_tables([rest, table])
                piece, part = rest["piece"].to_numpy(), rest["part"].to_numpy()
                cuts = np.flatnonzero((piece[1:] != piece[:-1]) | (part[1:] != part[:-1])) + 1
                if len(cuts):
                    yield from rest.slice(0, cuts[-1]).combine_chunks().to_batches()
                    rest = rest.slice(cuts[-1])
            if rest is not None:
                yield from rest.combine_chunks().to_batches()

        yield from f(regrouped())

    return whole


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet")).select("conv_id", "position", "role", "actions", "rendered")
