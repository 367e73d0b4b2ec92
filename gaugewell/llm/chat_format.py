"""Chat formatting: minimum-cost role repair over a legal-turn automaton, then rendering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: States are the role of the last turn; the first is before any turn.
STATES = ("start", "system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: A conversation is [system] (user assistant)+.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = ASSISTANT
OTHER = 4
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    relabel: int = 2
    insert: int = 3


Step = tuple[int, tuple[int, ...], bool]


def inserts(costs: Costs) -> dict[tuple[int, int], tuple[int, ...]]:
    """Fewest empty turns that lead from one state to another; a state reaches itself without any."""
    found = {(s, s): () for s in range(4)}
    for _ in range(4):
        for (a, b), path in list(found.items()):
            for c in LEGAL[b]:
                if len(path) + 1 < len(found.get((a, c), range(9))):
                    found[a, c] = (*path, c)
    return found


def steps(costs: Costs) -> dict[tuple[int, int, int], Step]:
    """(state, role of the message, state after it) to the cheapest (cost, empty turns before it, whether it is merged).

    Of equal costs, fewer empty turns and then a turn of its own come first.
    """
    ways = inserts(costs)
    out: dict[tuple[int, int, int], Step] = {}
    for s, r, t in product(range(4), range(5), (SYSTEM, USER, ASSISTANT)):
        label = 0 if t == r else costs.relabel
        options = [(costs.merge + label, (), True)] if s == t else []
        options += [(label + costs.insert * len(w), w, False) for (a, b), w in ways.items() if a == s and t in LEGAL[b]]
        if options:
            out[s, r, t] = min(options, key=lambda o: (o[0], len(o[1]), o[2], o[1]))
    return out


def forward(roles: list[int], entry: int, table: dict[tuple[int, int, int], Step], back: bool = True) -> tuple[list, list]:
    """From one state over all messages: per state (cost, turns opened) or None, and the predecessors."""
    now: list[tuple[int, int] | None] = [None] * 4
    now[entry] = (0, 0)
    trail = []
    for r in roles:
        after: list[tuple[int, int] | None] = [None] * 4
        came = [0] * 4
        for s in range(4):
            if now[s] is None:
                continue
            for t in (SYSTEM, USER, ASSISTANT):
                step = table.get((s, r, t))
                if step and (after[t] is None or now[s][0] + step[0] < after[t][0]):
                    after[t] = (now[s][0] + step[0], now[s][1] + len(step[1]) + (not step[2]))
                    came[t] = s
        now = after
        if back:
            trail.append(came)
    return now, trail


def path(trail: list, end: int) -> list[int]:
    """States after each message, ending in end."""
    out = []
    for came in reversed(trail):
        out.append(end)
        end = came[end]
    return out[::-1]


def closing(costs: Costs) -> list[tuple[int, tuple[int, ...]]]:
    ways = inserts(costs)
    return [(costs.insert * len(ways[s, FINAL]), ways[s, FINAL]) for s in range(4)]


def repair(roles: list[int], costs: Costs = Costs()) -> tuple[int, list[int]]:
    """(cost, states) of a whole conversation."""
    now, trail = forward(roles, START, steps(costs))
    end = min((x[0] + closing(costs)[s][0], s) for s, x in enumerate(now) if x is not None)
    return end[0], path(trail, end[1])


def role_number(role: str | None) -> int:
    return ROLES.get((role or "").strip().lower(), OTHER)


def _segments(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of equal (part, conversation), with their rows."""
    key, rows = None, []
    for b in batches:
        for k in zip(*(b.column(c).to_pylist() for c in ("part", "conv", *names)), strict=True):
            if k[:2] != key:
                if rows:
                    yield key, rows
                key, rows = k[:2], []
            rows.append(k[2:])
    if rows:
        yield key, rows


def format_chats(df: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", costs: Costs = Costs(), partitions: int | None = None, head: str = "<|{role}|>\n", joint: str = "\n\n", foot: str = "\n<|end|>\n") -> DataFrame:
    """Repair each conversation's roles at the least cost and render it.

    A conversation is legal as [system] (user assistant)+. Messages in order of turn (ties by
    role and a hash of the text) each stay a turn, join the turn before them (merge), or change their role
    (relabel, with or without a merge); empty turns may be inserted anywhere, also at the
    end. The sum of costs is the least possible; of equal ways the one with fewer
    empty turns, then without a merge.

    Returns a row per message and inserted turn: id, position (orders the rows of a
    conversation), turn_no (of the repaired conversation, from 0), role, source_turn, action (keep,
    merge, relabel, relabel+merge or insert), text, rendered. The rendered parts of a conversation
    in order of position, one after another, are its rendering.

    Conversations of any length are spread: rows are sorted over partitions, each partition gives its
    border conversations' costs from every state to every state (min-plus matrices, a few
    numbers per partition for the driver), and, once the states at the borders are known,
    solves its part alone.

    Roles other than system, user and assistant, in any case, and null roles are always relabelled. A
    null text is an empty one; very long texts are carried whole. A null id is a conversation of its own. Null turns come
    first. Repeated rows are messages of their own. Extra columns are ignored. Empty
    input gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "chat")
    picked = df.select(F.col(id).alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    types = {f.name: f.dataType.simpleString() for f in picked.schema.fields}
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("t_hash"), F.col("tie")]
    tied = picked.withColumn("t_hash", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
    spread = tied.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("t_hash", "tie")
    rows = scratch.table(spread.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "turns")
    dealt = lambda *columns: rows.select("part", "conv", "at", *columns).repartition(n, "part").sortWithinPartitions("part", "at")
    table, ends = steps(costs), closing(costs)

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def matrix(part: int, conv: object, roles: list[int]) -> tuple:
            cells = []
            for s in range(4):
                now, _ = forward(roles, s, table, back=False)
                cells += [v for x in now for v in (x or (-1, -1))]
            return part, conv, cells

        first = last = None
        for (part, conv), got in _segments(batches, ("role",)):
            roles = [role_number(r[0]) for r in got]
            if first is None or first[0] != part:
                if last:
                    found.append(matrix(*last))
                first, last = (part, conv, roles), None
                found.append(matrix(*first))
            else:
                last = (part, conv, roles)
        if last:
            found.append(matrix(*last))
        kinds = (pa.int32(), batches_conv, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["part", "conv", "cells"])

    from pyspark.sql.pandas.types import to_arrow_type

    batches_conv = to_arrow_type(picked.schema["conv"].dataType)
    known: dict[tuple, tuple[int, int, int, bool]] = {}
    chain: list = []

    def solve(chain: list) -> None:
        """The states at the borders of one conversation's segments: entry, exit, turns before, whether it ends there."""
        now: list[tuple[int, int] | None] = [(0, 0), None, None, None]
        trail = []
        for r in chain:
            after: list[tuple[int, int] | None] = [None] * 4
            came = [0] * 4
            for s, t in product(range(4), range(4)):
                cost, turns = r["cells"][2 * (4 * s + t) : 2 * (4 * s + t) + 2]
                if now[s] is not None and cost >= 0 and (after[t] is None or now[s][0] + cost < after[t][0]):
                    after[t] = (now[s][0] + cost, turns)
                    came[t] = s
            now = after
            trail.append(came)
        end = min((x[0] + ends[s][0], s) for s, x in enumerate(now) if x is not None)[1]
        exits = path(trail, end)
        entry, turns = START, 0
        for i, (r, e) in enumerate(zip(chain, exits, strict=True)):
            known[r["part"], r["conv"]] = (entry, e, turns, i == len(chain) - 1)
            turns += r["cells"][2 * (4 * entry + e) + 1]
            entry = e

    found = dealt("role").mapInArrow(borders, f"part int, conv {types['conv']}, cells array<bigint>").collect()
    # in order of the rows: within a part its first conversation comes before its last
    for r in sorted(enumerate(found), key=lambda x: (x[1]["part"], x[0])):
        if chain and chain[-1]["conv"] != r[1]["conv"]:
            solve(chain)
            chain = []
        chain.append(r[1])
    if chain:
        solve(chain)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)
            out.clear()
            return got

        for (part, conv), got in _segments(batches, ("at", "turn", "role", "text")):
            roles = [role_number(r[2]) for r in got]
            entry, end, turns, closes = known.get((part, conv), (START, None, 0, True))
            now, trail = forward(roles, entry, table)
            if end is None:
                end = min((x[0] + ends[s][0], s) for s, x in enumerate(now) if x is not None)[1]
            state, no = entry, turns - 1

            def opened(s: int, body: str, at: int, source: object, action: str) -> tuple:
                return (conv, at, no, STATES[s], source, action, body, (foot if no else "") + head.format(role=STATES[s]) + body)

            for (at, source, _, body), r, t in zip(got, roles, path(trail, end), strict=True):
                _, empty, merged = table[state, r, t]
                for j, s in enumerate(empty):
                    no += 1
                    out.append(opened(s, "", at * 8 + j, None, "insert"))
                same = "keep" if t == r else "relabel"
                if merged:
                    out.append((conv, at * 8 + 4, no, STATES[t], source, "merge" if t == r else "relabel+merge", body, joint + body))
                else:
                    no += 1
                    out.append(opened(t, body, at * 8 + 4, source, same))
                state = t
            if closes:
                for j, s in enumerate(ends[state][1]):
                    no += 1
                    out.append(opened(s, "", at * 8 + 5 + j, None, "insert"))
                out[-1] = (*out[-1][:-1], out[-1][-1] + foot)
            if len(out) > 2000:
                yield flush()
        yield flush()

    names = [id, "position", "turn_no", "role", "source_turn", "action", "text", "rendered"]
    kinds = (batches_conv, pa.int64(), pa.int64(), pa.string(), to_arrow_type(picked.schema["turn"].dataType), pa.string(), pa.string(), pa.string())
    result = f"{id} {types['conv']}, position long, turn_no long, role string, source_turn {types['turn']}, action string, text string, rendered string"
    return dealt("turn", "role", "text").mapInArrow(write, result)
