"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FILE, ROW, Scratch, located, noted, rank_within

#: Slots that the planning task sends at once.
PLAN_ROWS = 50_000


def exact(weights: list[float]) -> list[int]:
    """Whole numbers in just the proportions of weights."""
    parts = [Fraction(w) for w in weights]
    scale = math.lcm(*(p.denominator for p in parts))
    return [int(p * scale) for p in parts]


class Fluid:
    """The ideal schedule, in which all sources run at once, each at its weight's share of those that are left.

    Source s has done i blocks after i / w[s] of a common virtual time v, and ends at n[s] / w[s].
    The number of slots passed at v is the sum of min(n[s], w[s] v): linear between two ends,
    so it follows from what has ended by v and the weights that are left. Whole numbers
    throughout, so floors and ceilings are exact.
    """

    def __init__(self, n: list[int], w: list[int]) -> None:
        self.n, self.w = n, w
        self.order = sorted(range(len(n)), key=lambda s: Fraction(n[s], w[s]))
        self.ends = [n[s] / w[s] for s in self.order]
        self.ended = [0, *accumulate(n[s] for s in self.order)]
        total = sum(w)
        self.left = [total, *(total - x for x in accumulate(w[s] for s in self.order))]

    def slots(self, s: int, i: int) -> tuple[int, int]:
        """(numerator, denominator) of the slots passed when source s has done i blocks."""
        w = self.w[s]
        j = bisect_right(self.ends, i / w)
        while j and self.n[self.order[j - 1]] * w > i * self.w[self.order[j - 1]]:
            j -= 1
        while j < len(self.order) and self.n[self.order[j]] * w <= i * self.w[self.order[j]]:
            j += 1
        return self.ended[j] * w + i * self.left[j], w

    def window(self, s: int, i: int) -> tuple[int, int]:
        """(release time, deadline) of a block: the slots in which the ideal schedule runs it."""
        a, b = self.slots(s, i), self.slots(s, i + 1)
        return a[0] // a[1], -(-b[0] // b[1])


def schedule(blocks: list[int], weights: list[float]) -> Iterator[tuple[int, int]]:
    """(source, its block) of each slot, earliest deadline first among released blocks.

    Each block runs inside its window, as the windows hold the ideal schedule; so after any slot a source
    has done less than one block more or less than there. Sources of weight 0 come after
    all others, in proportion to their blocks. Memory follows the sources, not the blocks.
    """
    some = [s for s, n in enumerate(blocks) if n]
    for group in ([s for s in some if weights[s] > 0], [s for s in some if not weights[s] > 0]):
        if not group:
            continue
        n = [blocks[s] for s in group]
        fluid = Fluid(n, exact([float(weights[s]) if weights[s] > 0 else blocks[s] for s in group]))
        waiting = [(*fluid.window(s, 0), s, 0) for s in range(len(group))]
        heapq.heapify(waiting)
        ready: list[tuple[int, int, int]] = []
        for slot in range(sum(n)):
            while waiting and waiting[0][0] <= slot:
                _, due, s, i = heapq.heappop(waiting)
                heapq.heappush(ready, (due, s, i))
            _, s, i = heapq.heappop(ready)
            yield group[s], i
            if i + 1 < n[s]:
                heapq.heappush(waiting, (*fluid.window(s, i + 1), s, i + 1))


def _planned(weights: dict[str | None, float] | None, block_rows: int, temperature: float, kind: T.DataType):
    """(source, number of rows), all in one task, to (source, block, slot)."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [x for b in batches for x in zip(b.column("source").to_pylist(), b.column("n").to_pylist(), strict=True)]
        counts.sort(key=lambda x: (x[0] is None, str(x[0])))
        names = pa.array([c[0] for c in counts], kind)
        given = [weights.get(s, 0.0) if weights is not None else n**temperature for s, n in counts]
        held: list[tuple[int, int]] = []
        slot = 0

        def out() -> pa.RecordBatch:
            at, block = (np.array(x, np.int64) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(block), pa.array(slot + np.arange(len(held)))], ["source", "block", "slot"])

        for x in schedule([-(-n // block_rows) for _, n in counts], given):
            held.append(x)
            if len(held) == PLAN_ROWS:
                yield out()
                slot += len(held)
                held.clear()
        if held:
            yield out()

    return run


def mix_sources(df: DataFrame, weights: dict[str | None, float] | None = None, source: str = "source", id: str = "doc_id", block_rows: int = 64, temperature: float = 0.7, seed: int = 11, rows_per_bucket: int = 100_000) -> DataFrame:
    """df with block, slot and place: the order in which its rows are to be read.

    A source's rows, in a pseudo-random but fixed order, form blocks of block_rows. Blocks take
    slots by Pfair scheduling: after any slot, each source has had less than one block
    more or less than its weight's exact share. Within a slot, rows go by place. Every row keeps exactly
    one place: when a source ends, its weight goes to the others. weights by source name;
    without any, a source's weight is the number of its rows to the power of temperature. Sources that
    weights omits come last.

    df is written once. Rows are ranked in hash buckets of about rows_per_bucket, so a source of any size is
    spread, and get their slots by their places in that table, so wide rows are not shuffled. One task plans: it
    reads a row per source, holds as much, and writes a row per block, 150,000 to 500,000 a second; the
    driver holds nothing of either.

    A null source is a source of its own. Repeated rows and null or repeated ids have places of their own, by their
    places in the table; texts of any length are carried along. Columns of df named block, slot or place are replaced.
    Empty input gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "mixing")
    df = df.drop("block", "slot", "place")
    names = [f"x_{i}" for i in range(len(df.columns))]
    rows = scratch.table(df.toDF(*names), "rows")
    of = dict(zip(df.columns, names, strict=True))
    thin = located(rows.select(F.col(of[source]).alias("source"), F.col(of[id]).alias("id")))
    counts = thin.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    kind = df.schema[source].dataType
    planned = T.StructType([T.StructField("source", kind), T.StructField("block", T.LongType()), T.StructField("slot", T.LongType())])
    plan = scratch.table(counts.coalesce(1).mapInArrow(_planned(weights, block_rows, temperature, kind), planned), "plan")
    bits = max(8, (max(1, rows.count() // rows_per_bucket)).bit_length())
    # null ids have no order of their own, and are spread by their rows
    thin = thin.withColumn("spread", F.when(F.col("id").isNull(), F.col(ROW)))
    ranked = rank_within(thin, "source", ["id", "spread", FILE, ROW], bits, seed, hashed=["id", "spread"])
    ranked = ranked.select("source", FILE, ROW, F.expr(f"__x_rank div {block_rows}").alias("block"), (F.col("__x_rank") % block_rows).alias("place"))
    at = plan.toDF("p_source", "p_block", "slot")
    placed = ranked.join(at, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("block") == F.col("p_block"))).select(FILE, ROW, "block", "slot", "place")
    folder = scratch.notes(placed, "places")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, on, notes in noted(batches, folder):
            assert len(on) == part.num_rows, "a row has no place"
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(notes.column(c).combine_chunks() for c in ("block", "slot", "place"))], [*names, "block", "slot", "place"])

    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.LongType()) for n in ("block", "slot", "place"))])
    return located(rows).mapInArrow(place, schema).toDF(*df.columns, "block", "slot", "place")
