"""Best-fit packing with swap-based local search, on counts of lengths."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, rank_within

Pattern = tuple[int, ...]


def best_fit(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Best-fit decreasing; bins with the same contents are one pattern with a multiplicity.

    Work and memory follow the number of different lengths, at most the capacity, and not the
    number of documents.
    """
    open_: dict[int, Counter[Pattern]] = {}
    rooms: list[int] = []

    def put(pattern: Pattern, times: int) -> None:
        room = capacity - sum(pattern)
        if times and room not in open_:
            open_[room] = Counter()
            insort(rooms, room)
        if times:
            open_[room][pattern] += times

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                put((length,) * each, left // each)
                put((length,) * (left % each), int(left % each > 0))
                break
            room = rooms[at]
            pattern, times = open_[room].popitem()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            each = min(room // length, left)
            used = min(times, left // each)
            put(pattern + (length,) * each, used)
            put(pattern, times - used)
            left -= used * each
    return Counter({p: n for group in open_.values() for p, n in group.items() if p})


def _without(pattern: Pattern, items: Pattern) -> Pattern:
    out = list(pattern)
    for x in items:
        out.remove(x)
    return tuple(out)


def _gifts(pattern: Pattern) -> list[tuple[int, Pattern]]:
    """(sum, lengths) of what a bin can give: one or two documents."""
    kinds = sorted(set(pattern))
    twice = {x for x in kinds if pattern.count(x) > 1}
    return [(x, (x,)) for x in kinds] + [(x + y, (x, y)) for i, x in enumerate(kinds) for y in kinds[i:] if x != y or x in twice]


class _Takers:
    """Underfull patterns by the most that they can take, in exchange for nothing or for one of their documents.

    What a pattern returns and the most it takes for that tell how full it is, so a giver finds the exchange that
    fills a taker most without looking at patterns one by one.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.found: dict[int, dict[int, set[Pattern]]] = {}  # most taken -> returned -> patterns
        self.reaches: list[int] = []

    def add(self, pattern: Pattern) -> None:
        room = self.capacity - sum(pattern)
        for back in {0, *pattern}:
            if room + back not in self.found:
                self.found[room + back] = {}
                insort(self.reaches, room + back)
            self.found[room + back].setdefault(back, set()).add(pattern)

    def remove(self, pattern: Pattern) -> None:
        room = self.capacity - sum(pattern)
        for back in {0, *pattern}:
            group = self.found[room + back]
            group[back].discard(pattern)
            if not group[back]:
                del group[back]
            if not group:
                del self.found[room + back]
                self.reaches.pop(bisect_left(self.reaches, room + back))

    def best(self, giver: Pattern, alone: bool) -> tuple[Pattern, Pattern, int] | None:
        """(taker, gift, document returned or 0) of the exchange that leaves a taker the least room, and of those one that moves most.

        The sum of squared fills rises if the gift less what is returned exceeds the difference of the fills, that is if the taker
        can take less than the gift and the giver's room. alone: there is one bin of giver, which can't take from itself.
        """
        room = self.capacity - sum(giver)
        found, least = None, room
        for gift, parts in _gifts(giver):
            at = bisect_left(self.reaches, gift)
            while at < len(self.reaches) and self.reaches[at] - gift < least:
                backs = self.found[self.reaches[at]]
                for back in sorted(backs):
                    if back >= gift:
                        break
                    taker = next((p for p in backs[back] if not alone or p != giver), None)
                    if taker is not None:
                        found, least = (taker, parts, back), self.reaches[at] - gift
                        break
                at += 1
            if found and not least:
                break
        return found


def local_search(bins: Counter[Pattern], capacity: int) -> Counter[Pattern]:
    """Exchange documents between underfull bins until bins empty: moves of one or two, one for one, two for one and one for two.

    A legal exchange raises the sum of squared fills, so the search ends: when the number of bins meets the
    lower bound, or when no exchange of these kinds is left. Bins of one pattern exchange at
    once, so time follows the patterns, not the documents.
    """
    bins = Counter({p: n for p, n in bins.items() if n > 0})
    total = sum(sum(p) * n for p, n in bins.items())
    bound, count = -(-total // capacity), sum(bins.values())
    takers = _Takers(capacity)
    todo: list[tuple[int, Pattern]] = []
    for p in bins:
        if sum(p) < capacity:
            takers.add(p)
            heappush(todo, (sum(p), p))

    def change(pattern: Pattern, n: int) -> None:
        nonlocal count
        pattern = tuple(sorted(pattern, reverse=True))
        if not pattern or not n:
            return
        had = bins[pattern]
        bins[pattern] += n
        count += n
        if not bins[pattern]:
            del bins[pattern]
        if sum(pattern) < capacity:
            if not had:
                takers.add(pattern)
                heappush(todo, (sum(pattern), pattern))
            elif pattern not in bins:
                takers.remove(pattern)

    again = True
    while again and count > bound:
        again = False
        while todo and count > bound:
            _, giver = heappop(todo)
            if giver not in bins:
                continue
            got = takers.best(giver, bins[giver] == 1)
            if got is None:
                continue
            again = True
            taker, gift, back = got
            times = bins[giver] // 2 if taker == giver else min(bins[giver], bins[taker])
            change(giver, -times)
            change(taker, -times)
            change(_without(giver, gift) + ((back,) if back else ()), times)
            change(_without(taker, (back,) if back else ()) + gift, times)
            if giver in bins:
                heappush(todo, (sum(giver), giver))
        if count > bound:
            # one document for two: what a pattern gets from the index above seen from the other side
            for taker, giver, gift, back in list(_two_for_one(bins, capacity)):
                times = bins[giver] // 2 if taker == giver else min(bins[giver], bins[taker])
                if times <= 0:
                    continue
                again = True
                change(giver, -times)
                change(taker, -times)
                change(_without(giver, (gift,)) + back, times)
                change(_without(taker, back) + (gift,), times)
        if again:  # what was stuck may exchange with what is new
            todo = [(sum(p), p) for p in bins if sum(p) < capacity]
            heapify(todo)
    return bins


def _two_for_one(bins: Counter[Pattern], capacity: int) -> Iterator[tuple[Pattern, Pattern, int, Pattern]]:
    """(taker, giver, document given, the two returned), of patterns that can exchange so; a pattern at most once."""
    under = [p for p in bins if sum(p) < capacity]
    holders: dict[int, list[tuple[int, Pattern]]] = {}
    for p in under:
        for x in set(p):
            holders.setdefault(x, []).append((sum(p), p))
    for held in holders.values():
        held.sort()
    lengths = sorted(holders)
    used: set[Pattern] = set()
    for taker in sorted(under, key=lambda p: (-sum(p), p)):
        fill = sum(taker)
        best: tuple[int, Pattern, int, Pattern] | None = None
        for both, back in _gifts(taker):
            if len(back) < 2:
                continue
            # the longest document that fits, from the emptiest bin, first
            for at in range(bisect_right(lengths, both + capacity - fill) - 1, -1, -1):
                x = lengths[at]
                if x <= both or best and capacity - fill - (x - both) >= best[0]:
                    break
                giver = next((p for f, p in holders[x] if f < fill + x - both and p not in used and (p != taker or bins[p] > 1)), None)
                if giver:
                    best = (capacity - fill - (x - both), giver, x, back)
                    break
        if best and taker not in used:
            used |= {taker, best[1]}
            yield taker, best[1], best[2], best[3]


def solve(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Bins for documents counted by length: best fit and the search, from the counts' highest binary digit to the lowest.

    Each digit takes every bin found so far twice, adds best-fit bins for the lengths whose count has this digit, at most one
    document each, and searches on. So the search meets the real counts at the end, always starts from bins that are nearly
    settled, and works on as many patterns as there are lengths: a thousand times as many documents take ten more such steps.
    Where best fit over all documents at once needs fewer bins, as with very short documents, the search starts from that.
    """
    counts, bins = +Counter(counts), Counter()
    for digit in reversed(range(max(counts.values(), default=0).bit_length())):
        bins = Counter({p: 2 * n for p, n in bins.items()})
        for pattern, n in best_fit({x: 1 for x, n in counts.items() if n >> digit & 1}, capacity).items():
            bins[tuple(sorted(pattern, reverse=True))] += n
        bins = local_search(bins, capacity)
    whole = best_fit(counts, capacity)
    return bins if sum(bins.values()) <= sum(whole.values()) else local_search(Counter({tuple(sorted(p, reverse=True)): n for p, n in whole.items()}), capacity)


#: Parts of a pattern's bins that take ordered rows in turn with the parts of other patterns.
BANDS = 32


def plan(counts: dict[int, int], capacity: int, bands: int = 1) -> np.ndarray:
    """Places as rows (length, first rank, first bin of these, bins of the pattern, first sequence, offset, pattern), sorted by length and rank.

    A pattern's bins are cut into bands; the bands of all patterns that hold a length take its ranks in order of
    how far in their pattern they are.
    """
    bins = solve(counts, capacity)
    found, sequence = [], 0
    for no, pattern in enumerate(sorted(bins, reverse=True)):
        n, offset = bins[pattern], 0
        parts = min(bands, n)
        for length in pattern:
            for b in range(parts):
                low, high = n * b // parts, n * (b + 1) // parts
                found.append((length, low / n, no, offset, high - low, low, n, sequence))
            offset += length
        sequence += n
    seen: Counter[int] = Counter()
    rows = []
    for length, _, no, offset, size, low, n, sequence in sorted(found):
        rows.append((length, seen[length], low, n, sequence, offset, no))
        seen[length] += size
    assert seen == +Counter(counts)
    return np.array(rows, np.int64).reshape(-1, 7)


def _positions(df: DataFrame, major: str, minor: str) -> tuple[DataFrame, int]:
    """df with __x_position, the place of its (major, minor) if all minors from 0 on were there, and an end of these places. One row per major is ranked alone."""
    sizes = df.groupBy(F.col(major).alias("__x_major")).agg((F.max(minor) + 1).alias("__x_n"))
    by = Window.orderBy("__x_major").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__x_first", F.coalesce(F.sum("__x_n").over(by), F.lit(0)))
    end = sizes.agg(F.sum("__x_n")).first()[0] or 0
    return df.join(sizes, F.col(major) == F.col("__x_major")).withColumn("__x_position", F.col("__x_first") + F.col(minor)).drop("__x_major", "__x_n", "__x_first"), end


def pack(df: DataFrame, capacity: int, length: str = "length", rows_per_bucket: int = 100_000, order: tuple[str, str] | None = None) -> DataFrame:
    """df with sequence_id and offset: every row has a place in a sequence of at most capacity.

    Rows of one length are interchangeable. Their counts (at most capacity numbers) go to
    the driver, which plans patterns of bins; the rows are ranked within their length in
    buckets of about rows_per_bucket, and each takes the place of its rank. So no
    length or group of rows meets in one task. df is read three times and should be a
    written table. Every length must be between 1 and capacity. Empty input gives an
    empty result. Columns of df named sequence_id or offset are replaced.

    Without order, ranks are pseudo-random and sequences are numbered from 0. order names a column that comes first in an order of
    the rows (not null, with few values, such as files) and a number from 0 inside it, which go from the result: the rows of a length take bins of a
    pattern in that order, and sequences are numbered by how far in their pattern they are. So the sequences up to any
    number hold about the same first part of the rows of every length, and of every source that the order mixes.
    """
    df = df.drop("sequence_id", "offset")
    counts = {r[0]: r[1] for r in df.groupBy(length).count().collect()}
    if bad := [n for n in counts if n is None or not 1 <= n <= capacity]:
        raise ValueError(f"lengths outside 1 to {capacity}: {bad[:5]}")
    places = plan(counts, capacity, BANDS if order else 1)
    bits = max(8, (max(1, sum(counts.values()) // rows_per_bucket)).bit_length())
    keys = [c for c in df.columns if not isinstance(df.schema[c].dataType, (T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    if order:
        at, end = _positions(df, *order)
        ranked = rank_within(at, length, ["__x_position", *(c for c in keys if c not in order)], bits, 17, at=("__x_position", end))
        df = df.drop(*order)
    else:
        ranked = rank_within(df, length, keys, bits, 17)
    names, ordered = df.columns, bool(order)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.rec.fromarrays(places[:, :2].T, names="n,r") if len(places) else None
        for b in batches:
            if not b.num_rows:
                continue
            n, r = (b.column(c).to_numpy().astype(np.int64) for c in (length, "__x_rank"))
            at = np.searchsorted(first, np.rec.fromarrays([n, r], names="n,r"), side="right") - 1
            _, rank, low, bins, start, offset, pattern = places[at].T
            own = low + r - rank
            sequence = ((own + 0.5) / bins * 2**38).astype(np.int64) << 22 | pattern if ordered else start + own
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = T.StructType([*df.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def pack_documents(df: DataFrame, path: str, kind: str = "word", text: str = "text", id: str = "doc_id", capacity: int = 2048, end: int | None = 0, keep_ids: bool = True, order: tuple[str, str] | None = None) -> DataFrame:
    """Whole documents as token sequences of at most capacity: one row per piece of a document.

    Columns: id, piece, start, length, ids (only with keep_ids), ids_crc32, sequence_id, offset.
    Only documents longer than capacity are cut, into pieces of capacity, the last of
    which may be shorter. A null text is an empty one, of the end id alone; without an
    end id it has no piece. Repeated rows and null ids are documents of their own; extra
    columns are ignored. order as in pack. Empty input gives an empty result.
    """
    from .tokens import token_pieces

    scratch = Scratch(df.sparkSession, "packing")
    by = [F.col(c).alias(f"p_order_{i}") for i, c in enumerate(order or ())]
    picked = df.select(F.col(id).alias("p_id"), F.col(text).cast("string").alias("p_text"), *by)
    pieces = token_pieces(picked, path, kind, "p_text", capacity, end).withColumn("ids_crc32", F.crc32("ids"))
    pieces = scratch.table(pieces if keep_ids else pieces.drop("ids"), "pieces")
    packed = pack(pieces, capacity, order=("p_order_0", "p_order_1") if order else None)
    return scratch.finish(packed.withColumnRenamed("p_id", id))
