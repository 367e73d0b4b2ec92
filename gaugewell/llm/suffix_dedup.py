"""Repeated passages across documents by a sparse suffix array over content-selected positions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FILE, ROW, Scratch, WordHashes, fingerprint, located, mix, noted, signed, words_of

#: Words of the k-gram that selects a position.
GRAM = 8
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, base: int, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        steps = np.full(1 << (n - 1).bit_length(), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps)
    return _powers[name][:n]


class Windows:
    """Hashes of any windows of a word sequence in constant time each, from prefix sums modulo 2^64."""

    def __init__(self, h: np.ndarray) -> None:
        self.n = len(h)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _power("up", _BASE, self.n))])
        self.down = _power("down", _INVERSE, self.n)

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start] + np.uint64(length))


def _sliding(x: np.ndarray, w: int, pick: np.ufunc) -> np.ndarray:
    """pick over each w neighbours, by doubling."""
    span = 1
    while span < w:
        step = min(span, w - span)
        x = pick(x[: len(x) - step], x[step:])
        span += step
    return x


def minimisers(windows: Windows, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, k-gram hashes) of the smallest k-gram of every window of length words, all of equal ones.

    What a window selects depends on its words alone, so a passage of at least length
    words selects the same places wherever it stands.
    """
    if windows.n < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    g = windows.at(np.arange(windows.n - GRAM + 1), GRAM)
    w = length - GRAM + 1
    low = np.pad(_sliding(g, w, np.minimum), w - 1)
    place = np.flatnonzero(_sliding(low, w, np.maximum) == g)
    return place, g[place]


def half(length: int) -> int:
    """Words of the windows that select positions: a passage has one among the first half of its words."""
    return length // 2


def suffix_keys(windows: Windows, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of the retained suffixes: a key is the hash of the first words of the suffix, as many as any passage has from there on.

    The first half of a passage's words selects a place at which its words end a GRAM at the latest, so the rest of
    the passage from there is at least length - half + GRAM words.
    """
    place, _ = minimisers(windows, half(length))
    place = place[place + length - half(length) + GRAM <= windows.n]
    return place, windows.at(place, length - half(length) + GRAM)


def whole_windows(windows: Windows, place: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows of length words whose first half selects one of place: the matches' possible extensions to both sides."""
    most = half(length) - GRAM
    g = windows.at(np.arange(windows.n - GRAM + 1), GRAM)
    low = _sliding(g, most + 1, np.minimum)
    start = (place[:, None] - np.arange(most + 1)).ravel()
    least = np.repeat(g[place], most + 1)
    inside = (start >= 0) & (start + length <= windows.n)
    start, least = start[inside], least[inside]
    return np.unique(start[low[start] == least])


def _suffixes(length: int):
    """Rows with x_text to the same with node, number of words, and the places and keys of the retained suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        none = np.empty(0, np.int64)
        for b in batches:
            node, n, places, keys = [], [], [], []
            for t in b.column("x_text").cast(pa.binary()).to_pylist():
                h = cache.of(words_of(t))
                node.append(fingerprint(h))
                n.append(len(h))
                p, k = suffix_keys(Windows(h), length) if len(h) >= length else (none, none)
                places.append(p)
                keys.append(signed(k))
            at = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([none, *x]).astype(kind))) for x, kind in ((places, np.int32), (keys, np.int64))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node, pa.int64()), pa.array(n, pa.int64()), *lists], [*b.schema.names, "node", "n_words", "places", "keys"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes (key, node, place) to those that have a neighbour of the same key from another node.

    The first and the last run of a partition may go on in its neighbours, so all of their
    members stay. A run is held only until its second node comes.
    """
    held: list[pa.RecordBatch] = []
    live = False  # whether the run that goes on from batch to batch stays
    key = node = None
    for b in batches:
        if not b.num_rows:
            continue
        k, d = (b.column(c).to_numpy() for c in ("key", "node"))
        cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        end = np.concatenate([cut[1:], [len(k)]])
        keep = d[cut] != d[end - 1]  # sorted by node inside a run
        on = key is not None and k[0] == key
        if on:
            live = live or bool(d[0] != node) or bool(keep[0])
            keep[0] = live
            if live:
                yield from held
        if not on or live or len(cut) > 1:
            held = []
        if key is None:
            keep[0] = True
        if len(cut) > 1 or not on:
            live = bool(keep[-1])
        key, node = k[-1], d[-1]
        mask = np.repeat(keep, end - cut)
        if not keep[-1]:
            held.append(b.slice(int(cut[-1])))
        if mask.any():
            yield b.filter(pa.array(mask))
    yield from held  # the last run


def _windowed(folder: str, length: int):
    """Noted texts to a row per window of length words around the noted places: (o, node, s, w), w being the window's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for part, on, notes in noted(batches, folder):
            if not len(on):
                continue
            at, starts, hashes = [], [], []
            texts = part.column("x_text").take(pa.array(on)).cast(pa.binary())
            places = notes.column("places").combine_chunks()
            for i in range(len(on)):
                windows = Windows(cache.of(words_of(texts[i].as_py())))
                s = whole_windows(windows, np.unique(places[i].values.to_numpy(zero_copy_only=False)).astype(np.int64), length)
                at.append(np.full(len(s), i))
                starts.append(s)
                hashes.append(signed(windows.at(s, length)))
            rows = pa.array(np.concatenate(at))
            own = [notes.column(c).combine_chunks().take(rows) for c in ("o", "node")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(hashes))], ["o", "node", "s", "w"])

    return run


def _runs(cover: np.ndarray) -> list[list[int]]:
    x = np.concatenate([[False], cover, [False]])
    return np.flatnonzero(x[1:] != x[:-1]).reshape(-1, 2).tolist()


def _retained(base: DataFrame, length: int) -> DataFrame:
    added = [("node", T.LongType()), ("n_words", T.LongType()), ("places", T.ArrayType(T.IntegerType())), ("keys", T.ArrayType(T.LongType()))]
    return base.mapInArrow(_suffixes(length), T.StructType([*base.schema.fields, *(T.StructField(n, t) for n, t in added)]))


def _passages(rows: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """Retained rows, written, to spans: id, FILE, ROW, start_word, end_word, other_id, removable."""
    long_ = located(rows.select("x_id", "node", "n_words")).where(F.col("n_words") >= length)
    first = F.min(F.struct(F.col("x_id").isNull().alias("no_id"), F.col("x_id").alias("id"), FILE, ROW))
    nodes = long_.groupBy("node").agg(first.alias("low"), F.max("x_id").alias("max_id"), F.count(F.lit(1)).alias("copies"))
    nodes = nodes.select("node", "low", "max_id", "copies", F.coalesce("low.id", "node").alias("o"))
    nodes = scratch.table(nodes, "nodes")

    # the suffixes in order of their first words, of each node once, compared with their neighbours
    own = located(rows.select("node", "places", "keys")).where(F.size("keys") > 0)
    chosen = nodes.where("copies > 1").select(F.col("node").alias("n"), F.col(f"low.{FILE}").alias("f"), F.col(f"low.{ROW}").alias("r"))
    others = long_.select("node", FILE, ROW).join(chosen, F.col("node") == F.col("n")).where((F.col(FILE) != F.col("f")) | (F.col(ROW) != F.col("r")))
    again = scratch.notes(others.select(FILE, ROW), "copies")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, on, _ in noted(batches, again):
            keep = np.ones(part.num_rows, bool)
            keep[on] = False
            part = part.filter(pa.array(keep))
            if part.num_rows:
                keys = part.column("keys")
                yield pa.RecordBatch.from_arrays([keys.flatten(), part.column("node").take(pc.list_parent_indices(keys)), part.column("places").flatten()], ["key", "node", "place"])

    suffixes = scratch.table(own.mapInArrow(once, "key long, node long, place int"), "suffixes")
    n = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("key", "node", "place")
    array = suffixes.repartitionByRange(n, *order).sortWithinPartitions(*order)
    runs = array.mapInArrow(_neighbours, "key long, node long, place int")
    places = runs.groupBy("node").agg(F.collect_list("place").alias("places"))
    wanted = places.join(nodes.select("node", "o", f"low.{FILE}", f"low.{ROW}"), "node").select(FILE, ROW, "node", "o", "places")
    folder = scratch.notes(wanted, "wanted")

    # matches extended to both sides: every window around a retained place, and who has it
    texts = located(rows.select("x_text")).mapInArrow(_windowed(folder, length), "o long, node long, s int, w long")
    windows = scratch.table(texts, "windows")
    who = F.struct("o", "node")
    classes = windows.groupBy("w").agg(F.min(who).alias("lo"), F.max(who).alias("hi")).where("lo.node != hi.node")
    shared = windows.join(classes, "w").withColumn("later", F.col("node") != F.col("lo.node"))
    shared = shared.select("node", "s", "later", F.when(F.col("later"), F.col("lo.o")).otherwise(F.col("hi.o")).alias("other"))
    by = Window.partitionBy("node", "later").orderBy("s")
    marked = shared.withColumn("new", F.coalesce(F.col("s") > F.lag("s").over(by) + length, F.lit(True)).cast("int"))
    marked = marked.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = marked.groupBy("node", "later", "island").agg(F.min("s").cast("long").alias("s"), (F.max("s") + length).cast("long").alias("e"), F.min("other").alias("other"))
    spans = scratch.table(spans.select("node", "s", "e", "other", "later"), "spans")

    # the first row of a node has its spans; of a node with copies all other rows are removable whole
    base = long_.join(nodes, "node").withColumn("is_first", (F.col(FILE) == F.col(f"low.{FILE}")) & (F.col(ROW) == F.col(f"low.{ROW}")))
    parts = base.where("is_first").select("x_id", FILE, ROW, "node").join(spans, "node").drop("node")
    whole = base.where("copies > 1").select("x_id", FILE, ROW, F.lit(0).cast("long").alias("s"), F.col("n_words").alias("e"), F.when(F.col("is_first"), F.col("max_id")).otherwise(F.col("low.id")).alias("other"), (~F.col("is_first")).alias("later"))
    out = parts.unionByName(whole)
    return out.select(F.col("x_id").alias("id"), FILE, ROW, F.col("s").alias("start_word"), F.col("e").alias("end_word"), F.col("other").alias("other_id"), F.col("later").alias("removable"))


def _check(length: int) -> None:
    if length < 4 * GRAM:
        raise ValueError(f"length must be at least {4 * GRAM}")


def repeated_passages(df: DataFrame, text: str = "text", id: str = "doc_id", length: int = 50) -> DataFrame:
    """Passages of at least length words that stand in two or more rows, words lower-cased in A-Z only.

    Returns a row per row of df and maximal span of its words: id, start_word, end_word
    (exclusive), other_id (of another row that has words of the span: the smallest one where the span is removable),
    removable (each window of length words in the span also stands in a row before this one, by id: all but
    one occurrence are). A row can have spans of both kinds, which may overlap.

    Rows of equal word sequences are one node from the start; in all of them but that of the
    smallest id the whole text is removable. The suffixes that are retained start at the minimisers of each
    window of length / 2 words. They are sorted by a hash of as many words as any passage has from there on, in ranges
    that split runs of any size, and compared with their neighbours; those without an equal neighbour go. The others are
    extended to both sides: each window of length words around such a place is compared with those of all other
    texts by its hash, in one aggregation, so what is told of a window is exact for all rows whatever their number, and
    the union of these windows is the maximal spans. Work follows the words in repeated
    places, not the pairs of texts. Words are compared by 64-bit hashes. Repeats inside one text
    alone are not reported.

    Null texts and texts of fewer than length words have no passages; very long texts are read whole. Null ids are compared as
    others are, after all others. Repeated rows are copies of each other. Rows of one id with different texts are
    different rows, and other_id can then be the id itself.
    Extra columns are ignored; id must be integral. Empty input gives an empty result.
    """
    _check(length)
    scratch = Scratch(df.sparkSession, "suffix")
    base = df.select(F.col(id).cast("long").alias("x_id"), F.col(text).cast("string").alias("x_text"))
    rows = scratch.table(_retained(base, length), "rows")
    return scratch.finish(_passages(rows, scratch, length).drop(FILE, ROW).withColumnRenamed("id", id))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _cut(text: bytes, gone: np.ndarray, words: list[tuple[int, int]]) -> bytes:
    """A text without the words that go, and without what stands between each of them and the next word."""
    out, last = [], 0
    for s, e in _runs(gone):
        out.append(text[last : words[s][0]])
        last = words[e][0] if e < len(words) else len(text)
    out = b"".join([*out, text[last:]])
    return out.rstrip(b"\x20\x09\x0a\x0b\x0c\x0d") if last == len(text) else out


def cut_repeated_passages(df: DataFrame, text: str = "text", id: str = "doc_id", length: int = 50, n_chars: str | None = "n_chars") -> DataFrame:
    """df's rows, in df's columns, with the removable spans of repeated_passages cut from their texts; a row of which no word is left goes.

    Columns and their order stay; n_chars, if df has it, is counted anew where a text changes. All columns are written once
    beside the suffixes; spans are noted by the rows' places, so whole texts are not shuffled. text must be a string column.
    """
    _check(length)
    scratch = Scratch(df.sparkSession, "cuts")
    names = [f"x_{i}" for i in range(len(df.columns))]
    own, counted = names[df.columns.index(text)], names[df.columns.index(n_chars)] if n_chars in df.columns else None
    wide = df.toDF(*names)
    wide = wide.select("*", F.col(names[df.columns.index(id)]).cast("long").alias("x_id"), F.col(own).cast("string").alias("x_text"))
    rows = scratch.table(_retained(wide, length), "rows")
    spans = _passages(rows, scratch, length).where("removable").groupBy(FILE, ROW).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    folder = scratch.notes(spans, "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, on, notes in noted(batches, folder):
            columns = {c: part.column(c) for c in names}
            left = np.ones(part.num_rows, bool)
            if len(on):
                texts, lists = [], notes.column("spans").to_pylist()
                for i, t, found in zip(on.tolist(), columns[own].take(pa.array(on)).cast(pa.binary()).to_pylist(), lists, strict=True):
                    words = [m.span() for m in _WORD.finditer(t)]
                    gone = np.zeros(len(words), bool)
                    for x in found:
                        gone[x["start_word"] : x["end_word"]] = True
                    left[i] = not gone.all()
                    texts.append(_cut(t, gone, words).decode("utf-8", "replace"))
                mask = np.zeros(part.num_rows, bool)
                mask[on] = True
                columns[own] = pc.replace_with_mask(columns[own], pa.array(mask), pa.array(texts, columns[own].type))
                if counted:
                    columns[counted] = pc.replace_with_mask(columns[counted], pa.array(mask), pa.array([len(x) for x in texts], columns[counted].type))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names).filter(pa.array(left))

    return located(rows.select(*names)).mapInArrow(cut, rows.select(*names).schema).toDF(*df.columns)
