"""MinHash near-duplicate detection with SuperMinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILE, ROW, Scratch, WordHashes, fingerprint, located, mix, noted, shingles, signed, without_noted, words_of
from .graph import connected_components

#: Members of a block of a band that is too large for one group.
BLOCK = 512
#: Elements whose permutation state (bands * rows bytes each) is held at once.
STATE_ELEMENTS = 40_000


def superminhash(elements: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures (float64, one row per set; inf where a set is empty), m <= 255.

    Every element draws, from its own hash, one uniform fraction and one step of a
    Fisher-Yates shuffle per round j; the fraction plus j competes for the place
    that the shuffle deals in that round. A set stops as soon as all its places hold
    values that no later round can undercut, which long sets reach after one or two.
    """
    sig = np.full((len(elements), m), np.inf)
    steps = np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    flat, doc = [], []
    size = 0

    def run() -> None:
        e, d = np.concatenate(flat), np.concatenate(doc)
        state = np.tile(np.arange(m, dtype=np.uint8), (len(e), 1))
        at = np.arange(len(e))
        view = sig.reshape(-1)
        for j in range(m):
            x = mix(e[at] + steps[j])
            fraction = (x >> np.uint64(32)).astype(np.float64) * 2.0**-32
            k = j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
            place = state[at, k]
            state[at, k] = state[at, j]
            np.minimum.at(view, d[at] * m + place, fraction + j)
            at = at[(sig.max(axis=1) > j + 1)[d[at]]]
            if not len(at):
                break
        flat.clear()
        doc.clear()

    for i, e in enumerate(elements):
        for s in range(0, len(e), STATE_ELEMENTS):  # a very long set in parts: its places only fall
            part = e[s : s + STATE_ELEMENTS]
            if size + len(part) > STATE_ELEMENTS and flat:
                run()
                size = 0
            flat.append(part)
            doc.append(np.full(len(part), i))
            size += len(part)
    if flat:
        run()
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of a signature."""
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands))
    for r in range(rows):
        out = mix(out ^ bits[:, :, r])
    return out


def _signed_rows(k: int, bands: int, rows: int):
    """Rows with x_text to the same with set size, node and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            sets = [np.unique(shingles(cache.of(words_of(t)), k)) for t in b.column("x_text").cast(pa.binary()).to_pylist()]
            keys = signed(band_keys(superminhash(sets, bands * rows), bands, rows))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
            node = pa.array([fingerprint(s) for s in sets], pa.int64())
            added = [pa.array([len(s) for s in sets], pa.int64()), node, lists]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], [*b.schema.names, "n_shingles", "node", "bands"])

    return run


def _wanted_texts(folder: str):
    """Texts of the noted rows, with their nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, on, notes in noted(batches, folder):
            if len(on):
                yield pa.RecordBatch.from_arrays([notes.column("node").combine_chunks(), part.column("x_text").take(pa.array(on))], ["node", "text"])

    return run


def _verify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        last, held = None, None
        for b in batches:
            a, c = b.column("a").to_numpy(), b.column("b").to_numpy()
            left, right = (b.column(x).cast(pa.binary()) for x in ("text_a", "text_b"))
            keep = np.zeros(len(a), bool)
            for i in range(len(a)):
                if a[i] != last:
                    last, held = a[i], np.unique(shingles(cache.of(words_of(left[i].as_py())), k))
                other = np.unique(shingles(cache.of(words_of(right[i].as_py())), k))
                if 100 * min(len(held), len(other)) < percent * max(len(held), len(other)):
                    continue
                both = len(held) + len(other) - len(np.unique(np.concatenate([held, other])))
                keep[i] = 100 * both >= percent * (len(held) + len(other) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(c[keep])], ["a", "b"])

    return run


def _finish_band(k: int, percent: int):
    """Groups of members that share a band, sorted by group, to links that join different components.

    A group's sets go into one inverted index; every member outside the largest component
    gets its exact intersections with all others from it. No pair is emitted but a link
    that joins two components.
    """

    def links(nodes: list[int], comps: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        n = len(nodes)
        size = np.array([len(s) for s in sets])
        token = np.unique(np.concatenate(sets), return_inverse=True)[1]
        owner = np.repeat(np.arange(n), size)
        order = np.argsort(token, kind="stable")
        posting, start = owner[order], np.concatenate([[0], np.cumsum(np.bincount(token))])
        first = np.concatenate([[0], np.cumsum(size)])
        comp = np.unique(np.array(comps), return_inverse=True)[1]
        found = []
        for x in np.flatnonzero(comp != np.bincount(comp).argmax()):
            t = token[first[x] : first[x + 1]]
            lens = start[t + 1] - start[t]
            at = np.repeat(start[t] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
            both = np.bincount(posting[at], minlength=n)
            for y in np.flatnonzero((100 * both >= percent * (size[x] + size - both)) & (comp != comp[x])):
                if comp[y] != comp[x]:
                    found.append((nodes[x], nodes[y]))
                    comp[comp == comp[y]] = comp[x]
            if not (comp != comp[0]).any():
                break
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        group, held, found = None, ([], [], []), []

        def out() -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])
                found.clear()

        for b in batches:
            texts = b.column("text").cast(pa.binary())
            for i, (*g, node, comp) in enumerate(zip(*(b.column(c).to_pylist() for c in ("key", "p", "q", "node", "l")), strict=True)):
                if g != group:
                    if len(held[0]) > 1:
                        found += links(*held)
                    group, held = g, ([], [], [])
                for column, value in zip(held, (node, comp, np.unique(shingles(cache.of(words_of(texts[i].as_py())), k))), strict=True):
                    column.append(value)
            yield from out()
        if len(held[0]) > 1:
            found += links(*held)
        yield from out()

    return run


def _grouped(rows: DataFrame, scratch: Scratch, k: int, percent: int, bands: int, one_task: int) -> DataFrame:
    """Signed rows, written, to (node, low): low is the first row of the node's component, as (without id, id, FILE, ROW)."""
    first = F.min(F.struct(F.col("x_id").isNull().alias("no_id"), F.col("x_id").alias("id"), FILE, ROW))
    nodes = located(rows).where("n_shingles > 0").groupBy("node").agg(first.alias("low"), F.first("bands").alias("bands"))
    nodes = scratch.table(nodes, "nodes")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    live = scratch.table(keyed.join(shared, "key"), "bands")
    wanted = nodes.join(live.select("node").distinct(), "node").select(F.col(f"low.{FILE}"), F.col(f"low.{ROW}"), "node")
    folder = scratch.notes(wanted, "wanted")
    texts = located(rows).select("x_text", FILE, ROW).mapInArrow(_wanted_texts(folder), "node long, text string")
    texts = scratch.table(texts, "texts")
    centre = live.groupBy("key").agg(F.min("node").alias("c"))
    pairs = live.join(centre, "key").where("node != c").select(F.col("c").alias("a"), F.col("node").alias("b")).distinct()
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    links = scratch.table(both.mapInArrow(_verify(k, percent), "a long, b long"), "links")
    labels = scratch.table(connected_components(links, scratch, one_task), "labels")

    left = live.join(centre.select("key", F.col("c").alias("node")), ["key", "node"], "left_anti")
    marked = left.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("l"))
    mixed = marked.groupBy("key").agg(F.min("l").alias("x"), F.max("l").alias("y"), F.count(F.lit(1)).alias("n")).where("x != y")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    split = marked.join(mixed.select("key", blocks.alias("blocks")), "key").withColumn("p", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("p")))
    split = split.withColumn("o", F.explode(others)).select("key", F.least("p", "o").alias("p"), F.greatest("p", "o").alias("q"), "node", "l")
    last = split.join(texts, "node").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    more = scratch.table(last.mapInArrow(_finish_band(k, percent), "a long, b long"), "links")
    labels = scratch.table(connected_components(links.unionByName(more), scratch, one_task), "labels")
    grouped = nodes.join(labels, "node", "left").select("node", "low", F.coalesce("label", "node").alias("label"))
    smallest = grouped.groupBy("label").agg(F.min("low").alias("low"))
    return grouped.drop("low").join(smallest, "label").select("node", "low")


def near_duplicates(df: DataFrame, text: str = "text", id: str = "doc_id", k: int = 5, percent: int = 80, bands: int = 28, rows: int = 6, one_task: int = 1_000_000) -> DataFrame:
    """Group rows whose sets of distinct k-word shingles have a Jaccard similarity of percent/100 or more.

    Returns one row per input row: id, n_shingles (set size), component_id (smallest id
    reachable over links, its own included), kept (id = component_id).

    Rows are written once with their signatures. Rows whose sets have the same 64-bit fingerprint are one node from
    the start, whatever their number; sets and intersections are of 64-bit hashes of shingles. In
    each band a node is first compared with the band's smallest node, on full sets; that costs in proportion
    to the group and joins most near copies. Bands in which more than one component is
    left are finished in groups of at most about 2 * BLOCK members (a larger band as
    pairs of blocks), each from one inverted index, so every candidate is settled and
    no pairs but links are emitted. A pair at the threshold is missed with probability
    (1 - (percent/100)^rows)^bands: 2e-4 at 80 by default, 3e-5 at 85 with 27 bands of 7.

    Null and word-less texts have no shingles and link with nothing; a text of fewer than
    k words is one shingle; very long texts are read whole, their signatures in parts. Repeated
    rows and repeated ids are rows of their own; rows
    of equal sets share a component. A null id belongs to a component only through
    the non-null ids in it. Columns beside id and text are ignored. Empty input gives
    an empty result.
    """
    scratch = Scratch(df.sparkSession, "near")
    base = df.select(F.col(id).alias("x_id"), F.col(text).cast("string").alias("x_text"))
    signed_ = scratch.table(_signed(base, k, bands, rows), "rows")
    member = _grouped(signed_, scratch, k, percent, bands, one_task).select("node", F.col("low.id").alias("component_id"))
    out = signed_.select("x_id", "n_shingles", "node").join(member, "node", "left")
    out = out.select(F.col("x_id").alias(id), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("x_id")).alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))
    return scratch.finish(out)


def _signed(base: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    from pyspark.sql import types as T

    added = [("n_shingles", T.LongType()), ("node", T.LongType()), ("bands", T.ArrayType(T.LongType()))]
    return base.mapInArrow(_signed_rows(k, bands, rows), T.StructType([*base.schema.fields, *(T.StructField(n, t) for n, t in added)]))


def drop_near_duplicates(df: DataFrame, text: str = "text", id: str = "doc_id", k: int = 5, percent: int = 80, bands: int = 28, rows: int = 6, one_task: int = 1_000_000) -> DataFrame:
    """df's rows without near copies, in df's columns: of each group as near_duplicates forms it, one row of the smallest id stays.

    All columns are written once beside the signatures; what goes is noted by the rows' places, so
    texts are not shuffled to learn it. Of rows that repeat an id in one group one stays; rows
    without an id stay only where their group has no id. Rows without words stay.
    """
    scratch = Scratch(df.sparkSession, "near")
    names = [f"x_{i}" for i in range(len(df.columns))]
    wide = df.toDF(*names)
    wide = wide.select("*", F.col(names[df.columns.index(id)]).alias("x_id"), F.col(names[df.columns.index(text)]).cast("string").alias("x_text"))
    signed_ = scratch.table(_signed(wide, k, bands, rows), "rows")
    member = _grouped(signed_, scratch, k, percent, bands, one_task)
    own = located(signed_).where("n_shingles > 0").select(FILE, ROW, "node")
    gone = own.join(member.select("node", F.col(f"low.{FILE}").alias("f"), F.col(f"low.{ROW}").alias("r")), "node")
    folder = scratch.notes(gone.where((F.col(FILE) != F.col("f")) | (F.col(ROW) != F.col("r"))).select(FILE, ROW), "gone")
    return without_noted(signed_.select(*names), folder).toDF(*df.columns)
