"""Vector code compression: codebooks for the parts of vectors, searched by kd-trees that are broadcast each round."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, prepare
from .embedding_dedup import _rows

#: Integer components stay within this, so that squared distances of up to 16,384 components are exact in 64 bits.
LIMIT = 1 << 23
#: Vectors that a worker searches for at once, and entries in a leaf.
SEARCH_ROWS, LEAF = 8192, 4
#: A label with at least one row in so many is met by a broadcast: there are no more such labels than that.
HEAVY = 1000


class KdTree:
    """Nearest entries of one codebook by branch and bound over the boxes of its entries; all in whole numbers."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.lo: list[np.ndarray] = []
        self.hi: list[np.ndarray] = []
        self.inner: list[tuple[int, int, int, int] | None] = []
        self.leaf: list[np.ndarray | None] = []
        self._build(np.arange(len(entries)))

    def _build(self, at: np.ndarray) -> int:
        own, node = self.entries[at], len(self.lo)
        self.lo.append(own.min(axis=0))
        self.hi.append(own.max(axis=0))
        self.inner.append(None)
        self.leaf.append(None)
        if len(at) <= LEAF:
            self.leaf[node] = at
            return node
        axis = int(np.argmax(self.hi[node] - self.lo[node]))
        at = at[np.argsort(own[:, axis], kind="stable")]
        half = len(at) // 2
        cut = int(self.entries[at[half], axis])
        left = self._build(at[:half])
        self.inner[node] = (axis, cut, left, self._build(at[half:]))
        return node

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) for each row of x; of equally near entries the lowest index.

        Every row first goes down to the leaf on its side of each cut, then through the tree once more into each box
        that is no farther than what it has found. A box just as far is entered too: it may hold an equal entry with a lower index.
        """
        best = np.full(len(x), np.iinfo(np.int64).max)
        found = np.full(len(x), len(self.entries))

        def look(node: int, rows: np.ndarray) -> None:
            at = np.sort(self.leaf[node])
            d = ((x[rows, None, :] - self.entries[at][None]) ** 2).sum(axis=2)
            k = d.argmin(axis=1)  # the first of equals, so the lowest index
            d, i = d[np.arange(len(rows)), k], at[k]
            better = (d < best[rows]) | (d == best[rows]) & (i < found[rows])
            best[rows[better]], found[rows[better]] = d[better], i[better]

        def descend(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if self.inner[node] is None:
                return look(node, rows)
            axis, cut, left, right = self.inner[node]
            low = x[rows, axis] < cut
            descend(left, rows[low])
            descend(right, rows[~low])

        def sweep(node: int, rows: np.ndarray) -> None:
            out = np.maximum(self.lo[node] - x[rows], 0) + np.maximum(x[rows] - self.hi[node], 0)
            rows = rows[(out**2).sum(axis=1) <= best[rows]]
            if not len(rows):
                return
            if self.inner[node] is None:
                return look(node, rows)
            sweep(self.inner[node][2], rows)
            sweep(self.inner[node][3], rows)

        every = np.arange(len(x))
        if len(x):
            descend(0, every)
            sweep(0, every)
        return found, best


@dataclass(frozen=True)
class Codebooks:
    """parts x entries x width integers; scale turns components into integers."""

    entries: np.ndarray
    scale: int

    @property
    def parts(self) -> int:
        return self.entries.shape[0]

    @property
    def dim(self) -> int:
        return self.parts * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _whole(vectors: list[np.ndarray | None], dim: int, scale: int) -> tuple[list[int], np.ndarray]:
    """The places of vectors that are kept, and their integer components."""
    at = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim and np.isfinite(v).all()]
    if not at:
        return at, np.empty((0, dim), np.int64)
    with np.errstate(over="ignore"):  # beyond the largest double is beyond LIMIT too
        scaled = np.floor(np.stack([vectors[i] for i in at]) * scale)
    return at, np.clip(scaled, -LIMIT, LIMIT).astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows that are kept, without their vectors, and their integer components; SEARCH_ROWS or more at once."""
    held: list[pa.RecordBatch] = []
    whole: list[np.ndarray] = []

    def out() -> tuple[pa.RecordBatch, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()
        got = table[0], np.concatenate(whole)
        held.clear()
        whole.clear()
        return got

    for b in batches:
        at, x = _whole(_rows(b.column("x_vec")), dim, scale)
        if at:
            held.append(b.select([c for c in b.schema.names if c != "x_vec"]).take(pa.array(at, pa.int64())))
            whole.append(x)
        if sum(map(len, whole)) >= SEARCH_ROWS:
            yield out()
    if held:
        yield out()


def _split(x: np.ndarray, parts: int) -> np.ndarray:
    """Parts first: parts x rows x width."""
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).swapaxes(0, 1))


def _first(rows: DataFrame, parts: int, entries: int, scale: int) -> Codebooks:
    """Codebooks of the parts of the entries smallest ids; at most that many rows come to the driver."""
    finite = F.forall("x_vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = rows.where(F.col("x_vec").isNotNull() & (F.size("x_vec") > 0) & finite).orderBy(F.col("x_id").asc_nulls_last(), "x_vec").limit(entries).collect()
    if not kept:
        return Codebooks(np.empty((parts, 0, 1), np.int64), scale)
    dim = len(kept[0]["x_vec"])
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    _, x = _whole([np.array(r["x_vec"], np.float64) for r in kept], dim, scale)
    return Codebooks(_split(x, parts), scale)


def _picked(df: DataFrame, vec: str, id: str, label: str | None) -> DataFrame:
    label_column = F.lit(None).cast("int") if label is None else F.col(label)
    return df.select(F.col(id).alias("x_id"), label_column.alias("x_label"), F.col(vec).cast("array<double>").alias("x_vec"))


def fit_codebooks(df: DataFrame, vec: str = "embedding", id: str = "vec_id", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks:
    """Codebooks after some rounds over all vectors: each part goes to its nearest entry, each entry becomes the floored mean of its parts.

    Tasks send a sum and a count for each entry, in whole numbers, so the result doesn't depend on how rows are dealt out.
    """
    spark = df.sparkSession
    prepare(spark)
    rows = _picked(df, vec, id, None)
    books = _first(rows, parts, entries, scale)
    if not books.entries.size:
        return books
    width = books.entries.shape[2]
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([KdTree(e) for e in books.entries])

        def run(batches: Iterator[pa.RecordBatch], trees=trees, dim=books.dim, k=books.entries.shape[1]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((parts, k, width), np.int64)
            count = np.zeros((parts, k), np.int64)
            for _, x in _gathered(batches, dim, scale):
                for p, (tree, own) in enumerate(zip(trees.value, _split(x, parts), strict=True)):
                    found, _ = tree.nearest(own)
                    count[p] += np.bincount(found, minlength=k)
                    for c in range(width):  # sums of one batch are below 2**53
                        total[p, :, c] += np.bincount(found, own[:, c], minlength=k).astype(np.int64)
            part, entry = np.nonzero(count)
            sums = pa.array(list(total[part, entry]), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry], pa.int64()), sums], ["part", "entry", "n", "sums"])

        got = rows.select("x_vec").mapInArrow(run, "part int, entry int, n long, sums array<long>")
        exact = [F.sum(F.col("sums")[c].cast("decimal(38,0)")).alias(f"s{c}") for c in range(width)]
        fresh = books.entries.copy()
        for r in got.groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact).collect():  # a row for each entry at most
            fresh[r["part"], r["entry"]] = [int(r[f"s{c}"]) // r["n"] for c in range(width)]
        trees.unpersist()
        books = Codebooks(fresh, scale)
    return books


def encode_vectors(df: DataFrame, books: Codebooks, vec: str = "embedding", id: str = "vec_id", label: str = "label") -> DataFrame:
    """x_id, x_label, code (an index per part, two hex digits each) and error (squared distances, summed) of each vector that is kept."""
    prepare(df.sparkSession)
    rows = _picked(df, vec, id, label)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"x_id {kinds['x_id']}, x_label {kinds['x_label']}, code string, error long"
    if not books.entries.size:
        return rows.where("false").select("x_id", "x_label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    if books.entries.shape[1] > 256:
        raise ValueError("two hex digits hold the index of 256 entries")
    trees = df.sparkSession.sparkContext.broadcast([KdTree(e) for e in books.entries])

    def run(batches: Iterator[pa.RecordBatch], dim=books.dim, scale=books.scale, parts=books.parts) -> Iterator[pa.RecordBatch]:
        for b, x in _gathered(batches, dim, scale):
            got = [tree.nearest(own) for tree, own in zip(trees.value, _split(x, parts), strict=True)]
            code = np.stack([f for f, _ in got], axis=1).astype(np.uint8)
            error = np.sum([d for _, d in got], axis=0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes().hex() for c in code]), pa.array(error, pa.int64())], ["x_id", "x_label", "code", "error"])

    return rows.mapInArrow(run, schema)


def decode(code: str, books: Codebooks) -> list[float]:
    """The vector that a code stands for: the entries of its parts over the scale."""
    return [v / books.scale for p, i in enumerate(bytes.fromhex(code)) for v in books.entries[p, i].tolist()]


def compress_vectors(df: DataFrame, vec: str = "embedding", id: str = "vec_id", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, books: Codebooks | None = None) -> DataFrame:
    """One row per vector that is kept: its id, code, error, label_error and codebooks_sha256.

    Components become floor(scale * x); parts are searched by squared Euclidean distance, ties to the lower
    index. label_error sums error over equal labels, nulls together. books, from fit_codebooks, may come from other vectors.

    Null vectors and those with null or non-finite components are left out, as are empty ones and those of another
    dimension than the codebooks', which is that of the smallest kept id; a dimension that isn't a multiple of parts is an error.
    Components beyond 2**23 / scale count as that. With fewer kept vectors than entries, codebooks are shorter. Rows that repeat an id are vectors
    of their own, ordered by their components for the first codebooks; null ids come last. Extra columns are ignored. Empty input gives an empty result.
    """
    books = books or fit_codebooks(df, vec, id, parts, entries, rounds, scale)
    scratch = Scratch(df.sparkSession, "codes")
    coded = scratch.table(encode_vectors(df, books, vec, id, label), "coded")
    sums = coded.groupBy(F.col("x_label").alias("x_of")).agg(F.sum("error").alias("label_error"), F.count("*").alias("x_n"))
    sums = scratch.table(sums, "labels")
    total = sums.agg(F.sum("x_n")).first()[0] or 0
    same = F.col("x_label").eqNullSafe(F.col("x_of"))
    often = F.broadcast(sums.where(F.col("x_n") * HEAVY >= total))  # HEAVY rows at most
    seldom = sums.where(F.col("x_n") * HEAVY < total)
    out = coded.join(often, same).unionByName(coded.join(often, same, "left_anti").join(seldom, same))
    return out.select(F.col("x_id").alias(id), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
