"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fingerprint
from .graph import connected_components, union_find

#: Members of a component that one task compares with as many others.
BLOCK = 1024
#: Passes at least, and the chance at most that no pass brings a pair of vectors at the threshold near.
PASSES, MISS = 16, 1e-4


def passes_for(n: int, least: float, window: int, miss: float = MISS) -> int:
    """Passes over n vectors so that a pair at cosine least comes within window ranks in one of them, but for a chance of miss.

    Two codes agree in a bit with chance a = 1 - acos(least) / pi, and in the log2(n / window) bits
    after which codes spread evenly leave window vectors with that power of a. Up to 6 % less was
    measured in simulations, so 0.85 of it is counted on.
    """
    agree = 1 - math.acos(min(1.0, max(-1.0, least))) / math.pi
    near = 0.85 * agree ** math.log2(max(2.0, n / window))
    return PASSES if near <= 0 else max(PASSES, math.ceil(math.log(miss) / math.log1p(-near)))


def _planes(dim: int, passes: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, passes * bits))


def _rows(column: pa.Array) -> list[np.ndarray | None]:
    """A list column as float64 vectors; None for a null or one with null components."""
    flat, at = column.values, column.offsets.to_numpy()
    data = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    missing = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))]) if flat.null_count else np.zeros(len(flat) + 1, np.int64)
    whole = column.is_valid().to_numpy(zero_copy_only=False) & (missing[at[1:]] == missing[at[:-1]])
    return [data[x:y] if ok else None for x, y, ok in zip(at[:-1].tolist(), at[1:].tolist(), whole.tolist(), strict=True)]


def _coded(passes: int, bits: int, seed: int):
    """(id, node, dim, codes): node is null where a vector links with nothing; a code's bits are the signs of its projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weigh = (np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)).astype(np.uint64)
        for b in batches:
            vectors = _rows(b.column("embedding"))
            node: list[int | None] = [None] * len(vectors)
            codes: list[np.ndarray | None] = [None] * len(vectors)
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                if v is not None and len(v) and np.isfinite(v).all() and v.any():
                    node[i] = fingerprint(v + 0.0)
                    vectors[i] = _scaled(v)
                    by_dim.setdefault(len(v), []).append(i)
            for dim, at in by_dim.items():
                if dim not in planes:
                    planes[dim] = _planes(dim, passes, bits, seed)
                signs = (np.stack([vectors[i] for i in at]) @ planes[dim] > 0).reshape(len(at), passes, bits)
                packed = (signs * weigh).sum(axis=2, dtype=np.uint64) ^ np.uint64(1 << 63)  # signed order is then the order of the bits
                for i, c in zip(at, packed.view(np.int64), strict=True):
                    codes[i] = c
            # codes are of the vectors scaled to a largest component of 1
            dims = [None if n is None else len(v) for n, v in zip(node, vectors, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("embedding"), pa.array(node, pa.int64()), pa.array(dims, pa.int32()), pa.array(codes, pa.list_(pa.int64()))], ["id", "embedding", "node", "dim", "codes"])

    return run


def _scaled(v: np.ndarray) -> np.ndarray:
    """A vector over its largest component, so that no square overflows or vanishes."""
    return v / np.abs(v).max(axis=-1, keepdims=True)


def _unit(vectors: list[np.ndarray]) -> np.ndarray:
    x = _scaled(np.stack(vectors))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _near(nodes: np.ndarray, rank: np.ndarray, x: np.ndarray, window: int, least: float, border: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between rows of ranks at most window apart, or of those only that a border lies between."""
    a, b = [], []
    for s in range(0, len(x), 256):
        part, ahead = x[s : s + 256], x[s : s + 256 + window]
        i, j = np.nonzero(part @ ahead.T >= least)
        apart = rank[s + j] - rank[s + i]
        ok = (apart > 0) & (apart <= window)
        if border is not None:
            ok &= (rank[s + i] < border) & (rank[s + j] >= border)
        a.append(nodes[s + i[ok]])
        b.append(nodes[s + j[ok]])
    return union_find(np.concatenate(a), np.concatenate(b))


_FOUND = "node long, label long, part int, at long, pass int, dim int, embedding array<double>"


def _neighbours(window: int, least: float):
    """Sorted rows of passes to a forest of the verified links between rows at most window apart.

    Beside the links (node, label), a partition gives its first and last window rows with their places (part, at), and
    its number of rows as a row without a node, for what lies across its borders.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("label", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("pass", pa.int32()), ("dim", pa.int32()), ("embedding", pa.list_(pa.float64()))])
        part, seen = None, 0
        key, nodes, vectors = None, [], []
        tail: deque[tuple] = deque(maxlen=window)

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(schema.types)], schema=schema)

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                n, root = _near(np.array(nodes, np.int64), np.arange(len(nodes)), _unit(vectors), window, least)
                moved = n != root
                if moved.any():
                    none = [pa.nulls(int(moved.sum()), t) for t in schema.types[2:]]
                    yield pa.RecordBatch.from_arrays([pa.array(n[moved]), pa.array(root[moved]), *none], schema=schema)
            keep = 0 if last else window
            del nodes[: len(nodes) - keep], vectors[: len(vectors) - keep]

        for b in batches:
            head = []
            for k, n, v, p in zip(zip(b.column("pass").to_pylist(), b.column("dim").to_pylist(), strict=True), b.column("node").to_pylist(), _rows(b.column("embedding")), b.column("part").to_pylist(), strict=True):
                part = p
                if k != key:
                    yield from out(True)
                    key = k
                elif len(nodes) >= 4096 + window:
                    yield from out(False)
                nodes.append(n)
                vectors.append(v)
                row = (n, None, p, seen, *k, v)
                if seen < window:
                    head.append(row)
                else:
                    tail.append(row)
                seen += 1
            if head:
                yield rows(head)
        yield from out(True)
        if part is not None:
            yield rows([*tail, (None, None, part, seen, None, None, None)])

    return run


def _across(window: int, least: float, first: dict[int, int]):
    """Rows of one border after another, sorted by border and rank, to the links across it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        border, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            groups: dict[tuple, list[tuple]] = {}
            for rank, k, n, v in held:
                groups.setdefault(k, []).append((rank, n, v))
            for rows in groups.values():
                if len(rows) > 1:
                    rank, n, v = zip(*rows, strict=True)
                    n, root = _near(np.array(n, np.int64), np.array(rank), _unit(list(v)), window, least, first[border])
                    yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(root)], ["node", "label"])
            held.clear()

        for b in batches:
            keys = zip(b.column("pass").to_pylist(), b.column("dim").to_pylist(), strict=True)
            for at, rank, k, n, v in zip(b.column("border").to_pylist(), b.column("rank").to_pylist(), keys, b.column("node").to_pylist(), _rows(b.column("embedding")), strict=True):
                if at != border:
                    yield from out()
                    border = at
                held.append((rank, k, n, v))
        yield from out()

    return run


def _links(spread: DataFrame, scratch: Scratch, window: int, least: float) -> DataFrame:
    """Sorted, partitioned rows to (node, label), the links of all rows at most window apart in the order, whatever the partitions."""
    found = scratch.table(spread.withColumn("part", F.spark_partition_id()).mapInArrow(_neighbours(window, least), _FOUND), "found")
    forest = found.where("label is not null").select("node", "label")
    # a number per partition: which ranks it begins with
    sizes = sorted((r["part"], r["at"]) for r in found.where("node is null").select("part", "at").collect())
    first = dict(zip((p for p, _ in sizes), np.cumsum([0, *(n for _, n in sizes)]).tolist(), strict=False))
    if len(first) < 2:
        return forest
    starts = np.array(list(first.values()))
    parts = list(first)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row once for each border that lies at most window ranks from it."""
        begin = np.array([first.get(p, 0) for p in range(max(parts) + 1)])
        for b in batches:
            rank = begin[b.column("part").to_numpy()] + b.column("at").to_numpy()
            low, high = np.searchsorted(starts, rank - window, side="right"), np.searchsorted(starts, rank + window, side="right")
            at, border = [], []
            for i, (lo, hi) in enumerate(zip(low, high, strict=True)):
                for k in range(max(lo, 1), hi):  # borders rank - window < start <= rank + window
                    at.append(i)
                    border.append(parts[k])
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(border, pa.int32()), pa.array(rank[np.array(at, np.int64)]), *(b.column(c).take(rows) for c in ("node", "pass", "dim", "embedding"))], ["border", "rank", "node", "pass", "dim", "embedding"])

    rows = found.where("node is not null and label is null").select("part", "at", "node", "pass", "dim", "embedding")
    rows = rows.mapInArrow(dealt, "border int, rank long, node long, pass int, dim int, embedding array<double>")
    rows = rows.repartition("border").sortWithinPartitions("border", "rank")
    return forest.unionByName(rows.mapInArrow(_across(window, least, first), "node long, label long"))


def _degrees(least: float):
    """Groups of one or two blocks of a component, sorted by group, to each member's number of links."""

    def count(p: int, q: int, nodes: list, side: list, weights: list, vectors: list) -> pa.RecordBatch:
        x, w, s = _unit(vectors), np.array(weights, np.int64), np.array(side)
        n = np.zeros(len(x), np.int64)
        for at in range(0, len(x), 1024):
            linked = x[at : at + 1024] @ x.T >= least
            part = np.arange(at, at + len(linked))
            linked[part - at, part] = False
            if p != q:
                linked &= s[part][:, None] != s[None, :]
            n[at : at + 1024] = linked @ w
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(n)], ["node", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [], [])
        for b in batches:
            names = ("label", "p", "q", "node", "block", "copies")
            for (*k, node, block, copies), v in zip(zip(*(b.column(c).to_pylist() for c in names), strict=True), _rows(b.column("embedding")), strict=True):
                if k != key:
                    if key:
                        yield count(*key[1:], *held)
                    key, held = k, ([], [], [], [])
                for column, value in zip(held, (node, block, copies, v), strict=True):
                    column.append(value)
        if key:
            yield count(*key[1:], *held)

    return run


def near_vectors(df: DataFrame, embedding: str = "embedding", id: str = "vec_id", least: float = 0.9, passes: int | None = None, window: int = 64, bits: int = 64, seed: int = 8, partitions: int | None = None) -> DataFrame:
    """Group rows whose vectors have a cosine of least or more, in double precision.

    Returns one row per input row: id, n_links (other rows linked directly), component_id (smallest
    id reachable over links, its own included), kept (id = component_id).

    Equal vectors are one node with a weight. Each pass orders the nodes by a code of random
    projection signs, most significant first, and compares each with the next window ones;
    verified links are united across passes. Within each component every pair of nodes is
    then compared, in blocks of BLOCK, so n_links is exact for all links that do not cross
    components, whatever a window left out. What a code's order can miss is a link that no
    pass brings near. Rows near the borders of partitions are compared across them, so the result does not depend on
    the number of partitions.
    Unless passes are given, passes_for takes as many as the rows need for a miss of MISS.

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing and stand for themselves; the size of components does not matter, as vectors are scaled first. Vectors of different lengths link with nothing of
    another length. Repeated rows are copies of each other; null ids belong to a component only
    through the non-null ids in it. Extra columns are ignored. Empty input gives an
    empty result.
    """
    scratch = Scratch(df.sparkSession, "vectors")
    picked = df.select(F.col(id).alias("id"), F.col(embedding).cast("array<double>").alias("embedding"))
    passes = passes or passes_for(picked.count(), least, window)
    id_type = picked.schema["id"].dataType.simpleString()
    coded = picked.mapInArrow(_coded(passes, bits, seed), f"id {id_type}, embedding array<double>, node long, dim int, codes array<long>")
    coded = scratch.table(coded, "codes")
    nodes = coded.where("node is not null").groupBy("node").agg(F.min("id").alias("min_id"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("embedding").alias("embedding"), F.first("codes").alias("codes"))
    nodes = scratch.table(nodes, "nodes")
    spread = nodes.select("node", "dim", "embedding", F.posexplode("codes").alias("pass", "code"))
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("pass", "dim", "code", "node")
    spread = spread.repartitionByRange(n, *order).sortWithinPartitions(*order)
    forest = scratch.table(_links(spread, scratch, window, least).where("node != label").distinct(), "links")
    labels = scratch.table(connected_components(forest, scratch), "labels")

    members = labels.join(nodes.select("node", "copies", "min_id", "embedding"), "node")
    sizes = labels.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", F.least("block", "o").alias("p"), F.greatest("block", "o").alias("q"), "node", "block", "copies", "embedding")
    dealt = dealt.repartition("label", "p", "q").sortWithinPartitions("label", "p", "q")
    degrees = dealt.mapInArrow(_degrees(least), "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    smallest = members.groupBy("label").agg(F.min("min_id").alias("low"))
    grouped = labels.join(smallest, "label").join(degrees, "node").select("node", "low", "n")
    facts = nodes.select("node", "min_id", "copies").join(grouped, "node", "left")
    facts = facts.select("node", F.coalesce("low", "min_id").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = coded.select("id", "node").join(facts, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return scratch.finish(out.withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True))))
