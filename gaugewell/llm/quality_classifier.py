"""A factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, shingles, words_of

WORD_BITS, BINS, FACTORS = 15, 16, 8
#: Byte classes: lower, upper, digit, space, full stop or comma, other mark, symbol, rest (of longer characters).
_CLASS = np.full(256, 7, np.uint8)
_CLASS[:128] = 5
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 0, 1, 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord("."), ord(",")]] = 4
_CLASS[[ord(c) for c in "#*$%&|<>@^~\\{}[]=_+"]] = 6
STATS = 16
#: Metadata columns at most; each has a bin for null and BINS of powers of two.
META = 4
SIZE = (1 << WORD_BITS) + STATS * BINS + META * (BINS + 1)


@lru_cache(maxsize=1)
def _cache() -> WordHashes:
    return WordHashes()


def features(text: bytes | None, meta: tuple[float | None, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): words with damped counts of unit length, and one bin for each statistic and each number of metadata. An empty text has the bins of zeros."""
    text = text or b""
    words = words_of(text)
    n = len(words)
    h = _cache().of(words)
    at, count = np.unique((h & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64), return_counts=True)
    value = 1 + np.log(count)
    value /= np.linalg.norm(value) or 1
    chars = max(len(text), 1)
    share = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8) / chars
    lines = text.count(b"\n") + 1
    windows = shingles(h, 3)
    ratios = [
        *np.sqrt(share),
        len(at) / max(n, 1),
        count.max(initial=0) / max(n, 1),
        (h[1:] == h[:-1]).mean() if n > 1 else 0,
        1 - len(np.unique(windows)) / max(len(windows), 1),
        min(np.log2(1 + n) / BINS, 1),
        min(chars / max(n, 1) / 32, 1),
        min(np.log2(1 + len(text)) / 24, 1),
        min(np.log2(1 + chars / lines) / BINS, 1),
    ]
    bins = np.minimum((np.array(ratios) * BINS).astype(np.int64), BINS - 1)
    stats = (1 << WORD_BITS) + np.arange(STATS) * BINS + bins
    known = [0 if m is None or m != m else 1 + min(int(np.log2(1 + max(0.0, m))), BINS - 1) for m in meta]
    facts = (1 << WORD_BITS) + STATS * BINS + np.arange(len(meta)) * (BINS + 1) + np.array(known, np.int64)
    return np.concatenate([at, stats, facts.astype(np.int64)]), np.concatenate([value, np.full(STATS + len(meta), 0.5)])


class Machine:
    """score = sigmoid(b + w.x + 1/2 sum_f((V_f.x)^2 - V_f^2.x^2)): all pairs in time linear in the features."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray) -> None:
        self.bias, self.w, self.v = bias, w, v

    def logit(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[at] * x[:, None]
        return self.bias + self.w[at] @ x + 0.5 * float((vx.sum(axis=0) ** 2).sum() - (vx**2).sum())

    def to_bytes(self) -> bytes:
        return np.concatenate([[self.bias], self.w, self.v.reshape(-1)]).astype("<f4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Machine:
        flat = np.frombuffer(data, "<f4").astype(np.float64)
        return cls(float(flat[0]), flat[1 : 1 + SIZE], flat[1 + SIZE :].reshape(SIZE, FACTORS))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad on mini-batches; the same rows in the same order give the same machine."""
    if not rows:
        return Machine(0.0, np.zeros(SIZE), np.zeros((SIZE, FACTORS)))
    rng = np.random.default_rng(seed)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, FACTORS)))
    gw, gv = np.full(SIZE, 1e-6), np.full((SIZE, FACTORS), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), batch):
            part = order[s : s + batch]
            at = np.concatenate([rows[i][0] for i in part])
            x = np.concatenate([rows[i][1] for i in part])
            first = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in part])[:-1]])
            own = np.repeat(np.arange(len(part)), np.diff([*first, len(at)]))
            vx = machine.v[at] * x[:, None]
            total = np.add.reduceat(vx, first)
            logit = machine.bias + np.add.reduceat(machine.w[at] * x, first) + 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), first))
            error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[part]
            ex = error[own] * x
            step_w = np.bincount(at, ex, SIZE) / len(part)
            pull = ex[:, None] * (total[own] - vx)
            step_v = np.stack([np.bincount(at, pull[:, f], SIZE) for f in range(FACTORS)], axis=1) / len(part)
            on = np.unique(at)
            step_w[on] += decay * machine.w[on]
            step_v[on] += decay * machine.v[on]
            gw[on] += step_w[on] ** 2
            gv[on] += step_v[on] ** 2
            machine.w[on] -= rate * step_w[on] / np.sqrt(gw[on])
            machine.v[on] -= rate * 0.3 * step_v[on] / np.sqrt(gv[on])
            machine.bias -= rate * error.mean()
    return machine


def _meta(b: pa.RecordBatch, n: int) -> list[tuple]:
    return list(zip(*(b.column(f"m{i}").to_pylist() for i in range(n)), strict=True)) if n else [()] * b.num_rows


def train(labelled: DataFrame, n_meta: int = 0, text: str = "text", label: str = "label") -> bytes:
    """Fit one machine on all rows of labelled, which must be a bounded sample in a fixed order (column at)."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t, m) for t, m in zip(b.column(text).cast(pa.binary()).to_pylist(), _meta(b, n_meta), strict=True)]
            lists = [pa.array([g[i] for g in got], pa.list_(kind)) for i, kind in ((0, pa.int32()), (1, pa.float32()))]
            yield pa.RecordBatch.from_arrays([b.column("at"), b.column(label), *lists], ["at", "y", "i", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y, order = [], [], []
        for b in batches:
            rows += [(i.values.to_numpy().astype(np.int64), x.values.to_numpy().astype(np.float64)) for i, x in zip(b.column("i"), b.column("x"), strict=True)]
            y += b.column("y").to_pylist()
            order += b.column("at").to_pylist()
        by = sorted(range(len(order)), key=lambda i: (order[i], y[i], len(rows[i][0])))
        machine = fit([rows[i] for i in by], np.array([y[i] for i in by], float))
        yield pa.RecordBatch.from_arrays([pa.array([machine.to_bytes()], pa.binary())], ["model"])

    found = labelled.mapInArrow(extract, "at long, y int, i array<int>, x array<float>").repartition(1)
    return bytes(found.mapInArrow(learn, "model binary").first()[0])


def score_quality(df: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality", folds: int = 3, held_out: int = 1, max_labelled: int = 12_000, metadata: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """Each row's probability of label 1 by a factorisation machine learnt from labelled rows outside the held-out fold.

    Returns one row per input row: id, held_out (crc32 of the id as text, modulo folds, is held_out), score
    (0 to 1), predicted (1 if score >= 0.5, else 0). At most max_labelled labelled rows, the
    first in a fixed pseudo-random order of ids, are learnt from; one task holds their features
    (about 3 kB each). Inputs are the text's hashed words, its structure statistics and lengths, and metadata:
    numeric columns of df, at most META, as powers of two (those that df lacks are left out; n_chars by default). Labels, language, source
    and id are never inputs.

    Null texts score as empty ones; very long texts are read whole. Null labels and labels without a text are not learnt from;
    without any label every score is one half. An id that labels repeats counts once for each
    row; of an id that documents repeat one row, the first by a hash of its text, is learnt from, so max_labelled bounds what is learnt from whatever repeats. A null id is not held out. Repeated rows score alike. Extra columns are ignored.
    Empty input gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "classifier")
    metadata = tuple(m for m in metadata if m in df.columns)
    if len(metadata) > META:
        raise ValueError(f"at most {META} metadata columns")
    facts = [F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(metadata)]
    picked = df.select(F.col(id).alias("x_id"), F.col(text).cast("string").alias("x_text"), *facts)
    fold = F.coalesce(F.crc32(F.col("x_id").cast("string").cast("binary")) % folds == held_out, F.lit(False))
    known = labels.select(F.col(id).alias("x_id"), F.col(label).cast("int").alias("label")).where("label is not null and x_id is not null").where(~fold)
    known = known.withColumn("at", F.xxhash64(F.lit(5), "x_id")).orderBy("at", "x_id", "label").limit(max_labelled)
    known = scratch.table(known, "labels")
    n_meta = len(metadata)
    facts = ["x_text", *(f"m{i}" for i in range(n_meta))]
    counted = known.groupBy("at", "x_id", "label").agg(F.count(F.lit(1)).cast("int").alias("times"))
    own = picked.where("x_text is not null").join(F.broadcast(counted), "x_id").groupBy("at", "x_id", "label", "times").agg(F.min_by(F.struct(*facts), F.xxhash64(*facts)).alias("own"))
    learnt = own.select("at", "label", F.explode(F.array_repeat("own", F.col("times"))).alias("own")).select("at", F.col("own.x_text").alias("text"), "label", *(f"own.m{i}" for i in range(n_meta)))
    model = train(learnt, n_meta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine.from_bytes(model)
        for b in batches:
            rows = zip(b.column("x_text").cast(pa.binary()).to_pylist(), _meta(b, n_meta), strict=True)
            logits = np.array([machine.logit(*features(t, m)) for t, m in rows], float)
            yield pa.RecordBatch.from_arrays([b.column("x_id"), b.column("held_out"), pa.array(1 / (1 + np.exp(-np.clip(logits, -500, 500))))], ["x_id", "held_out", "score"])

    id_type = picked.schema["x_id"].dataType.simpleString()
    scored = picked.withColumn("held_out", fold).mapInArrow(run, f"x_id {id_type}, held_out boolean, score double")
    return scored.select(F.col("x_id").alias(id), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
