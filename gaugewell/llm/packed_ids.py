"""Token ids in files of fixed-width bits, with block offsets for vectorised reading and random access.

A file: blocks of BLOCK_IDS ids, each id in the fewest bits that hold the vocabulary, little-endian
bits, each block padded to whole bytes; then the offset of every block and the file's end
(unsigned 64-bit), the doc ids (signed 64-bit), the first id of every document and the number of
ids (unsigned 64-bit), a byte per document that is 1 where its doc id is null; then a footer of seven
unsigned 64-bit numbers: magic, version, bits, ids a block, blocks, documents, ids.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, filesystem
from .tokens import binary_column

MAGIC, VERSION, BLOCK_IDS = 0x4B434150444957, 1, 1 << 16
#: Ranges of ids at most; each holds one file or more.
MAX_RANGES = 10_000


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids[:, None] >> np.arange(bits, dtype=np.uint32) & 1).astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return flat.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class Writer:
    """One file, in one pass; documents come in order and one block is held."""

    def __init__(self, sink: io.RawIOBase, bits: int) -> None:
        self.sink, self.bits = sink, bits
        self.held: list[np.ndarray] = []
        self.waiting = self.n_ids = self.at = 0
        self.offsets, self.docs, self.null, self.starts = [0], [], [], [0]

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc or 0)
        self.null.append(doc is None)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK_IDS:
            flat = np.concatenate(self.held)
            whole = len(flat) - len(flat) % BLOCK_IDS
            for s in range(0, whole, BLOCK_IDS):
                self._block(flat[s : s + BLOCK_IDS])
            self.held, self.waiting = [flat[whole:]], len(flat) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.sink.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.held))
        for values, kind in ((self.offsets, "<u8"), (self.docs, "<i8"), (self.starts, "<u8"), (self.null, "u1")):
            self.sink.write(np.array(values, kind).tobytes())
        footer = (MAGIC, VERSION, self.bits, BLOCK_IDS, len(self.offsets) - 1, len(self.docs), self.n_ids)
        self.sink.write(np.array(footer, "<u8").tobytes())
        self.sink.close()


class Reader:
    """Random access by ids or documents; only the blocks asked for are read."""

    def __init__(self, uri: str) -> None:
        where, path = filesystem(uri)
        self.file = where.open_input_file(path)
        size = self.file.size()
        magic, version, self.bits, self.block, blocks, docs, self.n_ids = (int(x) for x in np.frombuffer(self.file.read_at(56, size - 56), "<u8"))
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError(f"{uri} is no file of packed ids")
        index = 8 * (blocks + 1) + 8 * docs + 8 * (docs + 1) + docs
        raw = self.file.read_at(index, size - 56 - index)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1)
        self.docs = np.frombuffer(raw, "<i8", docs, 8 * (blocks + 1))
        self.starts = np.frombuffer(raw, "<u8", docs + 1, 8 * (blocks + 1 + docs)).astype(np.int64)
        self.null = np.frombuffer(raw, "u1", docs, 8 * (blocks + 2 + 2 * docs)).astype(bool)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        a, b = int(self.offsets[first]), int(self.offsets[last + 1])
        raw = self.file.read_at(b - a, a)
        parts = []
        for k in range(first, last + 1):
            n = min(self.block, self.n_ids - k * self.block)
            parts.append(unpack_bits(raw[int(self.offsets[k]) - a : int(self.offsets[k + 1]) - a], n, self.bits))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write_packed(df: DataFrame, scratch: Scratch, path: str, kind: str = "byte", vocabulary: int | None = None, text: str = "text", id: str = "doc_id", end: int | None = 0, docs_per_file: int = 4096) -> DataFrame:
    """Encode every whole text and write the ids in ascending order of id; returns the files' manifest.

    Manifest: file (their order), uri, n_docs, n_ids, first_id (ids in all files before it).
    Files are runs of the order of about docs_per_file documents, by ranges of ids of which
    there are at most MAX_RANGES; a range that is larger has several files. They are written
    under another name and renamed, so a task that runs again writes the same file again.
    Texts of any length are encoded whole where they are read; ids are shuffled once, two bytes each for
    vocabularies up to 65,536. Beyond 41 million documents ranges grow: a task sorts them on its disk and holds one block.
    id must be integral. Equal ids go by a hash of their tokens where they fill several ranges, and by
    their tokens; null ids come first; a null text is an empty one. Extra columns are
    ignored. Empty input gives an empty manifest.
    """
    from .tokens import encoder

    bits = bits_for(vocabulary or encoder(path, kind).tokenizer.get_vocab_size())
    picked = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    n = picked.count()
    ranges = min(MAX_RANGES, max(1, -(-n // docs_per_file)))
    least = np.iinfo(np.int64).min
    key = F.coalesce("id", F.lit(int(least)))
    cuts = [] if ranges == 1 else picked.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    edges = np.array(sorted(cuts), np.int64)
    folder = f"{scratch.root}/ids"
    width = "<u2" if bits <= 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path, kind)
        tail = np.array([] if end is None else [end], width)
        for b in batches:
            keys = b.column("id").fill_null(least).to_numpy()
            low, at = (np.searchsorted(edges, keys, side=x) for x in ("left", "right"))
            ids = [np.concatenate([x.astype(width, copy=False), tail]) for x in of.batch(b.column("text").to_pylist())]
            for i in np.flatnonzero(at - low > 1):  # an id of more rows than a range has its own ranges
                at[i] = low[i] + 1 + zlib.crc32(ids[i]) % (at[i] - low[i])
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), b.column("id"), binary_column(ids)], ["file", "id", "ids"])

    dealt = picked.mapInArrow(encode, "file long, id long, ids binary")
    dealt = dealt.repartition(ranges, "file").sortWithinPartitions("file", F.col("id").asc_nulls_first(), "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = filesystem(folder)
        where.create_dir(base, recursive=True)
        current, writer, held, no = None, None, "", 0

        def done() -> pa.RecordBatch:
            writer.close()
            number = current * 1_000_000 + no
            where.move(held, f"{base}/{number:012d}.ids")
            row = [[number], [f"{folder}/{number:012d}.ids"], [len(writer.docs)], [writer.n_ids]]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["file", "uri", "n_docs", "n_ids"])

        for b in batches:
            ids = b.column("ids")
            for i, (file, doc) in enumerate(zip(b.column("file").to_pylist(), b.column("id").to_pylist(), strict=True)):
                if file != current or len(writer.docs) >= 4 * docs_per_file:
                    if writer:
                        yield done()
                    no = no + 1 if file == current else 0
                    current, held = file, f"{base}/.{file}-{no}-{uuid.uuid4().hex}"
                    writer = Writer(where.open_output_stream(held), bits)
                writer.add(doc, np.frombuffer(ids[i].as_buffer(), width).astype(np.uint32))
        if writer:
            yield done()

    manifest = scratch.table(dealt.mapInArrow(write, "file long, uri string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_packed(manifest: DataFrame, id: str = "doc_id") -> DataFrame:
    """The files' documents: id, start (ids in all documents before it), n_tokens, ids (little-endian unsigned 32-bit). A task per file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, first in zip(b.column("uri").to_pylist(), b.column("first_id").to_pylist(), strict=True):
                file = Reader(uri)
                ends = [*range(0, len(file.docs), 256), len(file.docs)]
                for lo, hi in pairwise(ends):
                    s = file.starts[lo : hi + 1]
                    flat = file.ids(int(s[0]), int(s[-1]))
                    parts = [flat[x:y] for x, y in pairwise((s - s[0]).tolist())]
                    doc = pa.array(file.docs[lo:hi], pa.int64(), mask=file.null[lo:hi])
                    yield pa.RecordBatch.from_arrays([doc, pa.array(first + s[:-1]), pa.array(np.diff(s)), binary_column(parts)], [id, "start", "n_tokens", "ids"])

    spread = manifest.select("file", "uri", "first_id").repartition(max(1, manifest.count()), "file")
    return spread.mapInArrow(read, f"{id} long, start long, n_tokens long, ids binary")
