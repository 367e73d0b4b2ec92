"""An n-gram language model in Elias-Fano tries, memory-mapped by the tasks that score."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, Scratch, WordHashes, filesystem, words_of
from .elias_fano import EliasFano, from_buffer, to_file

#: The token after a text's words and before its first: no word is empty.
END = b""
#: Different values of a quantised log10 probability.
LEVELS = 256
#: Tokens that a task gathers before it counts them.
GATHER = 4_000_000
#: Tokens scored at once: each different pair among them is looked up once.
SCORE_TOKENS = 2_000_000


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, codebook): LEVELS bins of equal width, each decoded to its mean, so no value is off by more than a LEVELS-th of their range."""
    if not len(values):
        return np.empty(0, np.uint8), np.zeros(1)
    low = values.min()
    bins = np.minimum(((values - low) * (LEVELS / max(values.max() - low, 1e-300))).astype(np.int64), LEVELS - 1)
    n = np.maximum(np.bincount(bins, minlength=LEVELS), 1)
    return bins.astype(np.uint8), low + np.bincount(bins, values - low, LEVELS) / n


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with their counts' sums."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _blobs(keys: np.ndarray, counts: np.ndarray, shards: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Sorted keys and counts, cut by shard and compressed: what a task sends of its counts."""
    cut = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(shards) else []
    out, ends = [], [*cut[1:], len(keys)] if len(cut) else []
    press = zstandard.ZstdCompressor(level=1)
    for a, b in zip(cut, ends, strict=True):
        delta = np.diff(keys[a:b], prepend=keys[a:b][:1] * 0)
        planes = [x.view(np.uint8).reshape(-1, 8).T.tobytes() for x in (delta, counts[a:b].astype(np.int64))]  # bytes of one weight together
        out.append(press.compress(np.array([b - a], np.int64).tobytes() + b"".join(planes)))
    return [int(shards[a]) for a in cut], out


def _unblob(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    keys, counts = (np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8 + k * 8 * n).reshape(8, n).T).reshape(-1) for k in (0, 1))
    return np.cumsum(keys.view(np.uint64), dtype=np.uint64), counts.view(np.int64)


def _publish(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    where, base = filesystem(folder)
    where.create_dir(base, recursive=True)
    held = f"{base}/.{name}-{uuid.uuid4().hex}"
    with where.open_output_stream(held) as f:
        f.write(to_file(arrays))
    where.move(held, f"{base}/{name}")
    return f"{folder}/{name}"


def _mapped(uri: str) -> dict[str, np.ndarray]:
    """A published file, memory-mapped: in place if this machine sees it, else from a local copy that has no name any more."""
    if uri.startswith("file:"):
        return from_buffer(np.memmap(filesystem(uri)[1], np.uint8, "r"))
    where, path = filesystem(uri)
    with tempfile.NamedTemporaryFile() as copy:
        with where.open_input_stream(path) as source:
            shutil.copyfileobj(source, copy)
        copy.flush()
        return from_buffer(np.memmap(copy.name, np.uint8, "r"))


class Trie:
    """The published levels of a model: words by hash, then successors by context."""

    def __init__(self, words: list[tuple[int, str, int]], pairs: list[tuple[int, str]], bits: int, tokens: int) -> None:
        self.bits, self.tokens = bits, tokens
        self.base = np.zeros((1 << bits) + 1, np.int64)
        for s, _, n in words:
            self.base[s + 1] = n
        self.base = np.cumsum(self.base)
        self.v = int(self.base[-1])
        self.words_at = {s: u for s, u, _ in words}
        self.pairs_at = dict(pairs)
        self.open: dict[str, dict] = {}
        self.ids: dict[bytes, int] = {}
        self.hashes = WordHashes()

    def _level(self, uri: str) -> dict:
        if uri not in self.open:
            a = _mapped(uri)
            self.open[uri] = a | {n.removesuffix(".head"): EliasFano(a, n.removesuffix(".head")) for n in a if n.endswith(".head")}
        return self.open[uri]

    def find_words(self, h: np.ndarray) -> np.ndarray:
        """Ids of sorted hashes; -1 of unknown ones."""
        out = np.full(len(h), -1, np.int64)
        shard = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        for s, a, b in _slices(shard):
            if s in self.words_at:
                level = self._level(self.words_at[s])
                want = h[a:b] & np.uint64((1 << (64 - self.bits)) - 1)
                at, ok = level["hash"].find(want)
                out[a:b][ok] = self.base[s] + at[ok]
        return out

    def token_ids(self, words: list[bytes]) -> np.ndarray:
        if len(self.ids) > 2 * CACHE_WORDS:
            self.ids.clear()
        missing = list(set(words) - self.ids.keys())
        if missing:
            h = self.hashes.of(missing)
            self.hashes.clear()
            order = np.argsort(h)
            found = np.empty(len(h), np.int64)
            found[order] = self.find_words(h[order])
            self.ids.update(zip(missing, found.tolist(), strict=True))
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def word_facts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, log10 probability, log10 weight of unseen successors) of sorted ids; unknown words have count 0."""
        count = np.zeros(len(ids), np.int64)
        p = np.full(len(ids), np.log10(0.5 / (self.tokens + 0.5 * (self.v + 1))))
        back = np.zeros(len(ids))
        known = ids >= 0
        for s, a, b in _slices(np.where(known, np.searchsorted(self.base, ids, side="right") - 1, -1)):
            if s >= 0:
                level = self._level(self.words_at[s])
                at = ids[a:b] - self.base[s]
                count[a:b] = (level["count"].access(at + 1) - level["count"].access(at)).astype(np.int64)
                p[a:b] = level["p.book"][level["p.code"][at]]
                if s in self.pairs_at:
                    pairs = self._level(self.pairs_at[s])
                    back[a:b] = pairs["back.book"][pairs["back.code"][at]]
        return count, p, back

    def pair_scores(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Stored log10 probabilities of pairs sorted by left; nan where a pair was not seen."""
        out = np.full(len(left), np.nan)
        shard = np.where((left >= 0) & (right >= 0), np.searchsorted(self.base, left, side="right") - 1, -1)
        for s, a, b in _slices(shard):
            if s < 0 or s not in self.pairs_at:
                continue
            level = self._level(self.pairs_at[s])
            own = left[a:b] - self.base[s]
            new = np.concatenate([[True], own[1:] != own[:-1]])
            at, which = own[new], np.cumsum(new) - 1
            first, end = (level["pointer"].access(at + k).astype(np.int64) for k in (0, 1))
            # numbers of a context start from the last one of the context before it
            start = np.where(first > 0, level["next"].access(np.maximum(first - 1, 0)), np.uint64(0))
            some = np.flatnonzero((end > first)[which])
            if not len(some):
                continue
            which = which[some]
            place, ok = level["next"].find(start[which] + right[a:b][some].astype(np.uint64) + np.uint64(1))
            ok &= place < end[which]
            out[a + some[ok]] = level["p.book"][level["p.code"][place[ok]]]
        return out


def _slices(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(shard):
        cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        yield from zip(shard[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(shard)], strict=True)


def _texts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[list[bytes]]]:
    """Tokens of texts, in groups of about size tokens."""
    held: list[list[bytes]] = []
    n = 0
    for b in batches:
        for t in b.column("text").cast(pa.binary()).to_pylist():
            held.append([*words_of(t), END])
            n += len(held[-1])
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held


def build(training: DataFrame, scratch: Scratch, bits: int) -> tuple[list, list, int]:
    """Count and publish both levels from the texts of training; returns the files' manifests and the number of tokens.

    Words are sharded by the leading bits of their hash, pairs by their first word. Tasks
    send their own sums, sorted and compressed; a task per shard merges them and writes one
    file. Probabilities are interpolated: a word after a context has its count there plus
    T times its own probability, over the context's count plus T, T being the context's
    number of different successors; a word's own probability has half a count added.
    """
    folder = f"{scratch.root}/model"
    shift = np.uint64(64 - bits)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for texts in _texts(batches, GATHER):
            h = np.concatenate([cache.of(t) for t in texts])
            keys, n = np.unique(h, return_counts=True)
            shards, blobs = _blobs(keys, n, (keys >> shift).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        shard, keys, counts = None, [], []
        for b in batches:
            for s, blob in zip(b.column("shard").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if s != shard:
                    if keys:
                        yield shard, *_sums(np.concatenate(keys), np.concatenate(counts))
                    shard, keys, counts = s, [], []
                k, n = _unblob(blob)
                keys.append(k)
                counts.append(n)
                if len(keys) > 64:
                    k, n = _sums(np.concatenate(keys), np.concatenate(counts))
                    keys, counts = [k], [n]
        if keys:
            yield shard, *_sums(np.concatenate(keys), np.concatenate(counts))

    n_shards = 1 << bits
    dealt = lambda f, **k: training.mapInArrow(f, "shard int, blob binary").repartition(n_shards, "shard").sortWithinPartitions("shard")
    # the sums of a shard, before the totals that probabilities need are known
    sums = scratch.table(dealt(count_words), "words")
    names = "shard int, uri string, n long, tokens long"
    again = sums.repartition(n_shards, "shard").sortWithinPartitions("shard")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, keys, n in merged(batches):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([""]), pa.array([len(keys)]), pa.array([int(n.sum())])], ["shard", "uri", "n", "tokens"])

    sizes = again.mapInArrow(totals, names).collect()  # a row per shard
    tokens, v = sum(r["tokens"] for r in sizes), sum(r["n"] for r in sizes)
    if v >= 1 << 32:
        raise ValueError(f"{v} different words; pairs hold ids of 32 bits")

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, keys, n in merged(batches):
            code, book = quantise(np.log10((n + 0.5) / (tokens + 0.5 * (v + 1))))
            arrays = EliasFano.build(keys & np.uint64((1 << (64 - bits)) - 1), "hash") | EliasFano.build(np.concatenate([[0], np.cumsum(n)]), "count") | {"p.code": code, "p.book": book}
            uri = _publish(folder, f"words-{s:06d}", arrays)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([uri]), pa.array([len(keys)]), pa.array([int(n.sum())])], ["shard", "uri", "n", "tokens"])

    words = [(r["shard"], r["uri"], r["n"]) for r in scratch.table(again.mapInArrow(write_words, names), "manifest").collect()]

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(words, [], bits, tokens)
        for texts in _texts(batches, GATHER):
            flat = trie.token_ids([END, *(w for t in texts for w in t)])
            keys, n = np.unique(flat[:-1].astype(np.uint64) << np.uint64(32) | flat[1:].astype(np.uint64), return_counts=True)
            shards, blobs = _blobs(keys, n, np.searchsorted(trie.base, (keys >> np.uint64(32)).astype(np.int64), side="right") - 1)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(words, [], bits, tokens)
        for s, keys, n in merged(batches):
            left = (keys >> np.uint64(32)).astype(np.int64) - trie.base[s]
            right = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            size = int(trie.base[s + 1] - trie.base[s])
            different, total = np.bincount(left, minlength=size), np.bincount(left, n, size)
            pointer = np.concatenate([[0], np.cumsum(different)])
            own = np.log10(0.5 / (tokens + 0.5 * (v + 1))) * np.ones(len(right))
            order = np.argsort(right, kind="stable")
            own[order] = trie.word_facts(right[order])[1]
            p = np.log10((n + different[left] * 10**own) / (total + different)[left])
            back = np.log10(np.maximum(different, 1e-300) / np.maximum(total + different, 1))
            last = np.zeros(size + 1, np.int64)  # the last number of each context, from its size in numbers
            some = different > 0
            width = np.zeros(size, np.int64)
            width[some] = right[pointer[1:][some] - 1] + 1
            last[1:] = np.cumsum(width)
            code, book = quantise(p)
            back_code, back_book = quantise(np.where(some, back, 0.0))
            arrays = EliasFano.build(pointer, "pointer") | EliasFano.build(last[left] + right + 1, "next")
            uri = _publish(folder, f"pairs-{s:06d}", arrays | {"p.code": code, "p.book": book, "back.code": back_code, "back.book": back_book})
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([uri]), pa.array([len(keys)]), pa.array([int(n.sum())])], ["shard", "uri", "n", "tokens"])

    pairs = [(r["shard"], r["uri"]) for r in scratch.table(dealt(count_pairs).mapInArrow(write_pairs, names), "manifest").collect()]
    scratch.drop(*scratch.made)  # counts and manifests are in the files and on the driver by now
    return words, pairs, tokens


_tries: dict[str, Trie] = {}


def _trie(words: list, pairs: list, bits: int, tokens: int) -> Trie:
    """One trie per worker and model; its files stay mapped from task to task."""
    key = f"{words[0][1] if words else ''} {len(pairs)}"
    if key not in _tries:
        _tries.clear()
        _tries[key] = Trie(words, pairs, bits, tokens)
    return _tries[key]


def score_texts(df: DataFrame, text: str = "text", id: str = "doc_id", folds: int = 5, held_out: int = 1, docs_per_shard: int = 8192) -> DataFrame:
    """Score whole texts by a model of the texts outside the held-out fold.

    Words are lower-cased in A-Z; a text's tokens are its words and one end. Returns per row: id,
    held_out (crc32 of the id as text, modulo folds, is held_out), n_tokens, n_known (tokens that training
    has), train_tokens, base_score (sum of log10((c + 0.5) / (N + 0.5 (V + 1))), counts exact),
    score (log10 of the text's probability under the pair model, first word after an end).

    Memory: a word takes about 8 bytes and a pair about 4 in the files, which tasks map and
    share; more than 2^32 different words raise an error. Very long texts are scored whole. Null texts are empty, of the end alone. A null id trains and is
    not held out. Repeated rows count as often as they stand. Extra columns are ignored. Without
    training texts every token is unknown. Empty input gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "ngrams")
    picked = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    fold = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % folds == held_out, F.lit(False))
    training = picked.where(~fold).select("text")
    bits = max(2, (training.count() // docs_per_shard).bit_length())
    words, pairs, tokens = build(training, scratch, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(words, pairs, bits, tokens)
        held: list[pa.RecordBatch] = []
        texts: list[list[bytes]] = []
        n = 0
        for b in batches:
            new = [[*words_of(t), END] for t in b.column("text").cast(pa.binary()).to_pylist()]
            n += sum(map(len, new))
            texts += new
            held.append(b)
            if n >= SCORE_TOKENS:
                yield scored(trie, held, texts)
                held, texts, n = [], [], 0
        if texts:
            yield scored(trie, held, texts)

    def scored(trie: Trie, held: list[pa.RecordBatch], texts: list[list[bytes]]) -> pa.RecordBatch:
        flat = trie.token_ids([END, *(w for t in texts for w in t)])
        ids, at = np.unique(flat, return_inverse=True)
        count, p, back = trie.word_facts(ids)
        base = np.log10((count + 0.5) / (tokens + 0.5 * (trie.v + 1)))
        key, where = np.unique(at[:-1] * len(ids) + at[1:], return_inverse=True)
        left, right = np.divmod(key, len(ids))
        seen = trie.pair_scores(ids[left], ids[right])
        scores = np.where(np.isnan(seen), back[left] + p[right], seen)[where]
        size = np.array([len(t) for t in texts])
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        own = at[1:]
        columns = [pa.array(size), pa.array(np.add.reduceat((count > 0)[own].astype(np.int64), first)), pa.array(np.full(len(size), tokens)), pa.array(np.add.reduceat(base[own], first)), pa.array(np.add.reduceat(scores, first))]
        kept = [pa.concat_arrays([b.column(c) for b in held]) for c in ("id", "held_out")]
        return pa.RecordBatch.from_arrays([*kept, *columns], names)

    names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    id_type = picked.schema["id"].dataType.simpleString()
    out = picked.withColumn("held_out", fold).mapInArrow(run, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id)
