"""Token ids of whole texts, their packing into sequences, and their fixed-width files."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Chunks in each of the two generations of a worker's cache.
CACHE_CHUNKS = 400_000
#: White space other than space, tab, line feed and carriage return: the library has its own view of it.
_ODD_SPACE = re.compile(r"[^\S \t\n\r]|[\x00\x1c-\x1f\x85]")
#: Runs that a byte-level pattern never crosses: a word with at most one space before it, or white space.
_BYTE_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: A comma or full stop at a word's end that does not follow a plain Latin letter or a digit, so it may belong to what is before it.
_NO_CUT = re.compile(r"[.,](?!\S)(?<![A-Za-z0-9À-ÖØ-öø-ÿ][.,])")
#: Bytes that no unusual white space has: printable ASCII, usual white space, and two-byte letters from U+00C0 on.
_USUAL = bytes([9, 10, 13, *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xE0)])
_NOT_SINGLE = ("  ", "\n\n", " \n", "\n ", "\t", "\r")


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next one from 256 on."""
    prints = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    return [chr(b) if prints[b] else chr(256 + prints[:b].count(False)) for b in range(256)]


_LETTERS = dict(enumerate(_byte_letters()))
_PROBES = ("the", " the", "word", " naïve", "straße", " été", "señor", "x", "internationalisation")


class _Chunks(dict):
    """Chunk to the bytes of its ids, from the older generation or the library if need be."""

    def __init__(self, owner: Encoder) -> None:
        super().__init__()
        self.owner = owner
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            ids = self.owner.plain(chunk)
            if ids is None:
                ids = self.owner.tokenizer.encode(chunk, add_special_tokens=False).ids
            got = array(self.owner.code, ids).tobytes()
        self[chunk] = got
        return got


class Encoder:
    """Ids of texts by a tokenizers file as the library gives them with add_special_tokens=False, one cached chunk at a time.

    kind "byte" is for byte-level pre-tokenizers, which cut before every single space in
    front of a word; kind "word" for lower-casing ones that drop white space. Both treat what
    lies between such cuts by itself. A text whose final commas and full stops all follow a Latin
    letter or a digit is also cut before these, for both patterns end a run of letters or digits there. A text with
    unusual white space, or with the string of a special token, goes to the library whole: it
    gives such a string the token's id. Chunks are kept as bytes in two generations. Chunks of
    Latin letters only go to the library's model without its normaliser and patterns,
    which leave them as they are; a few probes make sure of that for each file.
    """

    def __init__(self, path: str, kind: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.kind = kind
        self.width = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = "H" if self.width is np.uint16 else "I"
        self.cache = _Chunks(self)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.special = re.compile("|".join(map(re.escape, special)), re.IGNORECASE) if special else None
        self.openings = {t[:2] for t in special}  # a quick look first, where no case can differ
        if any(c.isalpha() for t in self.openings for c in t):
            self.openings = {""}
        self.plain = lambda c: None
        probes = [p for p in _PROBES if kind == "byte" or p[0] != " "]
        if all(self._letters(p) == self.tokenizer.encode(p, add_special_tokens=False).ids for p in probes):
            self.plain = self._letters

    def _letters(self, chunk: str) -> list[int] | None:
        """Ids of a chunk of Latin letters; None for any other."""
        body = chunk[1:] if self.kind == "byte" and chunk[:1] == " " else chunk
        if not body.isalpha():
            return None
        if body.isascii():
            written = body if body is chunk else "\u0120" + body
        else:
            if max(body) >= "\u0250" or self.kind == "word" and body != body.lower() or not is_normalized("NFC", body):
                return None
            written = chunk.encode().decode("latin-1").translate(_LETTERS)
        return [t.id for t in self.tokenize(written)]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.width)

    def chunks(self, text: str) -> list[str]:
        cut = not _NO_CUT.search(text)
        if self.kind == "word":
            text = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
            if cut:
                text = text.replace(", ", " , ").replace(". ", " . ").replace(",\n", " ,\n").replace(".\n", " .\n")
            return text.split()
        if not cut or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _NOT_SINGLE):
            return _BYTE_CHUNK.findall(text)
        text = text.replace(", ", "\0, ").replace(". ", "\0. ").replace(",\n", "\0,\n").replace(".\n", "\0.\n")
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def one(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, self.width)
        if self.special and any(o in text for o in self.openings) and self.special.search(text):
            return self.whole(text)
        if text.encode("utf-8", "surrogatepass").translate(None, _USUAL) and _ODD_SPACE.search(text):
            return self.whole(text)
        return np.frombuffer(b"".join(map(self.cache.__getitem__, self.chunks(text))), self.width)

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; none of a null."""
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.old = dict(self.cache)
            self.cache.clear()
        return [self.one(t) for t in texts]


@lru_cache(maxsize=2)
def encoder(path: str, kind: str) -> Encoder:
    return Encoder(path, kind)


def binary_column(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def token_pieces(df: DataFrame, path: str, kind: str, text: str, capacity: int | None, end: int | None = 0) -> DataFrame:
    """df's columns but text, with each text's ids in pieces of at most capacity.

    Added columns: piece, start (ids of the text before it), length, ids (little-endian unsigned
    32-bit). end is appended to each text. A null text is an empty one.
    """
    from pyspark.sql import types as T

    names = [c for c in df.columns if c != text]
    added = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType())]
    schema = T.StructType([*(df.schema[c] for c in names), *(T.StructField(n, t) for n, t in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, kind)
        tail = np.array([] if end is None else [end], np.uint32)
        for b in batches:
            rows, piece, start, ids = [], [], [], []
            for i, got in enumerate(encode.batch(b.column(text).to_pylist())):
                got = np.concatenate([got, tail]).astype("<u4")
                width = capacity or max(len(got), 1)
                for p, s in enumerate(range(0, len(got), width)):
                    rows.append(i)
                    piece.append(p)
                    start.append(s)
                    ids.append(got[s : s + width])
            at = pa.array(rows, pa.int64())
            columns = [b.column(c).take(at) for c in names]
            columns += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), binary_column(ids)]
            yield pa.RecordBatch.from_arrays(columns, [*names, *(n for n, _ in added)])

    return df.mapInArrow(run, schema)
