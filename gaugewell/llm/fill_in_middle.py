"""Fill-in-middle transformation: an Aho-Corasick scan for the few events that decide where units end."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import BATCH_BYTES, prepare

#: Characters after which a unit can end; code points are units of their own and need none.
UNITS = {"line": "\n", "word": " \t\n\x0b\x0c\r", "char": ""}
SENTINELS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class Stretches:
    """What lies between events: where each stretch starts, the units before it, and whether its characters are units (step 1) or it is a single one (step 0)."""

    starts: np.ndarray
    before: np.ndarray
    step: int
    units: int
    chars: int

    def place(self, rank: int) -> int:
        """Code points before the unit of a rank; all of them for the number of units."""
        if rank >= self.units:
            return self.chars
        j = int(np.searchsorted(self.before, rank, "right")) - 1
        return int(self.starts[j]) + (rank - int(self.before[j])) * self.step


class Scanner:
    """One automaton over the characters that end units and the sentinels."""

    def __init__(self, unit: str, sentinels: Sequence[str]) -> None:
        if unit not in UNITS:
            raise ValueError(f"unit must be one of {sorted(UNITS)}")
        if len(set(sentinels)) != 3 or not all(sentinels):
            raise ValueError("three different sentinels are needed")
        for a in sentinels:
            for b in sentinels:
                if any(a[i:] == b[: len(a) - i] for i in range(1, len(a))) or a != b and b in a or any(c in UNITS[unit] for c in a):
                    raise ValueError(f"sentinels {a!r} and {b!r} could be read in each other or as ends of units")
        self.unit, self.sentinels = unit, tuple(sentinels)
        self.automaton = ahocorasick.Automaton()
        for word in (*UNITS[unit], *sentinels):
            self.automaton.add_word(word, len(word) > 1 or word in sentinels)
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[Stretches, bool]:
        """The stretches of a text, and whether it holds a sentinel."""
        ends, marked = [], False
        for at, sentinel in self.automaton.iter(text):
            if sentinel:
                marked = True
            else:
                ends.append(at + 1)
        n = len(text)
        if self.unit == "char":
            return Stretches(np.zeros(1, np.int64), np.zeros(1, np.int64), 1, n, n), marked
        at = np.array(ends, np.int64)
        if self.unit == "word" and len(at):  # a run of white space ends one unit
            at = at[np.append(at[1:] != at[:-1] + 1, True)]
        starts = np.concatenate([np.zeros(1, np.int64), at])
        return Stretches(starts, np.arange(len(starts)), 0, len(at) + (n > starts[-1]), n), marked

    def restore(self, output: str, form: str) -> str:
        """The text that gave an output."""
        if form == "plain":
            return output
        p, s, m = self.sentinels
        first, second = (p, s) if form == "psm" else (s, p)
        one, _, rest = output.removeprefix(first).partition(second)
        two, _, middle = rest.partition(m)
        return one + middle + two if form == "psm" else two + middle + one


def transform(scanner: Scanner, text: str, id: int | None, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of a text."""
    found, marked = scanner.scan(text)
    digest = hashlib.sha256(f"7:{'' if id is None else id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = found.units
    if not text or marked or h3 % 100 >= rate:
        return n, "plain", None, None, text
    i, j = (found.place(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    p, s, m = scanner.sentinels
    if h4 % 100 < spm:
        return n, "spm", i, j - i, f"{s}{text[j:]}{p}{text[:i]}{m}{text[i:j]}"
    return n, "psm", i, j - i, f"{p}{text[:i]}{s}{text[j:]}{m}{text[i:j]}"


def _in_parts(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH_BYTES, so that outputs of long texts don't pile up."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + 2 * sum(len(x) for x in row if isinstance(x, str))
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string()}
    return pa.schema([(f.name, kinds[f.dataType]) for f in schema])


def fill_in_middle(df: DataFrame, text: str = "text", id: str = "doc_id", unit: str = "line", rate: int = 100, spm: int = 50, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """Texts cut at two places into prefix, middle and suffix, with the middle put last. One row per row of df.

    Returns id (long), n (units of the text), form, prefix_chars, middle_chars (code points; null if plain) and output. Units are
    lines with their line feed, words with the white space after them (white space that opens a text is one), or code points. Where the cuts are and
    which form it takes follow from a hash of the id, so a task that runs again gives the same. Of texts, rate percent
    are changed; of those, spm percent put the suffix first (spm), the others the prefix (psm).

    Null and empty texts, and those that hold a sentinel's string, stay plain. Rows that repeat an id are cut
    at the same ranks of their own units. A null id is hashed as none. Very long texts are cut whole. Extra columns are ignored. Empty input
    gives an empty result.
    """
    prepare(df.sparkSession)
    Scanner(unit, sentinels)
    schema = T.StructType([T.StructField(id, T.LongType()), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("prefix_chars", "middle_chars")), T.StructField("output", T.StringType())])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(unit, sentinels)
        rows = (pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        return _in_parts(((i, *transform(scanner, t or "", i, rate, spm)) for i, t in rows), arrow)

    return df.select(df[id].cast("long").alias(id), df[text].cast("string").alias("x_text")).mapInArrow(run, schema)


def restore(df: DataFrame, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """df's columns and restored: the text that gave output in its form; null where either is null."""
    prepare(df.sparkSession)
    names = df.columns
    schema = T.StructType([*df.schema, T.StructField("restored", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner("line", sentinels)
        for b in batches:
            pairs = zip(b.column(names.index("output")).to_pylist(), b.column(names.index("form")).to_pylist())
            texts = [None if o is None or f is None else scanner.restore(o, f) for o, f in pairs]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, "restored"])

    return df.mapInArrow(run, schema)
