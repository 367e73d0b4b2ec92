"""Named components: builders that users add to."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame

KINDS = ("adapter", "parser", "metric", "dataset", "reporter", "task")
_found: dict[str, dict[str, Callable]] = {k: {} for k in KINDS}


def register(kind: str, name: str, builder: Callable) -> Callable:
    if name in _found[kind]:
        raise ValueError(f"{kind} {name} is registered already")
    _found[kind][name] = builder
    return builder


def create(kind: str, name: str, *args: object, **options: object) -> object:
    if name not in _found[kind]:
        raise ValueError(f"unknown {kind} {name}; known: {', '.join(sorted(_found[kind])) or 'none'}")
    return _found[kind][name](*args, **options)


def unregister(kind: str, name: str) -> None:
    _found[kind].pop(name, None)


def listed(kind: str | None = None) -> dict[str, list[str]]:
    return {k: sorted(v) for k, v in _found.items() if kind in (None, k)}


class Parser(Protocol):
    """A text column to struct(content, confidence, parser_used)."""

    def __call__(self, text: Column) -> Column: ...


class Loader(Protocol):
    """Raw rows, numbered by idx, to rows of samples; those without a prompt are left out."""

    def __call__(self, rows: DataFrame) -> DataFrame: ...


class Metric(Protocol):
    """(content, reference) to a score from 0 to 1, or a boolean."""

    def __call__(self, content: Column, reference: Column) -> Column: ...


class Reporter(Protocol):
    """Results to a frame of what is told of them."""

    def __call__(self, results: DataFrame) -> DataFrame: ...
