"""Many regular expressions over one text: literals that a match can't do without say which of them are worth trying."""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from re import _constants as C
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alternatives that are followed; a pattern with more has no literals.
MOST = 16


def _joined(heads: set[str], tails: set[str]) -> set[str] | None:
    out = {a + b for a in heads for b in tails}
    return out if len(out) <= MOST else None


def _exact(items: list) -> set[str] | None:
    """All texts that a part of a pattern can be, if these are few literals."""
    out = {""}
    for op, arg in items:
        if op is C.LITERAL:
            own = {chr(arg)}
        elif op is C.SUBPATTERN and not arg[1]:
            own = _exact(list(arg[3]))
        elif op is C.BRANCH:
            parts = [_exact(list(b)) for b in arg[1]]
            own = None if any(p is None for p in parts) else set().union(*parts)
        elif op is C.AT:
            own = {""}
        else:
            own = None
        out = None if own is None else _joined(out, own)
        if out is None:
            return None
    return out


def _required(items: list) -> set[str] | None:
    """Texts of which each match holds at least one, as long as possible; None where there are none."""
    best: set[str] | None = None
    start = 0

    def better(found: set[str] | None) -> None:
        nonlocal best
        if found and all(found) and (best is None or (min(map(len, found)), -len(found)) > (min(map(len, best)), -len(best))):
            best = found

    while start < len(items):
        end = start
        run: set[str] | None = None
        while end < len(items) and (now := _exact(items[start : end + 1])) is not None:  # as many parts as are literals together
            run, end = now, end + 1
        better(run)
        if end == start:
            op, arg = items[start]
            if op is C.SUBPATTERN and not arg[1]:
                better(_required(list(arg[3])))
            elif op is C.BRANCH:
                parts = [_required(list(b)) for b in arg[1]]
                if all(parts) and sum(map(len, parts)) <= MOST:
                    better(set().union(*parts))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
                better(_required(list(arg[2])))
            end += 1
        start = end
    return best


@lru_cache(maxsize=1000)
def required(pattern: str) -> tuple[str, ...]:
    """Literals of which every match of a pattern holds at least one; none if that can't be told, or if it has flags."""
    try:
        tree = _parser.parse(pattern)
    except re.error:  # another dialect
        return ()
    if tree.state.flags & ~re.UNICODE.value:
        return ()
    found = _required(list(tree)) or set()
    # one that holds another needs no look of its own
    return tuple(sorted(a for a in found if not any(b != a and b in a for b in found)))


def matches(text: Column, pattern: str) -> Column:
    """Whether a pattern occurs in a text: its literals are looked for first, so most patterns cost most texts no regular expression."""
    literals = required(pattern)
    tried = text.rlike(pattern)
    return reduce(Column.__or__, [text.contains(x) for x in literals]) & tried if literals else tried


def any_of(text: Column, patterns: list[str]) -> Column:
    """Whether one of some patterns occurs; those without literals are one alternation."""
    with_literals = [p for p in patterns if required(p)]
    rest = [p for p in patterns if not required(p)]
    parts = [matches(text, p) for p in with_literals] + ([text.rlike("|".join(f"(?:{p})" for p in rest))] if rest else [])
    return reduce(Column.__or__, parts) if parts else F.lit(False)


def found(text: Column, patterns: list[str]) -> Column:
    """The patterns that occur in a text, in their order."""
    return F.array_compact(F.array(*[F.when(matches(text, p), F.lit(p)) for p in patterns]))
