"""What a text must hold for a pattern to match in it.

A regular expression is taken apart and its necessary literals are read off: of
parts in a row any one will do, of alternatives all together, of a repeated
part only if it must occur. Testing for these by plain substring search tells
most texts apart before a regular expression runs.

Letters are compared in lower case and only ASCII counts, so the test holds
whatever the case rules of the pattern are; it is necessary, never sufficient.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import lru_cache
from re import _constants as sre
from re import _parser as sre_parse

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORTEST = 1


def _weight(literals: frozenset[str]) -> tuple[int, int]:
    """The longer the shortest literal, and the fewer there are, the better."""
    return min(map(len, literals)), -len(literals)


def _best(options: Iterable[frozenset[str] | None]) -> frozenset[str] | None:
    told = [o for o in options if o]
    return max(told, key=_weight) if told else None


def _needed(parts) -> frozenset[str] | None:
    """Literals of which every match of the parts in a row holds one; None where none can be named."""
    options: list[frozenset[str] | None] = []
    run = ""
    for kind, value in parts:
        if kind is sre.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if run:
            options.append(frozenset([run]))
            run = ""
        if kind is sre.SUBPATTERN:
            options.append(_needed(value[3]))
        elif kind is sre.ATOMIC_GROUP:
            options.append(_needed(value))
        elif kind is sre.BRANCH:
            arms = [_needed(arm) for arm in value[1]]
            options.append(frozenset().union(*arms) if all(arms) else None)
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] > 0:
            options.append(_needed(value[2]))
    if run:
        options.append(frozenset([run]))
    return _best(o for o in options if o and min(map(len, o)) >= SHORTEST)


@lru_cache(maxsize=None)
def literals(pattern: str) -> frozenset[str] | None:
    """Lower-case literals of which every match of `pattern` holds one, or None: then nothing can be told.

    Patterns in a syntax that only the JVM knows are not taken apart.
    """
    if re.search(r"\(\?[a-z]*[xd]|\\[QEpPRXhHGzZkK]|&&", pattern):
        return None
    try:
        return _needed(sre_parse.parse(pattern))
    except re.error:
        return None


def any_of(patterns: Sequence[str]) -> frozenset[str] | None:
    """Literals of which a text holds one if any of the patterns matches in it."""
    told = [literals(p) for p in patterns]
    return frozenset().union(*told) if told and all(told) else None


def all_of(groups: Sequence[frozenset[str] | None]) -> frozenset[str] | None:
    """The most telling of several sets that all have to be met."""
    return _best(groups)


def may_hold(lowered: Column, wanted: frozenset[str] | None) -> Column:
    """Whether a lower-case text holds one of the literals; true where there are none to look for."""
    if wanted is None:
        return F.lit(True)
    # a literal inside another is the wider test
    least = [w for w in sorted(wanted, key=lambda w: (len(w), w)) if not any(o != w and o in w for o in wanted)]
    found = F.contains(lowered, F.lit(least[0]))
    for word in least[1:]:
        found = found | F.contains(lowered, F.lit(word))
    return found
