"""Boolean trigram queries that every match of a regular expression must meet.

A query is a set of alternatives, each a set of trigrams that must all occur in the lower-cased text. ``None``
stands for "no mandatory trigram": the rule has to scan every text. Patterns are parsed on the driver only.
"""

from __future__ import annotations

from re import _constants as c
from re import _parser

LONGEST = 64  # strings of an alternative are cut to this many characters
WIDEST = 48  # alternatives a concatenation may multiply out to

Strings = frozenset[str]
Query = frozenset[frozenset[str]]


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _class(items: list) -> Strings | None:
    out: set[str] = set()
    for op, arg in items:
        if op is c.LITERAL:
            out.add(chr(arg).lower())
        elif op is c.RANGE and arg[1] - arg[0] < 4:
            out |= {chr(x).lower() for x in range(arg[0], arg[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= 4 else None


def _branches(node: list) -> list[list[str | None]]:
    """All ways through a pattern as sequences of literal pieces; None marks a gap of unknown text."""
    ways: list[list[str | None]] = [[""]]

    def extend(options: list[list[str | None]]) -> None:
        nonlocal ways
        if len(ways) * len(options) > WIDEST:
            options = [[None]]
        out = []
        for way in ways:
            for more in options:
                joined = list(way)
                for piece in more:
                    if piece is not None and joined[-1] is not None:
                        joined[-1] = (joined[-1] + piece)[-LONGEST:] if len(joined[-1]) + len(piece) > LONGEST else joined[-1] + piece
                    elif piece is not None or joined[-1] is not None:
                        joined.append(piece)
                out.append(joined)
        ways = [list(x) for x in dict.fromkeys(map(tuple, out))]

    for op, arg in node:
        if op is c.LITERAL:
            extend([[chr(arg).lower()]])
        elif op is c.IN:
            found = _class(arg)
            extend([[x] for x in sorted(found)] if found else [[None]])
        elif op is c.SUBPATTERN:
            extend(_branches(arg[3]))
        elif op is c.BRANCH:
            extend([x for option in arg[1] for x in _branches(option)])
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            low, high, inner = arg
            if (low, high) == (0, 1):
                extend([[""], *_branches(inner)])
            else:
                for _ in range(min(low, 8)):
                    extend(_branches(inner))
                if low != high or low > 8:
                    extend([[None]])
        elif op is c.AT:
            continue
        else:
            extend([[None]])
    return ways


def trigram_query(pattern: str) -> Query | None:
    """The trigrams of each way through ``pattern``; None if some way has none."""
    options = {frozenset().union(*(_grams(p) for p in way if p)) for way in _branches(list(_parser.parse(pattern)))}
    if not all(options):
        return None
    return frozenset(x for x in options if not any(y < x for y in options))
