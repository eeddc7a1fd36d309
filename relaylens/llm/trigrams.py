"""Boolean trigram queries from regular expressions."""

from __future__ import annotations

from itertools import product
from re import _constants as op
from re import _parser as parser

#: Any of these sets of trigrams must be contained whole in a text that matches. A set without members demands nothing.
Query = frozenset[frozenset[str]]
ANYTHING: Query = frozenset([frozenset()])
MOST_STRINGS = 64


def _minimal(sets) -> Query:
    kept: list[frozenset[str]] = []
    for candidate in sorted(set(sets), key=len):
        if not any(k <= candidate for k in kept):
            kept.append(candidate)
    return frozenset(kept)


def _both(a: Query, b: Query) -> Query:
    """What demands ``a`` and ``b``; where that grows too large, the side that says more."""
    if len(a) * len(b) > MOST_STRINGS:
        return max(a, b, key=lambda q: min(map(len, q)))
    return _minimal(x | y for x, y in product(a, b))


def _of(strings: set[str]) -> Query:
    return _minimal(frozenset(s[k:k + 3] for k in range(len(s) - 2)) for s in strings)


def _members(items) -> set[str] | None:
    """The few characters of a class, in lower case; None for a large or negated one."""
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 4:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 4 else None


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """All strings that the nodes can match, if those are few, and what every match demands."""
    strings, whole, demand = {""}, True, ANYTHING

    def add(options: set[str]) -> None:
        nonlocal strings, whole, demand
        if len(strings) * len(options) > MOST_STRINGS:
            cut()
        strings = {a + b for a, b in product(strings, options)} if len(options) <= MOST_STRINGS else {""}

    def cut() -> None:
        nonlocal strings, whole, demand
        demand, strings, whole = _both(demand, _of(strings)), {""}, False

    for kind, value in nodes:
        if kind is op.LITERAL:
            add({chr(value).lower()})
        elif kind is op.IN and (members := _members(value)):
            add(members)
        elif kind is op.SUBPATTERN or kind is op.BRANCH:
            parts = [_walk(value[-1])] if kind is op.SUBPATTERN else [_walk(part) for part in value[1]]
            if all(known is not None for known, _ in parts):
                add(set().union(*(known for known, _ in parts)))
            else:
                cut()
                demand = _both(demand, _minimal(q for _, query in parts for q in (query)))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, body = value
            known, query = _walk(body)
            if known is not None and most <= 1:
                add(known | {""} if least == 0 else known)
            elif known is not None and least == most <= 4:
                for _ in range(least):
                    add(known)
            else:
                if known is not None and least:
                    add(known)
                cut()
                if known is None and least:
                    demand = _both(demand, query)
        elif kind is not op.AT:
            cut()
    return (strings, _of(strings)) if whole else (None, _both(demand, _of(strings)))


def query_of(pattern: str) -> Query:
    """Sets of lower-case trigrams, one of which lies whole in every lower-cased text that ``pattern`` matches."""
    return _walk(parser.parse(pattern))[1]
