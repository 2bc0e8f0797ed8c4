"""Trigrams that every match of a regular expression holds, as a Boolean query."""

from __future__ import annotations

import itertools
from re import _constants as code
from re import _parser

#: Alternatives of a query, and strings that a part of an expression may stand for, beyond which less is asked for.
MOST = 64
#: Characters of a class that are told apart.
CLASS = 8

Query = frozenset[frozenset[str]]
#: Holds for every text.
ANY: Query = frozenset([frozenset()])


def _least(query: Query) -> Query:
    """``query`` without alternatives that ask for more than another."""
    return frozenset(q for q in query if not any(o < q for o in query))


def _and(a: Query, b: Query) -> Query:
    both = _least(frozenset(x | y for x, y in itertools.product(a, b)))
    return both if len(both) <= MOST else min(a, b, key=len)


def _or(parts: list[Query]) -> Query:
    found = _least(frozenset().union(*parts))
    return found if len(found) <= MOST else ANY


def _grams(strings: set[str]) -> Query:
    return _least(frozenset(frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings))


def _members(items: list) -> set[str] | None:
    """The characters of a class, lower case, if they are few."""
    found: set[int] = set()
    for op, value in items:
        if op is code.LITERAL:
            found.add(value)
        elif op is code.RANGE and value[1] - value[0] < 2 * CLASS:
            found.update(range(value[0], value[1] + 1))
        else:
            return None
    return _lowered(found)


def _lowered(points: set[int]) -> set[str] | None:
    """Only ASCII: the lower case of other characters may be of other length."""
    chars = {chr(c).lower() for c in points}
    return chars if len(chars) <= CLASS and max(points) < 128 else None


def _strings(op, value) -> set[str] | None:
    """All that a part can match, lower case, if that is few strings."""
    if op is code.LITERAL:
        return _lowered({value})
    if op is code.IN:
        return _members(value)
    if op is code.SUBPATTERN:
        return _all(value[3])
    if op is code.BRANCH:
        parts = [_all(b) for b in value[1]]
        return None if None in parts or len(set().union(*parts)) > MOST else set().union(*parts)
    if op is code.MAX_REPEAT and value[1] != code.MAXREPEAT and value[1] <= 4:
        one, found = _all(value[2]), set()
        for n in range(value[0], value[1] + 1) if one is not None else ():
            if len(one) ** n > MOST:
                return None
            found |= {"".join(p) for p in itertools.product(one, repeat=n)}
        return found if one is not None and len(found) <= MOST else None
    return None


def _all(items) -> set[str] | None:
    found = {""}
    for op, value in items:
        own = _strings(op, value)
        if own is None or len(own) * len(found) > MOST:
            return None
        found = {a + b for a in found for b in own}
    return found


def _query(items) -> Query:
    found, run = ANY, {""}
    for op, value in items:
        own = _strings(op, value)
        if own is not None and len(own) * len(run) <= MOST:
            run = {a + b for a in run for b in own}
            continue
        found, run = _and(found, _grams(run)), {""}
        if own is not None:
            run = own
        elif op is code.SUBPATTERN:
            found = _and(found, _query(value[3]))
        elif op is code.BRANCH:
            found = _and(found, _or([_query(b) for b in value[1]]))
        elif op is code.MAX_REPEAT and value[0] > 0:
            found = _and(found, _query(value[2]))
    return _and(found, _grams(run))


def trigram_query(pattern: str) -> Query:
    """Sets of trigrams, lower case; a text with a match of ``pattern`` holds all of one set, once it is lower case.

    Strings of adjacent characters, small classes, alternatives and short
    repeats are multiplied out; what follows or precedes something unbounded
    stands for itself. A single empty set means that no trigram is mandatory.
    Look-arounds and back references are asked nothing for.
    """
    return _query(_parser.parse(pattern))
