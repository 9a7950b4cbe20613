"""Boolean trigram queries of regular expressions, in lower case.

A query is an OR of ANDs, a set of sets of trigrams: every text that matches the expression holds all trigrams of
one of the sets.  ``ANY``, the query with one empty set, says nothing.  The parts of an expression give either the
few strings that they can match (``exact``) or a query; strings of neighbouring parts are joined before trigrams are
taken from them.  Parts that cannot be followed say nothing, so a query never rules out a match.
"""

from __future__ import annotations

import re

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
#: Strings of a part that are followed one by one, and sets of a query, at most.
STRINGS = 64
SETS = 64


def simple(sets: Query) -> Query:
    """Without the sets that hold another one: those who ask for less decide."""
    return frozenset(s for s in sets if not any(t < s for t in sets))


def either(queries: list[Query]) -> Query:
    out = simple(frozenset().union(*queries))
    return out if len(out) <= SETS else ANY


def both(a: Query, b: Query) -> Query:
    out = simple(frozenset(x | y for x in a for y in b))
    if len(out) <= SETS:
        return out
    # one of the two alone asks for less, which is safe
    return max(a, b, key=lambda q: min(map(len, q)))


def of_strings(strings: frozenset[str]) -> Query:
    return either([frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings]) if strings else ANY


def char(code: int) -> str | None:
    """The letter in lower case; null for what letter case might turn into something else."""
    return chr(code).lower() if code < 128 else None


def chars(items: list) -> frozenset[str] | None:
    """The characters of a class, if they are few and plain."""
    out: set[str] = set()
    for kind, value in items:
        name = str(kind)
        if name == "LITERAL":
            codes = [value]
        elif name == "RANGE" and value[1] - value[0] < STRINGS:
            codes = range(value[0], value[1] + 1)
        else:
            return None
        found = [char(c) for c in codes]
        if None in found:
            return None
        out.update(found)
    return frozenset(out) if len(out) <= STRINGS else None


def joined(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    return None if a is None or b is None or len(a) * len(b) > STRINGS else frozenset(x + y for x in a for y in b)


def repeated(exact: frozenset[str] | None, query: Query, least: int, most: int) -> tuple[frozenset[str] | None, Query]:
    if least == 0 and (exact is None or most > 4):
        return None, ANY
    run: frozenset[str] | None = frozenset([""])
    for _ in range(min(least, 8)):
        run = joined(run, exact)
    if run is None or least > 8:
        return None, of_strings(exact) if exact is not None else query
    if most > 4 and most != least:
        return None, of_strings(run)
    every, more = set(run), run
    for _ in range(most - least):
        more = joined(more, exact)
        if more is None:
            return None, of_strings(run) if least else ANY
        every |= more
    return (frozenset(every), ANY) if len(every) <= STRINGS else (None, of_strings(run) if least else ANY)


def part(kind: object, value: object) -> tuple[frozenset[str] | None, Query]:
    """The strings of one part of an expression, or else its query."""
    name = str(kind)
    if name == "LITERAL":
        c = char(value)
        return (None if c is None else frozenset([c])), ANY
    if name == "IN":
        return chars(value), ANY
    if name in ("AT", "ASSERT", "ASSERT_NOT"):
        return frozenset([""]), ANY  # has no width
    if name == "SUBPATTERN":
        return sequence(value[-1])
    if name == "ATOMIC_GROUP":
        return sequence(value)
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = value
        return repeated(*sequence(inner), int(least), int(most))
    if name == "BRANCH":
        each = [sequence(x) for x in value[1]]
        if all(e is not None for e, _ in each) and sum(len(e) for e, _ in each) <= STRINGS:
            return frozenset().union(*[e for e, _ in each]), ANY
        return None, either([q if e is None else of_strings(e) for e, q in each])
    return None, ANY


def sequence(parts) -> tuple[frozenset[str] | None, Query]:
    run, query, whole = frozenset([""]), ANY, True
    for kind, value in parts:
        exact, own = part(kind, value)
        longer = joined(run, exact)
        if longer is not None:
            run = longer
            continue
        query, whole = both(query, of_strings(run)), False
        if exact is None:
            query, run = both(query, own), frozenset([""])
        else:
            run = exact
    return (run, ANY) if whole else (None, both(query, of_strings(run)))


def query_of(pattern: str) -> Query:
    """The trigram query of an expression; ``ANY`` if nothing is mandatory or it cannot be read."""
    try:
        tree = re._parser.parse(pattern)
    except re.error:
        return ANY
    exact, query = sequence(tree)
    return query if exact is None else of_strings(exact)
