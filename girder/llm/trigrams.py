"""Boolean trigram queries derived from regular expressions (driver-side, at planning time).

For each part of a parsed pattern the set of strings it can match is followed as
long as it stays small; where it ends, the trigrams of the strings so far become
mandatory.  Case is folded, so queries hold for lower-cased text.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as c  # type: ignore[attr-defined]
from re import _parser as parser  # type: ignore[attr-defined]

#: More alternatives than this are given up as "any string".
MAX_SET = 64
#: Classes of more letters than this are given up too.
MAX_LETTERS = 16


@dataclass(frozen=True)
class Query:
    """ANY, or AND/OR of trigrams and queries."""

    op: str  # any, tri, and, or
    parts: tuple = ()

    def trigrams(self) -> set[str]:
        return {self.parts[0]} if self.op == "tri" else set().union(*(p.trigrams() for p in self.parts)) if self.parts else set()


ANY = Query("any")


def both(a: Query, b: Query) -> Query:
    if ANY in (a, b):
        return b if a == ANY else a
    return a if a == b else Query("and", (a, b))


def either(qs: list[Query]) -> Query:
    qs = list(dict.fromkeys(qs))
    if ANY in qs or not qs:
        return ANY
    return qs[0] if len(qs) == 1 else Query("or", tuple(qs))


def of_string(s: str) -> Query:
    tris = list(dict.fromkeys(s[i:i + 3] for i in range(len(s) - 2)))
    out = ANY
    for t in tris:
        out = both(out, Query("tri", (t,)))
    return out


def of_strings(strings: set[str]) -> Query:
    return either([of_string(s) for s in sorted(strings)])


def _chars(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is c.LITERAL:
            out.add(chr(arg).lower())
        elif op is c.RANGE and arg[1] - arg[0] < MAX_SET:
            out |= {chr(x).lower() for x in range(arg[0], arg[1] + 1)}
        else:
            return None
        if len(out) > MAX_LETTERS:
            return None
    return out


def _walk(items) -> tuple[set[str] | None, Query]:
    """(all strings, query): strings is None where the set is not known."""
    done: Query = ANY
    now: set[str] = {""}
    known = True  # the strings of the whole sequence are those in now
    for op, arg in items:
        query = ANY
        if op is c.LITERAL:
            strings = {chr(arg).lower()}
        elif op is c.IN:
            strings = _chars(arg)
        elif op is c.SUBPATTERN:
            strings, query = _walk(arg[3])
        elif op is c.BRANCH:
            got = [_walk(x) for x in arg[1]]
            strings = None if any(s is None for s, _ in got) else set().union(*(s for s, _ in got))
            query = either([q if s is None else both(q, of_strings(s)) for s, q in got]) if strings is None else ANY
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            low, high, inner = arg
            strings, query = _walk(inner)
            if strings is not None and high <= 4 and len(strings) ** max(high, 1) <= MAX_SET:
                strings = {"".join(x) for n in range(low, high + 1) for x in product(strings, repeat=n)}
            else:
                query = both(query, of_strings(strings)) if low and strings is not None else query if low else ANY
                strings = None
        elif op is c.AT or op in (c.ASSERT, c.ASSERT_NOT):
            continue
        else:
            strings = None
        done = both(done, query)
        if strings is not None and len(now) * len(strings) <= MAX_SET:
            now = {a + b for a in now for b in strings}
        else:
            done, known = both(done, of_strings(now)), False
            now = strings if strings is not None else {""}
    if known:
        return now, done
    return None, both(done, of_strings(now))


def derive(pattern: str) -> Query:
    """The query that each lower-cased text with a match satisfies; ANY if no trigram is mandatory."""
    strings, query = _walk(parser.parse(pattern))
    return query if strings is None else both(query, of_strings(strings))


def clauses(q: Query) -> list[frozenset[str]]:
    """Sets of trigrams, one of which each text that satisfies the query holds whole.

    A product that grows too large keeps its shorter side only: more texts pass, none is lost.
    """
    if q.op == "tri":
        return [frozenset(q.parts)]
    parts = [clauses(p) for p in q.parts]
    if q.op == "or":
        found = {x for part in parts for x in part}
    else:
        found = {frozenset()}
        for part in sorted(parts, key=len):
            grown = {a | b for a in found for b in part}
            found = grown if len(grown) <= MAX_SET else found
    return sorted((x for x in found if not any(y < x for y in found)), key=sorted)
