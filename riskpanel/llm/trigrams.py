"""Boolean trigram queries derived from regular expressions.

A query is True (nothing is mandatory), a trigram, or ("and" | "or", parts). A text can only match an expression
if its lower-cased trigrams satisfy the query. Small sets of exact strings are carried through concatenation and
alternation; where a set grows too large or is open, what is known of its trigrams so far is kept.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from itertools import product

_MOST = 24  # exact strings that are carried along


class Part:
    """What is known of an expression: its exact strings, or else none, with a query that every match satisfies."""

    def __init__(self, exact: frozenset[str] | None, query=True):
        self.exact, self.query = exact, query

    def closed(self):
        """Query of the exact strings and the query already known."""
        return both(self.query, either([_of(x) for x in self.exact]) if self.exact is not None else True)


def _of(text: str):
    """All trigrams of a string; shorter strings demand nothing."""
    out = True
    for i in range(len(text) - 2):
        out = both(out, text[i : i + 3])
    return out


def both(a, b):
    if a is True or b is True:
        return b if a is True else a
    parts = []
    for x in (a, b):
        parts += x[1] if isinstance(x, tuple) and x[0] == "and" else [x]
    unique = list(dict.fromkeys(parts))
    return unique[0] if len(unique) == 1 else ("and", tuple(unique))


def either(parts: list):
    if any(p is True for p in parts):
        return True
    unique = list(dict.fromkeys(parts))
    return unique[0] if len(unique) == 1 else ("or", tuple(unique))


def _class(items) -> frozenset[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            out.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < _MOST:
            out.update(chr(i).lower() for i in range(value[0], value[1] + 1))
        else:
            return None
    return frozenset(out) if len(out) <= 8 else None


def _sequence(items) -> Part:
    done, now = True, frozenset([""])  # the query of what is closed, and the exact strings that end here
    for op, value in items:
        part = _item(op, value)
        if part.exact is None:
            done = both(both(done, Part(now).closed()), part.query)
            now = frozenset([""])
            continue
        done = both(done, part.query)
        joined = frozenset(x + y for x, y in product(now, part.exact))
        if len(joined) > _MOST:
            done = both(done, Part(now).closed())
            joined = part.exact
        now = joined
    if done is True:
        return Part(now)
    return Part(None, both(done, Part(now).closed()))


def _item(op, value) -> Part:
    if op is C.LITERAL:
        return Part(frozenset([chr(value).lower()]))
    if op is C.IN:
        return Part(_class(value))
    if op is C.SUBPATTERN:
        return _sequence(value[3])
    if op is C.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(p.exact is not None for p in parts):
            joined = frozenset().union(*[p.exact for p in parts])
            if len(joined) <= _MOST:
                return Part(joined)
        return Part(None, either([p.closed() for p in parts]))
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        least, most, inner = value
        part = _sequence(inner)
        if (least, most) == (0, 1) and part.exact is not None:
            return Part(part.exact | {""})
        if least == 0:
            return Part(None)
        return Part(None, part.closed())
    if op is C.AT:
        return Part(frozenset([""]))
    return Part(None)


def derive(expression: str):
    """The trigram query of an expression, over lower-cased text; True if it has no mandatory trigram."""
    return _sequence(parser.parse(expression)).closed()


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*[trigrams(p) for p in query[1]])


def alternatives(query) -> list[frozenset[str]]:
    """The query as alternative sets of trigrams that must all be present."""
    if query is True:
        return []
    if isinstance(query, str):
        return [frozenset([query])]
    if query[0] == "or":
        found = [x for p in query[1] for x in alternatives(p)]
    else:
        found = [frozenset().union(*xs) for xs in product(*[alternatives(p) for p in query[1]])]
    return [x for x in dict.fromkeys(found) if not any(y < x for y in found)]  # a larger set asks for no less
