"""Whether two small datasets are equal up to the names of blank nodes (for tests)."""

from __future__ import annotations

from itertools import permutations

Quad = tuple[str, str, str, str | None]


def _blanks(quads: set[Quad]) -> set[str]:
    return {t for q in quads for t in q if t and t.startswith("_:")}


def _colours(quads: set[Quad]) -> dict[str, int]:
    """Blank nodes by what surrounds them, refined until nothing changes."""
    colour = dict.fromkeys(_blanks(quads), 0)
    while True:
        seen = {b: hash((colour[b], tuple(sorted((tuple(("me" if t == b else str(colour[t])) if t in colour else t or "" for t in q)) for q in quads if b in q)))) for b in colour}
        if len(set(seen.values())) == len(set(colour.values())):
            return seen
        colour = seen


def isomorphic(a: set[Quad], b: set[Quad]) -> bool:
    if len(a) != len(b):
        return False
    ca, cb = _colours(a), _colours(b)
    if sorted(ca.values()) != sorted(cb.values()):
        return False
    groups = [([x for x in ca if ca[x] == c], [x for x in cb if cb[x] == c]) for c in sorted(set(ca.values()))]

    def search(i: int, names: dict[str, str]) -> bool:
        if i == len(groups):
            return {tuple(names.get(t, t) for t in q) for q in a} == b
        mine, theirs = groups[i]
        return any(search(i + 1, names | dict(zip(mine, p, strict=True))) for p in permutations(theirs))

    return search(0, {})
