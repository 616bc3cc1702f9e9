"""A memo of two generations with bounded size, kept for the life of a Python worker."""

from __future__ import annotations

from collections.abc import Callable


class Memo:
    """``young`` has what was asked for lately; when it is full it becomes ``old``, and what
    is asked for again comes back from there. Long keys count as several."""

    def __init__(self, size: int = 400_000):
        self.size, self.young, self.old, self.cost = size, {}, {}, 0

    def look_up(self, lists: list[list[str]], make: Callable[[list[str]], list[bytes]]) -> list[list[bytes]]:
        """The values of lists of keys; missing ones are made together."""
        if self.cost > self.size:
            self.old, self.young, self.cost = self.young, {}, 0
        get = self.young.get
        out = [list(map(get, keys)) for keys in lists]
        some = [(keys, values, [j for j, v in enumerate(values) if v is None]) for keys, values in zip(lists, out, strict=True) if None in values]
        missing = list({keys[j] for keys, _, at in some for j in at})
        if missing:
            old = list(map(self.old.get, missing))
            fresh = [k for k, v in zip(missing, old, strict=True) if v is None]
            self.young.update((k, v) for k, v in zip(missing, old, strict=True) if v is not None)
            self.young.update(zip(fresh, make(fresh), strict=True))
            self.cost += len(missing) + sum(map(len, fresh)) // 64
            for keys, values, at in some:
                for j in at:
                    values[j] = get(keys[j])
        return out


_memos: dict[object, Memo] = {}


def memo(key: object, size: int = 400_000) -> Memo:
    """The worker's memo of this key."""
    return _memos.setdefault(key, Memo(size))
