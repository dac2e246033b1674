"""A bounded memo for functions of short strings, kept by each Python worker between batches."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """``memo[key]`` is ``f(key)``. At most about twice ``most`` values are kept: when the young half is
    full it becomes the old half, from which values in use come back. Only the speed depends on it."""

    def __init__(self, f: Callable, most: int):
        super().__init__()
        self.f, self.most, self.old = f, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.f(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
