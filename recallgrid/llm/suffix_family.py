"""A logarithmic family of suffix arrays over strings that arrive in order.

Each level is a text and the sorted starts of its windows, a suffix array cut to
windows of one length that have not been seen before.  A new batch gets a suffix
array of its own, is merge-scanned against every level for windows they share,
and what is new in it becomes a level.  Levels of about equal size merge, so there
are logarithmically many.
"""

from __future__ import annotations

import numpy as np

SLICE = 65_536  # windows whose bytes are side by side at a time


class Level:
    def __init__(self, text: np.ndarray, starts: np.ndarray, width: int):
        self.text, self.starts, self.width = text, starts, width

    def __len__(self) -> int:
        return len(self.starts)

    def keys(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """The windows themselves, from the a-th to the b-th in order."""
        return windows(self.text, self.starts[a:b], self.width)

    def scan(self, keys: np.ndarray, found: np.ndarray) -> None:
        """Mark those of the sorted ``keys`` that this level holds: both sides advance together."""
        at = 0
        for a in range(0, len(self), SLICE):
            held = self.keys(a, a + SLICE)
            end = int(np.searchsorted(keys, held[-1], side="right"))
            if end > at:
                part = keys[at:end]
                found[at:end] |= held[np.searchsorted(held, part)] == part
                at = end

    def merge(self, other: Level) -> Level:
        """Both levels as one; they share no window."""
        places = np.empty(len(other), np.int64)
        at = 0
        keys = other.keys()
        for a in range(0, len(self), SLICE):
            held = self.keys(a, a + SLICE)
            end = int(np.searchsorted(keys, held[-1], side="right"))
            places[at:end] = a + np.searchsorted(held, keys[at:end])
            at = end
        places[at:] = len(self)
        starts = np.insert(self.starts, places, other.starts + len(self.text))
        return Level(np.concatenate([self.text, other.text]), starts, self.width)


def windows(text: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Windows as fixed-length byte strings, which sort as bytes do."""
    if not len(starts):
        return np.zeros(0, f"S{width}")
    views = np.lib.stride_tricks.sliding_window_view(text, width)[starts]
    return np.ascontiguousarray(views).view(f"S{width}").ravel()


class Family:
    def __init__(self, width: int):
        self.width = width
        self.levels: list[Level] = []

    def add(self, strings: list[bytes]) -> list[np.ndarray]:
        """For every string, which of its windows stand earlier: in older batches, or before in this one."""
        text = np.frombuffer(b"".join(strings), np.uint8)
        sizes = np.array([max(0, len(s) - self.width + 1) for s in strings], np.int64)
        firsts = np.cumsum([0, *map(len, strings)])[:-1]
        ends = np.cumsum(sizes)
        starts = np.repeat(firsts - (ends - sizes), sizes) + np.arange(sizes.sum())
        keys = windows(text, starts, self.width)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        repeated = np.zeros(len(keys), bool)
        repeated[1:] = keys[1:] == keys[:-1]  # equal windows are in order of arrival
        seen = repeated.copy()
        for level in self.levels:
            level.scan(keys, seen)
        earlier = np.zeros(len(keys), bool)
        earlier[order] = seen
        if not seen.all():
            self.levels.append(Level(text, starts[order[~seen]], self.width))
            while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
                newer, older = self.levels.pop(), self.levels.pop()
                self.levels.append(older.merge(newer))
        return np.split(earlier, ends[:-1])
