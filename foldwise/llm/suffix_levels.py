"""A logarithmic family of sparse suffix arrays over short pieces of text.

A piece has windows of ``length`` bytes that all hold one place of it, its anchor, and equal windows
hold it at the same distance.  So two orders tell all: that of the suffixes that begin at the anchors
and that of the prefixes, read backwards, that end there.  Windows are equal where the last bytes
before the anchor and the first ones after it are, and equal ones form blocks in either order, which
the common prefixes of neighbours bound.  A piece without an anchor has one at every window's start.

A level is a set of pieces in both orders.  A new batch gets its own, is merged with every existing
level in turn, which tells what both hold, and then joins levels of about its size, so n batches leave
about log n levels.  Everything stays in memory: the caller bounds what one family holds.
"""

from __future__ import annotations

import numpy as np

ROOM = 1 << 24


def _common(texts: list[bytes]) -> np.ndarray:
    """Length of the prefix that every text shares with the one before it (-1 for the first)."""
    out = np.full(len(texts), -1, np.int64)
    width = max(map(len, texts), default=0) or 1
    step = max(ROOM // width, 2)
    for first in range(0, len(texts) - 1, step):
        some = texts[first : first + step + 1]
        sizes = np.array([len(t) for t in some])
        grid = np.array(some, f"S{width}").view(np.uint8).reshape(len(some), width)
        other = grid[1:] != grid[:-1]
        alike = np.where(other.any(axis=1), other.argmax(axis=1), width)
        out[first + 1 : first + len(some)] = np.minimum(alike, np.minimum(sizes[1:], sizes[:-1]))
    return out


class Level:
    """Anchored pieces: bytes ``after`` and, backwards, ``before`` the anchor, ``near`` to ``far`` the windows' distances to it,
    ``ids`` of the windows at ``far`` and ``weight``; ``suffixes`` and ``prefixes`` are the two orders."""

    def __init__(self, after, before, near, far, ids, weight, length, suffixes=None, prefixes=None):
        self.after, self.before, self.length = after, before, length
        self.near, self.far, self.ids, self.weight = near, far, ids, weight
        self.suffixes = sorted(range(len(after)) if suffixes is None else suffixes, key=after.__getitem__)
        self.prefixes = sorted(range(len(before)) if prefixes is None else prefixes, key=before.__getitem__)

    @classmethod
    def of(cls, pieces: list[tuple], length: int) -> Level:
        rows = []
        for text, n, first, times, *anchor in pieces:
            if anchor:
                a = anchor[0]
                rows.append((text[a : a + length - (a - n + 1)], text[:a][::-1], a - n + 1, a, first, times))
            else:
                rows += [(text[k : k + length], b"", 0, 0, first + k, times) for k in range(n)]
        after, before, *numbers = zip(*rows, strict=True) if rows else [()] * 6
        return cls(list(after), list(before), *[np.array(x, np.int64) for x in numbers], length)

    def __len__(self) -> int:
        return int((self.far - self.near + 1).sum())

    def groups(self):
        """``(distance, rows, group of each)``: per distance the pieces with a window there, of which equal ones are of one group."""
        places = np.arange(len(self.after))
        at_suffix, at_prefix = np.empty_like(places), np.empty_like(places)
        at_suffix[self.suffixes], at_prefix[self.prefixes] = places, places
        alike_after, alike_before = _common([self.after[k] for k in self.suffixes]), _common([self.before[k] for k in self.prefixes])
        for distance in range(int(self.near.min()), int(self.far.max()) + 1) if len(places) else ():
            rows = np.flatnonzero((self.near <= distance) & (distance <= self.far))
            if len(rows):
                right = np.maximum.accumulate(np.where(alike_after < self.length - distance, places, 0))[at_suffix[rows]]
                left = np.maximum.accumulate(np.where(alike_before < distance, places, 0))[at_prefix[rows]]
                yield distance, rows, np.unique(left * len(places) + right, return_inverse=True)[1]

    def repeated(self) -> np.ndarray:
        """Ids of windows that this level holds twice or more, weights counted."""
        found = [np.empty(0, np.int64)]
        for distance, rows, group in self.groups():
            hit = rows[np.bincount(group, weights=self.weight[rows])[group] > 1]
            found.append(self.ids[hit] + self.far[hit] - distance)
        return np.concatenate(found)

    def shared(self, parts: int) -> np.ndarray:
        """Ids of windows that both the first ``parts`` pieces and the others hold."""
        found = [np.empty(0, np.int64)]
        for distance, rows, group in self.groups():
            one = np.bincount(group, weights=rows < parts)
            hit = rows[((one > 0) & (one < np.bincount(group)))[group]]
            found.append(self.ids[hit] + self.far[hit] - distance)
        return np.concatenate(found)

    def joined(self, other: Level) -> Level:
        """Both levels' pieces; sorted orders end to end are merged, not sorted anew."""
        n, both = len(self.after), lambda name: np.concatenate([getattr(self, name), getattr(other, name)])
        return Level(
            self.after + other.after, self.before + other.before, both("near"), both("far"), both("ids"), both("weight"), self.length,
            self.suffixes + [n + k for k in other.suffixes], self.prefixes + [n + k for k in other.prefixes],
        )


class Family:
    """Levels of falling size; :meth:`add` returns the ids of windows found to occur elsewhere too."""

    def __init__(self, length: int):
        self.length, self.levels = length, []

    def add(self, pieces: list[tuple]) -> np.ndarray:
        """``pieces``: (text, number of windows from its start, id of the first window, how often the piece occurs, anchor).

        The anchor is a place that all windows of the piece hold, at or after their start; equal windows must have it at
        the same distance.  It may be left out, for all pieces of a family or for none.
        """
        new = Level.of(pieces, self.length)
        found = [new.repeated()]
        found += [level.joined(new).shared(len(level.after)) for level in self.levels]
        while self.levels and len(self.levels[-1]) <= 2 * len(new):
            new = self.levels.pop().joined(new)
        self.levels.append(new)
        return np.unique(np.concatenate(found))
