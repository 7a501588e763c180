"""Edit distances of many strings to many others: Myers' bit vectors in Hyyrö's form, one column for all patterns at a time.

A pattern is a column of 64-bit words, a bit for each of its characters. The texts go in order, and the columns after each
character of a text are kept, so a text goes on from where it parts from the one before. Neighbours in the order go together
against the patterns that character counts allow for one of them, where the counts rule enough of them out. Characters are
code points. Strings of any length: longer patterns take more words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from lacewing.plans.budget import max_edits

WIDE = 8192  # patterns that go together: a step over fewer costs mostly its calls
HELD, TOGETHER = WIDE, 32  # patterns of which some are chosen, for so many texts
SHARE = 0.7  # of the patterns: where more are chosen, all are taken
BUCKETS, BITS = 61, 4  # character counts, each up to BITS in unary
MOST = 32 << 20  # bytes that the columns of one text, or the places of characters, may take
_ONE, _TOP = np.uint64(1), np.uint64(63)


def code_points(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and the length of each string."""
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4"), np.array(list(map(len, strings)), np.int64)


class Patterns:
    """Some strings, as bit vectors: for each character the places where it stands."""

    def __init__(self, strings: list[str]):
        points, self.lengths = code_points(strings)
        self.n, self.words = len(strings), max(1, -(-int(self.lengths.max(initial=0)) // 64))
        row = np.repeat(np.arange(self.n), self.lengths)
        place = np.arange(len(points)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        chars, which = np.unique(points, return_inverse=True)
        self.rows = {chr(c): k for k, c in enumerate(chars.tolist())}
        self.table = np.zeros((len(chars) + 1, self.words, self.n), np.uint64)  # the last row: other characters
        np.bitwise_or.at(self.table, (which, place // 64, row), _ONE << (place % 64).astype(np.uint64))
        held = np.clip(self.lengths - 64 * np.arange(self.words)[:, None], 0, 64)
        self.mask = np.where(held == 64, ~np.uint64(0), (_ONE << (held % 64).astype(np.uint64)) - _ONE)

    def take(self, some: np.ndarray) -> Patterns:
        out = object.__new__(Patterns)
        out.n, out.words, out.rows = len(some), self.words, self.rows
        out.table, out.mask, out.lengths = np.take(self.table, some, 2), np.take(self.mask, some, 1), self.lengths[some]
        return out


class Sketches:
    """Character counts of some strings. One edit takes away one at most, and brings one at most."""

    def __init__(self, strings: list[str]):
        points, lengths = code_points(strings)
        where = np.repeat(np.arange(len(strings)), lengths) * BUCKETS + points % BUCKETS
        counts = np.minimum(np.bincount(where, minlength=len(strings) * BUCKETS).reshape(-1, BUCKETS), BITS).astype(np.uint64)
        unary = (_ONE << counts) - _ONE
        each = 64 // BITS
        self.bits = np.array([np.bitwise_or.reduce(unary[:, a : a + each] << (np.uint64(BITS) * np.arange(unary[:, a : a + each].shape[1], dtype=np.uint64)), axis=1) for a in range(0, BUCKETS, each)])
        self.total = counts.sum(axis=1).astype(np.int16)

    def allowed(self, other: Sketches, i: int, twice: np.ndarray) -> np.ndarray:
        """Which strings are within half of `twice` edits of the other's i-th, as far as the counts tell."""
        differ = np.abs(self.total - other.total[i])
        for mine, its in zip(self.bits, other.bits[:, i], strict=True):
            differ += np.bitwise_count(mine ^ its)
        return differ <= twice


class Columns:
    """The columns of the distance table after each character of a text."""

    def __init__(self, patterns: Patterns, room: np.ndarray):
        self.p = patterns
        size = patterns.words * patterns.n
        at = room.shape[1] // size
        self.up, self.down = (x[: at * size].reshape(at, patterns.words, patterns.n) for x in room)  # where a cell is one more, one less than that above
        self.up[0], self.down[0] = ~np.uint64(0), 0
        self.x, self.h, self.t = (np.empty(patterns.n, np.uint64) for _ in range(3))

    def to(self, text: str, shared: int) -> np.ndarray:
        """The distances of all patterns to this text, whose first `shared` characters are those of the text before."""
        for d in range(shared, len(text)):
            self._step(self.p.table[self.p.rows.get(text[d], -1)], d)
        up, down = (np.bitwise_count(v[len(text)] & self.p.mask).sum(axis=0, dtype=np.int64) if self.p.words > 1 else np.bitwise_count(v[len(text), 0] & self.p.mask[0]).astype(np.int16) for v in (self.up, self.down))
        return len(text) + up - down

    def _step(self, places: np.ndarray, d: int) -> None:
        x, h, t = self.x, self.h, self.t
        more, less = _ONE, None  # whether the row above the word grows or falls here: the topmost grows
        for w in range(self.p.words):
            eq, up, down, new_up, new_down = places[w], self.up[d, w], self.down[d, w], self.up[d + 1, w], self.down[d + 1, w]
            np.bitwise_or(eq, down, out=x)
            if less is not None:
                eq = eq | less
            np.bitwise_and(eq, up, out=h)
            h += up
            h ^= up
            h |= eq
            np.bitwise_or(h, up, out=t)
            np.invert(t, out=t)
            t |= down  # grows to the right
            h &= up  # falls to the right
            after = None if w == self.p.words - 1 else (t >> _TOP, h >> _TOP)
            t += t
            t |= more
            h += h
            if less is not None:
                h |= less
            np.bitwise_and(t, x, out=new_down)
            x |= t
            np.invert(x, out=x)
            np.bitwise_or(x, h, out=new_up)
            if after:
                more, less = after


def shared_starts(strings: list[str]) -> list[int]:
    """How many characters each string has in common with the one before, from their start."""
    out = [0]
    for a, b in zip(strings, strings[1:]):
        n = min(len(a), len(b))
        k = next((i for i in range(n) if a[i] != b[i]), n)
        out.append(k)
    return out[: len(strings)]


def near(texts: list[str], patterns: list[str], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, pattern, distance) of all within the threshold, by their places in the lists. Memory: a few times MOST."""
    if not texts or not patterns:
        return
    order = sorted(range(len(texts)), key=texts.__getitem__)
    ordered = [texts[i] for i in order]
    shared, longest = shared_starts(ordered), max(map(len, ordered))
    budget = np.array([max_edits(n, threshold) for n in range(max(longest, max(map(len, patterns))) + 1)], np.int16)
    words = max(1, -(-max(map(len, patterns)) // 64))
    wide, at = max(16, min(WIDE, MOST // (16 * words * (longest + 1)))), 0
    many, room = HELD // WIDE * wide, np.empty((2, (longest + 1) * words * wide), np.uint64)
    own, limits = Sketches(ordered), 2 * budget[list(map(len, ordered))]
    while at < len(patterns):
        while many > 16 and 8 * words * many * len(set().union(*patterns[at : at + many])) > MOST:
            many //= 2
        held, counts = Patterns(patterns[at : at + many]), Sketches(patterns[at : at + many])
        twice = 2 * budget[held.lengths]

        def chosen(lo: int) -> np.ndarray:
            out = np.zeros(held.n, bool)  # noqa: B023
            for i in range(lo, min(lo + TOGETHER, len(ordered))):
                out |= counts.allowed(own, i, np.maximum(twice, limits[i]))  # noqa: B023
            return out

        step = TOGETHER
        tried = range(0, len(ordered), max(TOGETHER, len(ordered) // 8))
        if sum(chosen(lo).sum() for lo in tried) > SHARE * held.n * len(tried):
            step = len(ordered)
        for lo in range(0, len(ordered), step):
            some = np.arange(held.n) if step > TOGETHER else np.flatnonzero(chosen(lo))
            for a in range(0, len(some), wide):
                part = some[a : a + wide]
                mine = held.take(part)
                columns, most = Columns(mine, room), twice[part] // 2
                for i, text, k in zip(order[lo : lo + step], ordered[lo : lo + step], [0, *shared[lo + 1 : lo + step]], strict=True):
                    d = columns.to(text, k)
                    hit = np.flatnonzero(d <= np.maximum(most, budget[len(text)]))
                    if len(hit):
                        yield np.full(len(hit), i), part[hit] + at, d[hit]
        at += held.n
