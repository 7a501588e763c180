"""External suffix sorting by induction, with common-prefix values.

The suffixes that begin at a left-most S position are named by their substrings and sorted by recursion on the names (in
memory by prefix doubling once the names fit in it). From them the L suffixes are induced in ascending order, and from those
the S suffixes in descending order. What is to be induced waits in a priority queue, as tuples of position and the rank of
the suffix that follows; its key is the first symbol, then that rank. Tuples come out of the queue in whole runs of equal
first symbol, so all work is done on arrays. The queue and the arrays go to disk where they pass the memory allowed, in a
scratch folder of the caller's that no other task reads.

The common prefix of two neighbours is carried along: one more than the least value between the ranks of the suffixes that
follow them; between the last L and the first S suffix of a symbol, the shorter of their runs of that symbol.
"""

from __future__ import annotations

import os
from collections import defaultdict

import numpy as np

BLOCK = 1024


class Scratch:
    """Arrays in memory, or mapped files beyond `memory` bytes in all."""

    def __init__(self, folder: str, memory: int):
        self.folder, self.memory, self.files, self.held = folder, memory, 0, 0

    def path(self) -> str:
        self.files += 1
        return os.path.join(self.folder, f"run-{os.getpid()}-{self.files}")

    def array(self, n: int, dtype) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if self.held + size <= self.memory or not n:
            self.held += size
            return np.zeros(n, dtype)
        return np.memmap(self.path(), dtype, "w+", shape=(n,))


class RunQueue:
    """Disk-backed priority queue of (position, rank) tuples by (symbol, order of arrival); ranks arrive in order, so a
    symbol's tuples come out sorted by rank. Beyond `memory` bytes, what waits is written out as runs."""

    def __init__(self, scratch: Scratch, memory: int):
        self.scratch, self.memory, self.held = scratch, memory, 0
        self.runs: dict[int, list] = defaultdict(list)

    def push(self, symbol: int, run: np.ndarray) -> None:
        self.runs[symbol].append(run)
        self.held += run.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        path, at = self.scratch.path(), 0
        with open(path, "wb") as f:
            for waiting in self.runs.values():
                for i, run in enumerate(waiting):
                    if isinstance(run, np.ndarray):
                        f.write(np.ascontiguousarray(run).data)
                        waiting[i] = (path, at, run.shape[1], run.dtype)
                        at += run.nbytes
        self.held = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All tuples that wait under the symbol now."""
        waiting = self.runs.pop(symbol, None)
        if not waiting:
            return None
        out = []
        for run in waiting:
            if isinstance(run, tuple):
                path, at, n, dtype = run
                run = np.fromfile(path, dtype, 2 * n, offset=at).reshape(2, n)
            else:
                self.held -= run.nbytes
            out.append(run)
        pos, rank = out[0] if len(out) == 1 else np.concatenate(out, axis=1)
        return pos, rank

    def spread(self, symbols: np.ndarray, pos: np.ndarray, rank: np.ndarray) -> None:
        if not len(pos):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, both = symbols[order], np.stack([pos[order], rank[order]])
        edges = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(pos)], strict=True):
            self.push(int(symbols[a]), both[:, a:b])


def least_between(lcp: np.ndarray, blocks: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(lcp[lo + 1 : hi + 1]) of each pair; the ranges follow each other. blocks: least value of each full block."""
    first, last = int(lo[0]), int(hi[-1])
    if last - first <= 20_000 * len(lo) + 65536:
        return np.minimum.reduceat(lcp[first + 1 : last + 1], lo - first)
    out = np.empty(len(lo), lcp.dtype)
    for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
        a, x, y = a + 1, -(-(a + 1) // BLOCK), (b + 1) // BLOCK
        if x >= y:
            out[i] = lcp[a : b + 1].min()
            continue
        least = blocks[x:y].min()
        if a < x * BLOCK:
            least = min(least, lcp[a : x * BLOCK].min())
        if y * BLOCK <= b:
            least = min(least, lcp[y * BLOCK : b + 1].min())
        out[i] = least
    return out


class _Minima:
    """Least value of each block of an array that is filled from one end."""

    def __init__(self, lcp: np.ndarray, down: bool):
        self.lcp, self.least, self.down = lcp, np.zeros(len(lcp) // BLOCK + 1, lcp.dtype), down
        self.done = (len(lcp) // BLOCK) if down else 0

    def upto(self, at: int) -> np.ndarray:
        """at: the first index not filled yet (down: the last)."""
        a, b = (-(-(at + 1) // BLOCK), self.done) if self.down else (self.done, at // BLOCK)
        if a < b:
            self.least[a:b] = self.lcp[a * BLOCK : b * BLOCK].reshape(-1, BLOCK).min(axis=1)
            self.done = a if self.down else b
        return self.least


def _types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each position is of type S; the end of its run of equal symbols."""
    n = len(text)
    ends = np.flatnonzero(np.concatenate([text[:-1] != text[1:], [True]]))
    rising = np.concatenate([text[ends[:-1]] < text[ends[:-1] + 1], [True]])
    size = np.diff(np.concatenate([[-1], ends]))
    assert size.sum() == n
    return np.repeat(rising, size), ends


def _names(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each LMS substring, compared by (symbol, type), six symbols at a time."""
    size = np.concatenate([np.diff(lms) + 1, [1]])
    names, todo, k, width = np.zeros(len(lms), np.int64), np.arange(len(lms)), 0, 6 if int(text.max()) < 512 else 2
    bits = 60 // width
    code = np.zeros(len(text) + width, np.uint16 if width == 6 else np.int64)  # no window of symbols ends behind it
    code[: len(text)] = text
    code[: len(text)] <<= 1
    code[: len(text)] += is_s
    while len(todo):
        key, at, left = np.zeros(len(todo), np.int64), lms[todo] + k, size[todo] - k
        for j in range(width):
            key <<= bits
            key |= code[at + j] * (left > j)
        order = np.lexsort((key, names[todo])) if k else np.argsort(key)
        own, key = names[todo][order], key[order]
        step = np.concatenate([[0], (own[1:] != own[:-1]) | (key[1:] != key[:-1])]) if len(own) else own
        # ranks stay those of the first of each old rank: new ranks count the members before
        group = np.cumsum(step)
        first = np.flatnonzero(np.concatenate([[True], step[1:] > 0]))
        start_of_old = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        base = np.repeat(start_of_old, np.diff(np.concatenate([start_of_old, [len(own)]])))
        names[todo[order]] = own + (first[group] - base)
        k += width
        count = np.diff(np.concatenate([first, [len(own)]]))[group]
        todo = np.sort(todo[order][(count > 1) & (size[todo[order]] > k)])
        # texts of equal rank that have ended are equal; those that go on differ from them by type, so none is lost
    held = np.zeros(len(lms), bool)
    held[names] = True
    dense = np.cumsum(held) - 1
    return dense[names], int(dense[-1]) + 1


def _order(key: np.ndarray, most: int) -> np.ndarray:
    """The places of the keys, none above most, in ascending order. Where they fit, a key and its place are one number, as numbers
    are sorted quicker than places."""
    bits = max(1, len(key) - 1).bit_length()
    if most.bit_length() + bits > 63:
        return np.argsort(key)
    return np.sort((key << bits) | np.arange(len(key))) & ((1 << bits) - 1)


def _doubling(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common prefixes, in symbols, of a string that ends in its unique least symbol. A rank is the place
    of the first of its equals, so places that are alone stay as they are and only the others are sorted on."""
    m, distinct = len(names), int(names.max(initial=0)) + 1
    twos = names.astype(np.int64) * (distinct + 1)  # each symbol with the next
    twos[:-1] += names[1:] + 1
    order = _order(twos, (distinct + 1) ** 2)
    twos, ones = twos[order], names[order]
    head = np.concatenate([[True], twos[1:] != twos[:-1]])
    first = np.maximum.accumulate(np.where(head, np.arange(m), 0))
    rank = np.empty(m, np.int32 if m < 1 << 31 else np.int64)
    rank[order] = first
    levels, h = [names, rank.copy()], 2
    parted = np.zeros(m, np.int8)  # the level that tells a place from the one before
    parted[1:][(ones[1:] == ones[:-1]) & head[1:]] = 1
    todo = np.flatnonzero(~(head & np.concatenate([head[1:], [True]])))  # places in order that share their rank
    while len(todo):
        pos, own = order[todo], first[todo]
        nxt = np.where(pos + h < m, rank[np.minimum(pos + h, m - 1)].astype(np.int64) + 1, 0)
        by = _order(own * (m + 1) + nxt, (m + 1) ** 2)
        pos, own, nxt = pos[by], own[by], nxt[by]
        head = np.concatenate([[True], (own[1:] != own[:-1]) | (nxt[1:] != nxt[:-1])])
        parted[todo[1:][(own[1:] == own[:-1]) & head[1:]]] = len(levels)
        order[todo] = pos
        own = np.maximum.accumulate(np.where(head, todo, 0))
        first[todo] = own
        rank[pos] = own
        levels.append(rank.copy())
        h *= 2
        todo = todo[~(head & np.concatenate([head[1:], [True]]))]
    # neighbours that part at level j share half of its symbols, and more as the levels below that half tell
    parted = parted[1:]
    a, b, common = order[:-1], order[1:], np.where(parted > 0, 1 << np.maximum(parted, 1).astype(np.int64) >> 1, 0)
    deep = np.flatnonzero(parted > 1)
    deep = deep[np.argsort(-parted[deep], kind="stable")]
    x, y, shares = a[deep] + common[deep], b[deep] + common[deep], np.zeros(len(deep), np.int64)
    ends = np.searchsorted(-parted[deep], -np.arange(2, len(levels) + 1), side="right")
    for k in range(len(levels) - 3, -1, -1):
        e = int(ends[k])
        same = (levels[k][x[:e] + shares[:e]] == levels[k][y[:e] + shares[:e]]).astype(np.int64)
        shares[:e] += same << k
    common[deep] += shares
    return order, np.concatenate([[0], common])


def suffix_sort(text: np.ndarray, scratch: Scratch, memory: int = 256 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and the common prefix of each suffix with the one before it. text ends in its unique least symbol, 0."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    kind = np.int32 if n < 2**31 - 1 else np.int64
    is_s, ends = _types(text)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    names, distinct = _names(text, is_s, lms)
    if len(lms) * 80 <= memory or distinct == len(lms):
        order, common = _doubling(names)
    else:
        order, common = suffix_sort(names, scratch, memory)
    seeds = lms[order]
    # common prefixes of the seeds in symbols of the text: whole substrings, then what the next two share
    shared = np.zeros(len(seeds), np.int64)
    if len(seeds) > 1:
        a, b = order[:-1], order[1:]
        whole = lms[a + common[1:]] - lms[a]
        x, y, act, more = lms[a] + whole, lms[b] + whole, np.arange(len(a)), 0
        while len(act):  # the last symbol stands once, so none goes on behind it
            same = text[x] == text[y]
            whole[act[~same]] += more
            act, x, y, more = act[same], x[same] + 1, y[same] + 1, more + 1
        shared[1:] = whole
    symbols = int(text.max()) + 1
    n_l = np.bincount(text[~is_s], minlength=symbols)
    n_seed = np.bincount(text[lms], minlength=symbols)
    n_all = np.bincount(text, minlength=symbols)
    run = lambda p: int(ends[np.searchsorted(ends, p)] - p + 1)

    # the symbol before each position, below zero for type S; -1: none
    lead = np.empty(n, np.int16 if symbols < 1 << 15 else np.int64)
    lead[0], lead[1:] = -1, text[:-1]
    np.invert(lead, out=lead, where=np.concatenate([[False], is_s[:-1]]))

    # L suffixes, ascending, among L and LMS suffixes
    size = int(n_l.sum() + n_seed.sum())
    pos, lcp = scratch.array(size, kind), scratch.array(size, kind)
    queue, minima = RunQueue(scratch, memory // 4), _Minima(lcp, False)
    at, seed = 0, 0
    l_start = np.zeros(symbols, np.int64)

    def l_before(places: np.ndarray, ranks: np.ndarray) -> None:
        before = lead[places]
        take = before >= 0
        queue.spread(before[take], places[take] - kind(1), ranks[take])

    for c in np.flatnonzero(n_all).tolist():
        l_start[c], last = at, None
        while (got := queue.pop(c)) is not None:
            p, succ = got
            k = len(p)
            pos[at : at + k] = p
            prev = np.concatenate([[succ[0] if last is None else last], succ[:-1]]).astype(np.int64)
            skip = 1 if last is None else 0
            if k > skip:
                lcp[at + skip : at + k] = 1 + least_between(lcp, minima.upto(at), prev[skip:], succ[skip:].astype(np.int64))
            last = int(succ[-1])
            at += k
            l_before(p, np.arange(at - k, at, dtype=kind))
        k = int(n_seed[c])
        if k:
            pos[at : at + k], lcp[at : at + k] = seeds[seed : seed + k], shared[seed : seed + k]
            lcp[at] = min(run(pos[at - 1]), run(pos[at])) if last is not None else 0
            at, seed = at + k, seed + k
            l_before(pos[at - k : at], np.arange(at - k, at, dtype=kind))

    # S suffixes, descending, among all
    sa, out = scratch.array(n, kind), scratch.array(n, kind)
    start = np.cumsum(n_all) - n_all
    for c in np.flatnonzero(n_l).tolist():
        sa[start[c] : start[c] + n_l[c]] = pos[l_start[c] : l_start[c] + n_l[c]]
        out[start[c] : start[c] + n_l[c]] = lcp[l_start[c] : l_start[c] + n_l[c]]
    queue, minima = RunQueue(scratch, memory // 4), _Minima(out, True)

    def s_before(places: np.ndarray, ranks: np.ndarray) -> None:
        before = lead[places]
        take = before < -1
        queue.spread(~before[take], places[take] - kind(1), ranks[take])

    for c in np.flatnonzero(n_all)[::-1].tolist():
        end = int(start[c] + n_all[c])  # the lowest filled slot of the bucket
        last = None
        while (got := queue.pop(c)) is not None:
            p, succ = got
            k = len(p)
            sa[end - k : end] = p[::-1]
            above = np.concatenate([[succ[0] if last is None else last], succ[:-1]]).astype(np.int64)
            skip = 1 if last is None else 0
            if k > skip:
                lo, hi = succ[skip:][::-1].astype(np.int64), above[skip:][::-1]
                # the slot above each of these gets its value now
                out[end - k + 1 : end + 1 - skip] = 1 + least_between(out, minima.upto(min(int(lo[0]), n - 1)), lo, hi)
            last = int(succ[-1])
            end -= k
            s_before(p, np.arange(end + k - 1, end - 1, -1, dtype=kind))
        if c == 0:
            sa[0] = n - 1
            break
        ls = int(n_l[c])
        if last is not None and ls:
            out[end] = min(run(sa[end - 1]), run(sa[end]))
        assert end == start[c] + ls
        if ls:
            s_before(sa[start[c] : end][::-1], np.arange(end - 1, start[c] - 1, -1, dtype=kind))
    return sa, out
