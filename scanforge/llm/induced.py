"""Suffix order and common prefixes of a shard by external induced sorting.

The shard is a string of small numbers in which every stretch is closed by an end mark (0) that no comparison passes.
Suffixes are large or small as they stand after or before the one to their right; small suffixes whose left neighbour
is large are the seeds.  One induction orders the pieces between seeds, equal pieces get one name, and the string of
names is sorted by the same procedure, spelled in two digits so that there is one queue for each digit.  A second
induction carries the seeds' order to all suffixes.

An induction scans suffixes in order and puts each one's left neighbour into the queue of the neighbour's symbol.  Tuples
enter a queue in the order in which they leave it, so a queue is a run that is appended to and read once; all of them
together hold ``buffer`` tuples in memory, the rest lies in scratch files of the task.  A tuple is a suffix with its common
prefix with the one queued before it: one more than the least common prefix that was scanned between their sources,
which is kept for every queue while scanning.  Equal pieces have an endless common prefix in the first induction; the
finite ones are those of different names, and the recursion adds the lengths of the names that agree.

The text, names and orders are arrays in memory up to ``buffer`` items and scratch files beyond it, read in slices, so
memory does not grow with the shard.
"""

from __future__ import annotations

import math
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

ENDLESS = 1 << 29
#: Strings of at most so many names are ordered at once, without another recursion.
FEW = 1 << 18
SLICE = 1 << 16
MARK, LARGE, SMALL = 0, 1, 2


class Scratch:
    """Arrays in memory up to ``buffer`` items, in files of a folder of the task beyond it."""

    def __init__(self, buffer: int):
        self.buffer, self.dir, self.files, self.spilled = max(buffer, 1), None, 0, 0

    def path(self) -> str:
        self.dir = self.dir or tempfile.mkdtemp(prefix="induced-")
        self.files += 1
        return os.path.join(self.dir, str(self.files))

    def array(self, n: int, dtype) -> np.ndarray:
        if n <= self.buffer:
            return np.zeros(n, dtype)
        self.spilled += n
        return np.memmap(self.path(), dtype, "w+", shape=(n,))

    def close(self) -> None:
        if self.dir:
            shutil.rmtree(self.dir, ignore_errors=True)


class Run:
    """Rows of int32 columns that are appended, then read by slices."""

    def __init__(self, scratch: Scratch, width: int):
        self.scratch, self.width, self.held, self.n, self.n_held, self.path = scratch, width, [], 0, 0, None

    def add(self, rows: np.ndarray) -> None:
        self.held.append(np.ascontiguousarray(rows, np.int32).reshape(-1, self.width))
        self.n += len(rows)
        self.n_held += len(rows)
        if self.n_held > self.scratch.buffer:
            self.flush()

    def flush(self) -> None:
        self.path = self.path or self.scratch.path()
        with open(self.path, "ab") as f:
            for x in self.held:
                x.tofile(f)
        self.scratch.spilled += self.n_held
        self.held, self.n_held = [], 0

    def done(self) -> np.ndarray:
        """All rows, as an array or a mapped file."""
        if self.path:
            self.flush()
            return np.memmap(self.path, np.int32, "r", shape=(self.n, self.width))
        return np.concatenate(self.held) if self.held else np.zeros((0, self.width), np.int32)


class Queues:
    """A queue of (suffix, common prefix) for each symbol, and the least common prefix scanned since its last tuple."""

    def __init__(self, scratch: Scratch, symbols: int):
        self.scratch, self.held, self.n = scratch, [[] for _ in range(symbols)], 0
        self.paths, self.read = {}, {}
        self.least = np.full(symbols, -1, np.int32)

    def put(self, symbol: np.ndarray, rows: np.ndarray) -> None:
        """``rows`` into the queues of ``symbol``, which is in order."""
        cut = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
        for c, a, b in zip(symbol[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(symbol)]):
            self.held[c].append(rows[a:b])
        self.n += len(symbol)
        if self.n > self.scratch.buffer:
            for c, parts in enumerate(self.held):
                if parts:
                    if c not in self.paths:
                        self.paths[c], self.read[c] = self.scratch.path(), 0
                    with open(self.paths[c], "ab") as f:
                        for x in parts:
                            np.ascontiguousarray(x, np.int32).tofile(f)
                    self.held[c] = []
            self.scratch.spilled += self.n
            self.n = 0

    def deal(self, symbol: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(symbol, kind="stable")
        if len(order):
            self.put(symbol[order], rows[order])

    def scan(self, lcp: np.ndarray, who: np.ndarray, symbol: np.ndarray, left: np.ndarray) -> None:
        """Suffixes with common prefixes ``lcp`` were scanned; those at ``who`` queue ``left`` under ``symbol``."""
        if not len(who):
            np.minimum(self.least, lcp.min(), out=self.least)
            return
        order = np.argsort(symbol, kind="stable")
        symbol, at = symbol[order], who[order]
        first = np.r_[True, symbol[1:] != symbol[:-1]]
        low = np.r_[0, at[:-1] + 1]
        low[first] = 0
        value = least_between(lcp, low, at)
        head = np.flatnonzero(first)
        own = symbol[head]
        value[head] = np.minimum(value[head], self.least[own])
        after = np.r_[np.minimum.accumulate(lcp[::-1])[::-1], np.int32(ENDLESS)]
        np.minimum(self.least, after[0], out=self.least)
        self.least[own] = after[at[np.r_[head[1:], len(at)] - 1] + 1]
        value = np.where(value < 0, 0, np.minimum(value + 1, ENDLESS))
        self.put(symbol, np.stack([left[order], value.astype(np.int32)], 1))

    def pop(self, c: int) -> np.ndarray | None:
        """The next rows of a queue, None if it is empty."""
        if c in self.paths:
            got = np.fromfile(self.paths[c], np.int32, 2 * SLICE, offset=8 * self.read[c]).reshape(-1, 2)
            self.read[c] += len(got)
            if len(got):
                return got
            os.remove(self.paths.pop(c))
        parts, self.held[c] = self.held[c], []
        if not parts:
            return None
        got = parts[0] if len(parts) == 1 else np.concatenate(parts)
        self.n -= len(got)
        return got


def least_between(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of x[low..high] for each pair."""
    out = np.empty(len(low), np.int32)
    step = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    for k in range(int(step.max()) + 1 if len(step) else 0):
        mine = np.flatnonzero(step == k)
        out[mine] = np.minimum(x[low[mine]], x[high[mine] - (1 << k) + 1])
        x = np.minimum(x[: -(1 << k)], x[1 << k :])
    return out


class Least:
    """Minima over ranges of a long array: of whole blocks by a table, of their ends by running minima."""

    BLOCK = 64

    def __init__(self, x: np.ndarray, scratch: Scratch):
        n, b = len(x), self.BLOCK
        blocks = -(-n // b)
        self.x, self.up, self.down = x, scratch.array(blocks * b, np.int32), scratch.array(blocks * b, np.int32)
        whole = np.full(blocks, ENDLESS, np.int32)
        wide = max(1, SLICE // b)
        for a in range(0, blocks, wide):
            part = np.full(min(wide, blocks - a) * b, ENDLESS, np.int32)
            own = x[a * b : a * b + len(part)]
            part[: len(own)] = own
            part = part.reshape(-1, b)
            self.up[a * b : a * b + part.size] = np.minimum.accumulate(part, 1).ravel()
            self.down[a * b : a * b + part.size] = np.minimum.accumulate(part[:, ::-1], 1)[:, ::-1].ravel()
            whole[a : a + len(part)] = part.min(1)
        self.whole = whole

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.minimum(self.down[low], self.up[high])
        a, b = low // self.BLOCK + 1, high // self.BLOCK - 1
        far = np.flatnonzero(a <= b)
        if len(far):
            out[far] = np.minimum(out[far], least_between(self.whole, a[far], b[far]))
        near = np.flatnonzero(a == b + 2)  # both ends in one block
        if len(near):
            at, stop = low[near], high[near]
            best = self.x[at].astype(np.int32)
            for _ in range(int((stop - at).max())):
                at = np.minimum(at + 1, stop)
                np.minimum(best, self.x[at], out=best)
            out[near] = best
        return out


def seed_places(text: np.ndarray) -> Iterator[np.ndarray]:
    """Rows (place, repetitions of its symbol) of the seeds and end marks, in text order."""
    n, a, was_small = len(text), 0, True
    while a < n:
        e = min(a + SLICE, n)
        while e < n and text[e] == text[e - 1]:
            e += 1
        x = np.asarray(text[a:e])
        stop = np.flatnonzero(np.r_[x[1:] != x[:-1], True])
        after = np.r_[x[stop[:-1] + 1], text[e] if e < n else 1]
        small = np.repeat(x[stop] < after, np.diff(np.r_[-1, stop]))
        seed = small & ~np.r_[was_small, small[:-1]]
        at = np.flatnonzero(seed | (x == 0))
        yield np.stack([at + a, stop[np.searchsorted(stop, at)] - at + 1], 1).astype(np.int32)
        was_small, a = bool(small[-1]), e


def run_length(text: np.ndarray, at: int) -> int:
    stop = at + 1
    while text[stop] == text[at]:
        stop += 1
    return stop - at


def seam(text: np.ndarray, a: int | None, b: int | None) -> int:
    """Common prefix of the last large and the first small suffix of a symbol."""
    return 0 if a is None or b is None else min(run_length(text, a), run_length(text, b))


def backwards(rows: np.ndarray, low: int, high: int, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows high-1 down to low; each gets the common prefix that the row above it names."""
    for b in range(high, low, -SLICE):
        a = max(low, b - SLICE)
        lcp = np.r_[rows[a + 1 : b, 1], first if b == high else rows[b, 1]].astype(np.int32)
        yield np.asarray(rows[a:b, 0])[::-1], lcp[::-1]


def induce(text: np.ndarray, symbols: int, seeds: np.ndarray, bounds: np.ndarray, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """All suffixes in order with their common prefixes, from ordered ``seeds``; ``bounds`` says where a symbol's begin."""
    large, large_at = Run(scratch, 2), [0]
    queue = Queues(scratch, symbols)

    def scanned(items: np.ndarray, lcp: np.ndarray, low: int, high: int) -> None:
        symbol = text[items - 1]
        who = np.flatnonzero((symbol >= low) & (symbol <= high))
        queue.scan(lcp, who, symbol[who], items[who] - 1)

    for c in range(symbols):
        last = None
        while (got := queue.pop(c)) is not None:
            large.add(got)
            scanned(got[:, 0], got[:, 1], c, symbols)
            last = int(got[-1, 0])
        large_at.append(large.n)
        for a in range(bounds[c], bounds[c + 1], SLICE):
            got = np.array(seeds[a : min(a + SLICE, bounds[c + 1])])
            if a == bounds[c]:
                got[0, 1] = seam(text, last, int(got[0, 0]))
            scanned(got[:, 0], got[:, 1], max(c, 1), symbols)
    large = large.done()
    small, small_at = Run(scratch, 2), {}
    queue = Queues(scratch, symbols)
    for c in range(symbols - 1, 0, -1):
        begin, last = small.n, None
        while (got := queue.pop(c)) is not None:
            small.add(got)
            scanned(got[:, 0], got[:, 1], 1, c)
            last = int(got[-1, 0])
        small_at[c] = (begin, small.n)
        low, high = large_at[c], large_at[c + 1]
        if low < high:
            for items, lcp in backwards(large, low, high, seam(text, int(large[high - 1, 0]), last)):
                scanned(items, lcp, 1, c - 1)
    small = small.done()
    for a in range(0, bounds[1], SLICE):
        got = np.asarray(seeds[a : min(a + SLICE, bounds[1])])
        yield got[:, 0], np.zeros(len(got), np.int32), MARK
    for c in range(1, symbols):
        for a in range(large_at[c], large_at[c + 1], SLICE):
            got = np.asarray(large[a : min(a + SLICE, large_at[c + 1])])
            yield got[:, 0], got[:, 1], LARGE
        low, high = small_at[c]
        if low < high:
            last = int(large[large_at[c + 1] - 1, 0]) if large_at[c] < large_at[c + 1] else None
            for items, lcp in backwards(small, low, high, seam(text, last, int(small[high - 1, 0]))):
                yield items, lcp, SMALL


def chosen(lcp: np.ndarray, at: np.ndarray, carry: int) -> tuple[np.ndarray, int]:
    """Common prefixes of the rows at ``at``, each with the chosen row before it, and what is carried to the next slice."""
    if not len(at):
        return np.zeros(0, np.int32), min(carry, int(lcp.min(initial=ENDLESS)))
    out = np.minimum.reduceat(lcp[: at[-1] + 1], np.r_[0, at[:-1] + 1])
    out[0] = min(int(out[0]), carry)
    return out, int(lcp[at[-1] + 1 :].min(initial=ENDLESS))


def suffixes(text: np.ndarray, symbols: int, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(suffixes, common prefix of each with the one before, kind) in order, in slices, end marks first.

    ``text`` has numbers below ``symbols`` and ends with a mark; marks differ from each other."""
    places, count, kinds = Run(scratch, 1), np.zeros(symbols, np.int64), np.zeros(0, np.int32)
    for rows in seed_places(text):
        places.add(rows[:, :1])
        count += np.bincount(text[rows[:, 0]], minlength=symbols)
        kinds = np.union1d(kinds, rows[:, 1])
    places, bounds = places.done()[:, 0], np.r_[0, np.cumsum(count)]
    # by symbol, and the more of it the smaller; those that stand alike count as equal
    by_run, by_symbol = Queues(scratch, len(kinds)), Queues(scratch, symbols)
    for rows in seed_places(text):
        by_run.deal(len(kinds) - 1 - np.searchsorted(kinds, rows[:, 1]), rows)
    for k in range(len(kinds)):
        while (rows := by_run.pop(k)) is not None:
            by_symbol.deal(text[rows[:, 0]], rows)
    seeds = Run(scratch, 2)
    for c in range(symbols):
        run = 0
        while (rows := by_symbol.pop(c)) is not None:
            before = np.r_[np.int32(run), rows[:-1, 1]]
            lcp = np.where(rows[:, 1] == before, ENDLESS, rows[:, 1])
            if not run or not c:
                lcp[: len(lcp) if not c else 1] = 0
            seeds.add(np.stack([rows[:, 0], lcp], 1))
            run = int(rows[-1, 1])
    # the pieces between seeds, in order; those with an endless common prefix are equal
    names, name_lcp, ordered, last, carry = scratch.array(len(places), np.int32), Run(scratch, 1), Run(scratch, 2), -1, ENDLESS
    for items, lcp, kind in induce(text, symbols, seeds.done(), bounds, scratch):
        if kind == LARGE:
            carry = min(carry, int(lcp.min()))
            continue
        own = np.arange(len(items)) if kind == MARK else np.flatnonzero(text[items - 1] > text[items])
        value, carry = chosen(lcp, own, carry)
        if len(own):
            fresh = value < ENDLESS
            name = last + np.cumsum(fresh)
            names[np.searchsorted(places, items[own])] = name
            name_lcp.add(value[fresh])
            ordered.add(np.stack([items[own], value], 1))
            last = int(name[-1])
    if last + 1 < len(places):
        ordered = by_names(places, names, last + 1, name_lcp.done()[:, 0], scratch)
    yield from induce(text, symbols, ordered.done(), bounds, scratch)


def by_names(places: np.ndarray, names: np.ndarray, kinds: int, name_lcp: np.ndarray, scratch: Scratch) -> Run:
    """Seeds in the order of the string of their names, with common prefixes in symbols of the text."""
    out, least, before = Run(scratch, 2), Least(name_lcp, scratch), np.zeros(0, np.int64)
    for at, agree in (at_once if len(names) <= FEW else by_digits)(names, kinds, scratch):
        prev = np.r_[before, at][-len(at) - 1 : -1].astype(np.int64)
        lcp = np.zeros(len(at), np.int32)
        here = slice(len(at) - len(prev), None)  # the first of all has none before it
        a, b = prev + agree[here], at[here] + agree[here]
        lcp[here] = places[b] - places[at[here]] + least.between(names[a].astype(np.int64) + 1, names[b].astype(np.int64))
        out.add(np.stack([places[at], lcp], 1))
        before = at[-1:]
    return out


def by_digits(names: np.ndarray, kinds: int, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The recursion: places in the string of names, in order, and how many names agree with the one before."""
    base = max(256, math.isqrt(kinds - 1) + 1)
    text = scratch.array(2 * len(names) + 1, np.int16)
    for a in range(0, len(names), SLICE):
        part = names[a : a + SLICE]
        text[2 * a : 2 * (a + len(part))] = np.stack([part // base, part % base], 1).ravel() + 1
    carry = ENDLESS
    for items, lcp, _ in suffixes(text, base + 1, scratch):
        own = np.flatnonzero((items % 2 == 0) & (items < 2 * len(names)))
        value, carry = chosen(lcp, own, carry)
        if len(own):
            yield items[own].astype(np.int64) // 2, value.astype(np.int64) // 2


def at_once(names: np.ndarray, kinds: int, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for few names, by doubling the compared length; the last name is the only one of its kind."""
    n, rank, step = len(names), np.asarray(names).astype(np.int64), 1
    while True:
        second = np.r_[rank[step:], np.full(min(step, n), -1)][:n]
        order = np.lexsort((second, rank))
        fresh = np.r_[False, (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n - 1:
            break
        step *= 2
    agree, live = np.zeros(n, np.int64), np.arange(1, n)
    a, b = order[:-1], order[1:]
    while len(live):
        live = live[names[a[live - 1] + agree[live]] == names[b[live - 1] + agree[live]]]
        agree[live] += 1
    yield order, agree


def repeated_starts(strings: list[np.ndarray], length: int, symbols: int, buffer: int = 1 << 20) -> tuple[list[tuple[int, int, int]], int]:
    """(string, first, last) of the runs of starts whose ``length`` symbols also start elsewhere; tuples and items spilled.

    ``strings`` have numbers from 1 to ``symbols`` - 1."""
    scratch = Scratch(buffer)
    try:
        size = np.array([len(s) for s in strings], np.int64)
        starts = np.r_[0, np.cumsum(size + 1)]
        text = scratch.array(int(starts[-1]), np.int16)
        for s, a in zip(strings, starts.tolist()):
            text[a : a + len(s)] = s
        hit, before = scratch.array(len(text), np.uint8), np.zeros(0, np.int32)
        for items, lcp, _ in suffixes(text, symbols, scratch) if strings else ():
            long = np.flatnonzero(lcp >= length)
            hit[items[long]] = 1
            hit[np.r_[before, items][long - 1 + len(before)]] = 1
            before = items[-1:]
        out: list[tuple[int, int, int]] = []
        for i, (a, b) in enumerate(zip(starts.tolist(), starts[1:].tolist())):
            edge = np.flatnonzero(np.diff(np.r_[0, hit[a:b], 0].astype(np.int8)))
            out += [(i, x, y - 1) for x, y in edge.reshape(-1, 2).tolist()]
        return out, scratch.spilled
    finally:
        scratch.close()
