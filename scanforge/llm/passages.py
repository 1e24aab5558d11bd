"""Passages that repeat across documents, counted in words: a companion of the suffix-array dedup.

A 400-byte string need not be reached by a passage of a few dozen words.  This module says for each text how many of its
words lie in a run of ``WINDOW`` words that another text has too; nothing is removed by it.

Words are runs of anything but blanks.  A window is settled as in :mod:`suffix_dedup`, on words: it belongs to the
smallest hash of ``GRAM`` words inside (rightmost among equals), windows of an anchor that no second text has are settled,
equal stretches under an anchor collapse, and only windows of stretches that differ under a shared anchor are held against
each other, by the 126-bit hash of their words."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pin, unpin

WINDOW, GRAM = 50, 5
_draw = np.random.default_rng(50).integers(1, 1 << 62, 4, np.uint64) * np.uint64(2) + np.uint64(1)
#: Texts of up to so many bytes use tables of powers.
TABLE = 1 << 17
#: Multipliers of two polynomials over bytes and two over words, and their inverses modulo 2^64.
BASES = [int(x) for x in _draw]
INVERSES = [pow(b, -1, 1 << 64) for b in BASES]
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def powers(base: int, n: int) -> np.ndarray:
    """The first n + 1 powers of a base; those that most texts need are made once in a worker."""
    if n < TABLE:
        return table_of(base)[: n + 1]
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@functools.cache
def table_of(base: int) -> np.ndarray:
    out = np.full(TABLE, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(31)
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


class Sequence:
    """The words of a text, and hashes of any runs of them in constant time each."""

    def __init__(self, raw: memoryview, kinds: tuple[int, ...] = (0, 1)):
        x = np.frombuffer(raw, np.uint8)
        edge = np.flatnonzero(np.diff(np.r_[True, BLANK[x], True]))
        low, high = edge[::2], edge[1::2]
        self.n, size = len(low), (high - low).astype(np.uint64) << np.uint64(40)
        self.heads = {}
        for k in kinds:
            sums = np.zeros(len(x) + 1, np.uint64)
            np.cumsum((x.astype(np.uint64) + np.uint64(1)) * powers(BASES[k], len(x))[:-1], out=sums[1:])
            word = mixed((sums[high] - sums[low]) * powers(INVERSES[k], len(x))[low] ^ size)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(word * powers(BASES[2 + k], self.n)[:-1], out=sums[1:])
            self.heads[k] = (sums, powers(INVERSES[2 + k], self.n))

    def hashes(self, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
        """Of the words low..high-1 of each pair, by the k-th polynomial."""
        sums, back = self.heads[k]
        return mixed((sums[high] - sums[low]) * back[low] ^ (high - low).astype(np.uint64))


def halves(s: Sequence, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple((s.hashes(low, high, k) >> np.uint64(1)).view(np.int64) for k in (0, 1))


def stacked(parts: list[tuple], n: int) -> list[np.ndarray]:
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(n)]


def fields(rows, *names: str) -> list[np.ndarray]:
    """Columns of a list of structs."""
    own = rows.values
    held = dict(zip((f.name for f in own.type), own.flatten()))
    return [np.asarray(held[c]) for c in names]


def find(k1, k2, text):
    """Anchor hash, place, first and last window of each run of windows that share an anchor."""
    from .suffix_dedup import least_runs

    parts = []
    for a, b, t in zip(k1, k2, text):
        s = Sequence(memoryview(t.as_buffer()), (0,))
        if s.n >= WINDOW:
            at = np.arange(s.n - GRAM + 1)
            h = s.hashes(at, at + GRAM, 0)
            for place, low, high in least_runs(h, WINDOW - GRAM + 1):
                parts.append((np.full(len(place), a.as_py()), np.full(len(place), b.as_py()), h[place].view(np.int64), place, low, high))
    return stacked(parts, 6)


def stretches(k1, k2, text, spots):
    """The stretches of words that the runs of shared anchors cover: anchor, identity, first and last window."""
    parts = []
    for a, b, t, own in zip(k1, k2, text, spots):
        s = Sequence(memoryview(t.as_buffer()))
        low, high, h = fields(own, "low", "high", "h")
        parts.append((np.full(len(low), a.as_py()), np.full(len(low), b.as_py()), h, *halves(s, low, high + WINDOW), low, high))
    return stacked(parts, 7)


def windows(text, spots):
    """Every window of contested stretches: the stretch, the window's place in it, its hash, and whose the stretch is."""
    parts = []
    for t, own in zip(text, spots):
        s = Sequence(memoryview(t.as_buffer()))
        low, high, c1, c2, least, most = fields(own, "low", "high", "c1", "c2", "least", "most")
        many = high - low + 1
        of = np.repeat(np.arange(len(many)), many)
        shift = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        parts.append((c1[of], c2[of], shift, *halves(s, low[of] + shift, low[of] + shift + WINDOW), least[of], most[of]))
    return stacked(parts, 7)


def repeated_words(classes: DataFrame, cutting, mapped) -> DataFrame:
    """k1, k2 and n_repeated_words of each class of equal texts (k1, k2, x, m) that has any.

    ``cutting`` joins the texts with lists of places, ``mapped`` runs over slices of them (see ``suffix_dedup``)."""
    key, mark = ["k1", "k2"], ["c1", "c2"]

    def shared(rows: DataFrame, by: list[str], low: str = "k1", high: str = "k1") -> DataFrame:
        return pin(rows.groupBy(*by).agg(F.min(low).alias("least"), F.max(high).alias("most")).where("least <> most").select(*by), "shared")

    spots = pin(mapped(classes.select(*key, "x"), "k1 long, k2 long, h long, at long, low long, high long", find), "word_anchors")
    again = shared(spots, ["h"])
    own = cutting(spots.join(again.hint("merge"), "h"), ["low", "high", "h"], "k1 long, k2 long, h long, c1 long, c2 long, low long, high long", stretches)
    for held in (spots, again):
        unpin(held)
    place = F.min(F.struct("k1", "k2", "low", "high")).alias("at")
    distinct = pin(own.groupBy(*mark).agg(F.min("k1").alias("least"), F.max("k1").alias("most"), F.min("h").alias("h"), place), "distinct")
    several = pin(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "several")
    contested = distinct.join(several.hint("merge"), "h").select(*mark, "least", "most", "at.*")
    cut = cutting(contested, ["low", "high", *mark, "least", "most"], "c1 long, c2 long, shift long, w1 long, w2 long, least long, most long", windows, keyed=False)
    found = shared(cut, ["w1", "w2"], "least", "most")
    inner = cut.join(found.hint("merge"), ["w1", "w2"]).select(*mark, F.col("shift").alias("first"), F.col("shift").alias("last"))
    whole = distinct.where("least <> most").select(*mark, F.lit(0).cast("long").alias("first"), (F.col("at.high") - F.col("at.low")).alias("last"))
    runs = pin(inner.unionByName(whole), "runs")
    for held in (several, cut, found):
        unpin(held)
    ranges = own.join(runs.hint("merge"), mark).select(*key, (F.col("low") + F.col("first")).alias("a"), (F.col("low") + F.col("last") + WINDOW).alias("b"))
    listed = ranges.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("r"))
    zero = F.lit(0).cast("long")
    add = lambda acc, r: F.struct(F.greatest(acc["end"], r["b"]).alias("end"), (acc["n"] + F.greatest(zero, r["b"] - F.greatest(r["a"], acc["end"]))).alias("n"))
    out = pin(listed.select(*key, F.aggregate("r", F.struct(zero.alias("end"), zero.alias("n")), add, lambda acc: acc["n"]).alias("n_repeated_words")), "words")
    for held in (own, distinct, runs):
        unpin(held)
    return out
