"""Codecs end to end: tracks of islands, single scans and stacked scans as byte streams, and back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import encode


def pack_longs(values: Column, delta: bool = False) -> Column:
    """array<bigint> as little-endian bytes, of 32 bits where all fit (flagged by a first byte); ``delta`` keeps first
    value and differences."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        def one(v):
            x = np.asarray(v, np.int64)
            x = np.diff(x, prepend=0) if delta else x
            small = int(not len(x) or bool(x.min() >= -(1 << 31) and x.max() < 1 << 31))
            return bytes([small]) + x.astype("<i4" if small else "<i8").tobytes()

        return s.map(one)

    return run(values)


def unpack_longs(payload: Column, delta: bool = False) -> Column:
    @F.pandas_udf("array<bigint>")
    def run(s: pd.Series) -> pd.Series:
        def one(b):
            b = bytes(b)
            x = np.frombuffer(b, "<i4" if b[0] else "<i8", offset=1).astype(np.int64)
            return (np.cumsum(x) if delta else x).tolist()

        return s.map(one)

    return run(payload)


def cut(values: Column, sizes: Column) -> Column:
    """An array cut into pieces of given sizes."""

    @F.pandas_udf("array<array<bigint>>")
    def run(flat: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([[p.tolist() for p in np.split(np.asarray(x, np.int64), np.cumsum(k)[:-1])] if len(k) else [] for x, k in zip(flat, n)])

    return run(values, sizes)


def stream(values: Column, codec: str, delta: bool = False) -> Column:
    return encode.compress(pack_longs(values, delta), codec)


def unstream(payload: Column, codec: str, delta: bool = False) -> Column:
    return unpack_longs(encode.decompress(payload, codec), delta)


def encode_tracks(islands: DataFrame, track: str = "track", codec: str = "zlib-6") -> DataFrame:
    """Per track: where its islands lie, the stream of their m/z differences and the stream of their codes."""
    z = F.array_sort(F.collect_list(F.struct("pos_in_track", "scan_idx", "start", "mz_q", "codes")))
    one = islands.groupBy(track).agg(z.alias("z"))
    flat = lambda c: F.flatten(F.transform("z", lambda s: s[c]))
    members = F.transform("z", lambda s: F.struct(s["scan_idx"].alias("scan_idx"), s["start"].alias("start"), F.size(s["codes"]).alias("n")))
    return one.select(track, members.alias("members"), stream(flat("mz_q"), codec, True).alias("mz_bytes"), stream(flat("codes"), codec).alias("code_bytes"))


def decode_tracks(encoded: DataFrame, track: str = "track", codec: str = "zlib-6") -> DataFrame:
    """The islands again: scan_idx, start, mz_q and codes."""
    sizes = F.transform("members", lambda m: m["n"])
    back = encoded.select(track, "members", cut(unstream(F.col("mz_bytes"), codec, True), sizes).alias("m"), cut(unstream(F.col("code_bytes"), codec), sizes).alias("c"))
    each = back.select(track, F.posexplode(F.arrays_zip("members", "m", "c")).alias("k", "x"))
    return each.select(track, (F.col("k") + 1).alias("pos_in_track"), F.col("x.members.scan_idx").alias("scan_idx"), F.col("x.members.start").alias("start"), F.col("x.m").alias("mz_q"), F.col("x.c").alias("codes"))


def encode_scans(scans: DataFrame, codec: str = "zlib-6") -> DataFrame:
    """Each scan by itself: differences of its quantised m/z, and its codes."""
    return scans.select("scan_idx", stream(F.col("mz_q"), codec, True).alias("mz_bytes"), stream(F.col("codes"), codec).alias("code_bytes"))


def decode_scans(encoded: DataFrame, codec: str = "zlib-6") -> DataFrame:
    return encoded.select("scan_idx", unstream(F.col("mz_bytes"), codec, True).alias("mz_q"), unstream(F.col("code_bytes"), codec).alias("codes"))


def encode_stacks(points: DataFrame, scans: int = 256, codec: str = "zlib-6") -> DataFrame:
    """Blocks of scans in one order by m/z, with a tag that says which scan a point is from; a block is bounded."""
    block = F.floor(F.col("scan_idx") / scans).cast("long").alias("block")
    own = F.array_sort(F.collect_list(F.struct("mz_q", (F.col("scan_idx") % scans).alias("tag"), "pos", "code")))
    one = points.groupBy(block).agg(own.alias("z"))
    flat = lambda c: F.transform("z", lambda s: s[c].cast("long"))
    return one.select("block", stream(flat("mz_q"), codec, True).alias("mz_bytes"), stream(flat("tag"), codec).alias("tag_bytes"), stream(flat("code"), codec).alias("code_bytes"))


def decode_stacks(encoded: DataFrame, scans: int = 256, codec: str = "zlib-6") -> DataFrame:
    """Points again, in the order of the block: scan_idx, mz_q, code."""
    back = encoded.select("block", F.posexplode(F.arrays_zip(unstream(F.col("mz_bytes"), codec, True).alias("m"), unstream(F.col("tag_bytes"), codec).alias("t"), unstream(F.col("code_bytes"), codec).alias("c"))).alias("place", "x"))
    return back.select((F.col("block") * scans + F.col("x.t")).alias("scan_idx"), "place", F.col("x.m").alias("mz_q"), F.col("x.c").alias("code"))


def infer_start(grid: Column, target: Column, reach: int = 3) -> Column:
    """Where ``target`` lies in ``grid``: of the places up to ``reach`` from where its first value sorts, that with the
    least greatest difference (the first among equals)."""
    n, m = F.size(grid), F.size(target)
    pos = F.size(F.filter(grid, lambda x: x < F.get(target, F.lit(0))))
    low, high = F.greatest(F.lit(0), pos - reach), F.least(n - m, pos + reach)
    apart = lambda at: F.array_max(F.zip_with(F.slice(grid, at + 1, m), target, lambda x, y: F.abs(x - y)))
    best = F.array_min(F.transform(F.sequence(low, high), lambda at: F.struct(apart(at).alias("d"), at.alias("at"))))["at"]
    return F.when((m == 0) | (n < m), 0).when(low <= high, best).otherwise(F.greatest(F.lit(0), F.least(n - m, pos)))


def member_bytes(leader: Column, members: Column, shifts: Column, ratios: Column, codec: str = "zstd-9") -> Column:
    """Estimated bytes of a group's description: ids (plain or against the leader), shifts (one byte if all are 0, whole
    numbers in 16 bits) and ratios, each as a compressed stream."""

    @F.pandas_udf("long")
    def run(first: pd.Series, ids: pd.Series, moves: pd.Series, parts: pd.Series) -> pd.Series:
        pack = encode.codecs()[codec][0]
        size = lambda x: len(pack(x.tobytes()))

        def one(a, b, s, r):
            all_ = np.r_[a, np.asarray(b, np.int64)]
            plain = size(all_.astype(np.uint32))
            near = size(np.r_[a, all_[1:] - a].astype(np.int32)) if len(all_) > 1 else plain
            s, r = np.asarray(s, np.float64), np.asarray(r, np.float32)
            whole = bool((np.abs(s - np.rint(s)) <= 1e-9).all())
            moved = 0 if not len(s) else 1 if (np.abs(s) <= 1e-9).all() else size(np.rint(s).astype(np.int16) if whole else s.astype(np.float32))
            return min(plain, near) + moved + (size(r) if len(r) else 0)

        return pd.Series([one(*x) for x in zip(first, ids, moves, parts)])

    return run(leader, members, shifts, ratios)
