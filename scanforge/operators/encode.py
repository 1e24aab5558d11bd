"""Encodings as columns: deltas, references, dictionaries, run lengths and their sizes, with inverses."""

from __future__ import annotations

import bz2
import time
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import bit_width, zigzag


def deltas(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """First and second differences (0 before the first) and their zigzag forms."""
    w = Window.partitionBy(*by).orderBy(*order)
    d1 = F.col(value) - F.lag(value, 1, 0).over(w)
    out = df.withColumn("delta", d1)
    out = out.withColumn("delta2", F.col("delta") - F.lag("delta", 1, 0).over(w))
    return out.withColumn("zz", zigzag(F.col("delta"))).withColumn("zz2", zigzag(F.col("delta2")))


def undelta(df: DataFrame, value: str, by: list[str], order: list[str], times: int = 1) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(times):
        df = df.withColumn(value, F.sum(value).over(w))
    return df


def zero_runs(df: DataFrame, value: str, by: list[str], order: str, least: int = 4) -> DataFrame:
    """Zero run-length form: runs of ``least`` zeros become (0, length); other zeros 1; a value v becomes v + 1."""
    w = Window.partitionBy(*by).orderBy(order)
    zero = (F.col(value) == 0).cast("int")
    numbered = df.withColumn("_z", zero).withColumn("_run", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*by, "_z").orderBy(order)))
    sized = numbered.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, "_z", "_run")))
    long = (F.col("_z") == 1) & (F.col("_n") >= least)
    low = F.min(order).over(Window.partitionBy(*by, "_z", "_run"))
    kept = sized.withColumn("_first", low).where(~long | (F.col(order) == F.col("_first")))
    codes = F.when(long, F.array(F.lit(0).cast("long"), F.col("_n"))).otherwise(F.array((F.col(value) + 1).cast("long")))
    return kept.select(*by, F.col(order), codes.alias("codes"))


def stream_sizes(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Estimated bytes of an integer stream: packed unsigned, dense zigzag, and sparse (places and values)."""
    v = F.col(value)
    n, nz = F.count(F.lit(1)), F.count(F.when(v != 0, 1))
    width = F.max(bit_width(zigzag(v.cast("long"))))
    size = lambda bits, k: (F.ceil(bits * k / 8.0) + 8).cast("long")
    out = df.groupBy(*by).agg(n.alias("n"), nz.alias("nonzero"), width.alias("bits"))
    out = out.withColumn("dense_bytes", size(F.col("bits"), F.col("n")))
    out = out.withColumn("sparse_bytes", (F.lit(12) + size(bit_width(F.col("n") - 1), F.col("nonzero")) + size(F.col("bits"), F.col("nonzero"))).cast("long"))
    return out.withColumn("best_bytes", F.least("dense_bytes", "sparse_bytes"))


def transform_choice(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """raw, delta or delta2, whichever packs smallest (the earlier one among equals)."""
    d = deltas(df, value, by, order)
    bits = lambda c: F.max(bit_width(c))
    out = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), bits(zigzag(F.col(value).cast("long"))).alias("raw_bits"), bits(F.col("zz")).alias("delta_bits"), bits(F.col("zz2")).alias("delta2_bits"))
    choice = F.array_min(F.array(*(F.struct(F.col(f"{k}_bits").alias("b"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(("raw", "delta", "delta2")))))["k"]
    return out.withColumn("choice", choice)


def sparse_stream(df: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """Non-zero values with the gap to the place before."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.where(F.col(value) != 0).withColumn("gap", F.col(order) - F.lag(order, 1, 0).over(w))


def reference_choice(islands: DataFrame, track: str = "track", order: str = "pos_in_track", codes: str = "codes", depth: int = 4) -> DataFrame:
    """For each island the best of the last ``depth`` islands of its track to code against, or none.

    A reference's length may differ by one; its estimated delta bytes must beat the island's own; among those the least
    (bytes, mean absolute delta, length difference, distance)."""
    w = Window.partitionBy(track).orderBy(order)
    own = F.col(codes)
    bytes_ = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.greatest(F.lit(1), F.ceil(bit_width(zigzag(x.cast("long"))) / 8.0).cast("int")))
    options = []
    for k in range(1, depth + 1):
        ref = F.lag(codes, k).over(w)
        padded = F.zip_with(own, F.slice(ref, F.lit(1), F.size(own)), lambda a, b: a - F.coalesce(b, F.lit(0)))
        apart = F.abs(F.size(own) - F.size(ref))
        mad = F.aggregate(padded, F.lit(0.0), lambda n, x: n + F.abs(x)) / F.size(own)
        fit = ref.isNotNull() & (apart <= 1) & (bytes_(padded) < bytes_(own))
        options.append(F.when(fit, F.struct(bytes_(padded).alias("bytes"), mad.alias("mad"), apart.alias("apart"), F.lit(k).alias("back"))))
    best = F.array_min(F.array(*options))
    return islands.withColumn("full_bytes", bytes_(own)).withColumn("reference", best)


def cross_candidates(islands: DataFrame, scan: str = "scan_idx", idx: str = "island_idx", n: str = "n_points", per_length: int = 4, keep: int = 4) -> DataFrame:
    """Earlier islands of the same scan with nearly equal length: the newest per length, then the nearest in length.

    Found by an equi-join on (scan, length) with the length posted to its two neighbours; bounded by ranks."""
    newest = Window.partitionBy(scan, idx, "ref_n").orderBy(F.desc("ref"))
    best = Window.partitionBy(scan, idx).orderBy("apart", F.desc("ref"))
    ref = islands.select(scan, F.col(idx).alias("ref"), F.col(n).alias("ref_n"))
    near = islands.select(scan, idx, n, F.explode(F.array(F.col(n) - 1, F.col(n), F.col(n) + 1)).alias("ref_n")).join(ref, [scan, "ref_n"]).where(F.col("ref") < F.col(idx))
    near = near.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= per_length).withColumn("apart", F.abs(F.col(n) - F.col("ref_n")))
    return near.withColumn("choice", F.row_number().over(best)).where(F.col("choice") <= keep).select(scan, idx, "ref", "apart", "choice")


def grid_model(islands: DataFrame, track: str = "track", order: str = "pos_in_track", grid: str = "mz_q") -> DataFrame:
    """How an island's quantised grid follows the one before in its track: same plus a constant, residuals, or raw."""
    prev = F.lag(grid).over(Window.partitionBy(track).orderBy(order))
    diff = F.zip_with(F.col(grid), prev, lambda a, b: a - b)
    flat = F.size(F.array_distinct(diff)) == 1
    same = prev.isNotNull() & (F.size(grid) == F.size(prev))
    spread = F.array_max(diff) - F.array_min(diff)
    cost_raw = bit_width(F.array_max(grid)) * F.size(grid)
    cost_res = bit_width(spread * 2) * F.size(grid) + 64
    return islands.withColumn("offset", F.when(same, F.element_at(diff, 1))).withColumn("model", F.when(same & flat, "PREV_OFFSET").when(same & (cost_res < cost_raw), "RESIDUAL").otherwise("RAW"))


def dictionary(points: DataFrame, window: list[str], mz_q: str = "mz_q", scan: str = "scan_idx") -> DataFrame:
    """Entries of a window: all points of equal quantised m/z, with count, sum and whether a scan repeats."""
    return points.groupBy(*window, mz_q).agg(F.count(F.lit(1)).alias("length"), F.sum("intensity").alias("total"), F.count_distinct(scan).alias("scans")).withColumn("repeats", F.col("scans") < F.col("length"))


def top_entries(entries: DataFrame, window: list[str], k: int = 96, least: int = 3, mz_q: str = "mz_q") -> DataFrame:
    w = Window.partitionBy(*window).orderBy(F.desc("length"), F.desc("total"), mz_q)
    return entries.where((~F.col("repeats")) & (F.col("length") >= least)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def follow_deltas(points: DataFrame, window: list[str], code: str, mz_q: str = "mz_q", scan: str = "scan_idx", order: str = "pos") -> DataFrame:
    """Inside an entry: gap in scans and difference of codes to the point before (null for the first)."""
    w = Window.partitionBy(*window, mz_q).orderBy(scan, order)
    return points.withColumn("scan_gap", F.col(scan) - F.lag(scan).over(w)).withColumn("code_delta", F.col(code) - F.lag(code).over(w))


def entry_classes(entries: DataFrame, window: list[str], k: int = 32, mz_q: str = "mz_q") -> DataFrame:
    """dense (top k), track (two points or more) or sparse."""
    top = top_entries(entries, window, k, 3, mz_q).select(*window, mz_q, F.lit(1).alias("_t"))
    return entries.join(top, [*window, mz_q], "left").withColumn("class", F.when(F.col("_t") == 1, "dense").when(F.col("length") >= 2, "track").otherwise("sparse")).drop("_t")


def offset_anchors(entries: DataFrame, window: list[str], mz_q: str = "mz_q") -> DataFrame:
    """Anchor and largest delta of each window's sorted dictionary; 64-bit values need no wrap at 2^32."""
    w = Window.partitionBy(*window).orderBy(mz_q)
    d = entries.withColumn("_d", F.col(mz_q) - F.lag(mz_q).over(w))
    return d.groupBy(*window).agg(F.min(mz_q).alias("anchor"), F.max("_d").alias("max_delta"), (F.max(mz_q) > 4294967295).alias("beyond_u32"))


def stack_blocks(points: DataFrame, scans: int = 256, scan: str = "scan_idx") -> DataFrame:
    """Points of a block of scans in one order by m/z, scan and place, with the scan as tag."""
    block = F.floor(F.col(scan) / scans).cast("long")
    w = Window.partitionBy("block").orderBy("mz_q", scan, "pos")
    return points.withColumn("block", block).withColumn("tag", F.col(scan) % scans).withColumn("place", F.row_number().over(w) - 1)


def codecs() -> dict:
    """Byte codecs at hand: name to (compress, decompress)."""
    out = {"zlib-6": (lambda b: zlib.compress(b, 6), zlib.decompress), "bz2-9": (lambda b: bz2.compress(b, 9), bz2.decompress)}
    try:
        import zstandard
    except ImportError:
        return out
    for level in (3, 9, 19):
        out[f"zstd-{level}"] = (lambda b, k=level: zstandard.ZstdCompressor(level=k).compress(b), lambda b: zstandard.ZstdDecompressor().decompress(b))
    return out


def compress(payload: Column, codec: str) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        f = codecs()[codec][0]
        return s.map(lambda b: None if b is None else f(bytes(b)))

    return run(payload)


def decompress(payload: Column, codec: str) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        f = codecs()[codec][1]
        return s.map(lambda b: None if b is None else f(bytes(b)))

    return run(payload)


def codec_benchmark(df: DataFrame, payload: str) -> DataFrame:
    """Per row and codec: bytes, ratio, seconds; a payload that does not come back is an error."""

    def run(batches):
        for part in batches:
            rows = []
            for b in part[payload]:
                b = bytes(b or b"")
                for name, (pack, unpack) in codecs().items():
                    t = time.perf_counter()
                    packed = pack(b)
                    t = time.perf_counter() - t
                    if unpack(packed) != b:
                        raise ValueError(f"{name} does not round-trip")
                    rows.append((name, len(b), len(packed), len(b) / max(1, len(packed)), t))
            yield pd.DataFrame(rows, columns=["codec", "raw_bytes", "packed_bytes", "ratio", "seconds"])

    return df.select(payload).mapInPandas(run, "codec string, raw_bytes long, packed_bytes long, ratio double, seconds double")


def pack_doubles(values: Column, planes: bool = False) -> Column:
    """array<double> as little-endian bytes, optionally transposed to byte planes."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        def one(v):
            raw = np.asarray(v, "<f8")
            return raw.view(np.uint8).reshape(-1, 8).T.tobytes() if planes and len(raw) else raw.tobytes()

        return s.map(one)

    return run(values)


def unpack_doubles(payload: Column, planes: bool = False) -> Column:
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        def one(b):
            raw = np.frombuffer(bytes(b), np.uint8)
            return np.ascontiguousarray(raw.reshape(8, -1).T if planes else raw).view("<f8").ravel().tolist()

        return s.map(one)

    return run(payload)


def decode_references(islands: DataFrame, file: str = "file_id") -> DataFrame:
    """Undo :func:`reference_choice` for whole files: islands refer to others by ``ref_idx`` before them.

    A reference is cut to the island's length.  Files are decoded in island order, so a file is one group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("island_idx")
        done: dict[int, np.ndarray] = {}
        out = []
        for i, ref, d in zip(group["island_idx"], group["ref_idx"], group["delta"]):
            d = np.asarray(d, np.int64).copy()
            if not pd.isna(ref):
                base = done[int(ref)][: len(d)]
                d[: len(base)] += base
            done[i] = d
            out.append(d.tolist())
        return pd.DataFrame({file: group[file], "island_idx": group["island_idx"], "codes": out})

    kind = islands.schema[file].dataType.simpleString()
    return islands.groupBy(file).applyInPandas(run, f"{file} {kind}, island_idx long, codes array<long>")


def dedupe_blobs(df: DataFrame, blob: str, order: str) -> DataFrame:
    """Each row with the digest of its blob, the first row that holds it, and whether it is that row."""
    digest = F.sha1(F.col(blob))
    first = df.groupBy(digest.alias("sha1")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))
    return df.withColumn("sha1", digest).join(first, "sha1").withColumn("kept", F.col(order) == F.col("first"))
