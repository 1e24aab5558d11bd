"""Sections of a run: streams, sidecars, layouts, and encode/decode of whole scans as table transforms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import INT32_MAX, bit_width, zigzag
from .ranks import numbered


def split_overflow(df: DataFrame, value: str) -> DataFrame:
    """32-bit main values and, where they do not fit, a 0 with the value on a side list."""
    fits = F.col(value).between(-INT32_MAX - 1, INT32_MAX)
    return df.withColumn("main", F.when(fits, F.col(value)).otherwise(0).cast("int")).withColumn("overflow", F.when(~fits, F.col(value)))


def join_overflow(df: DataFrame) -> Column:
    return F.coalesce("overflow", F.col("main").cast("long"))


def pack_width(high: Column) -> Column:
    """1, 2, 4 or 8 bits where they hold the largest value, else its own width."""
    w = F.greatest(bit_width(high), F.lit(1))
    return F.when(w <= 2, w).when(w <= 4, 4).when(w <= 8, 8).otherwise(w)


def chunks(df: DataFrame, order: str, size: int) -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col(order) / size).cast("long"))


def stream_strategies(df: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """Estimated bytes of plain, zigzag, delta and zero-run forms of a stream, and the cheapest (earlier among equals)."""
    w = Window.partitionBy(*by).orderBy(order)
    d = zigzag(F.col(value) - F.lag(value, 1, 0).over(w))
    zero = (F.col(value) == 0).cast("int")
    run = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*by, "_z").orderBy(order))
    rows = df.withColumn("_z", zero).withColumn("_d", d).withColumn("_run", run)
    n_run = F.count(F.lit(1)).over(Window.partitionBy(*by, "_z", "_run"))
    rows = rows.withColumn("_codes", F.when((F.col("_z") == 1) & (n_run >= 4), 2.0 / n_run).otherwise(1.0))
    bytes_ = lambda bits, n: (8 + F.ceil(bits * n / 8.0)).cast("long")
    n = F.count(F.lit(1))
    out = rows.groupBy(*by).agg(
        bytes_(F.lit(32), n).alias("plain"),
        bytes_(F.max(bit_width(zigzag(F.col(value).cast("long")))), n).alias("packed"),
        bytes_(F.max(bit_width(F.col("_d"))), n).alias("delta"),
        bytes_(F.max(bit_width(F.col(value) + 1)), F.rint(F.sum("_codes"))).alias("zero_runs"),
    )
    names = ("plain", "packed", "delta", "zero_runs")
    best = F.array_min(F.array(*(F.struct(F.col(k).alias("b"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(names))))
    return out.withColumn("strategy", best["k"]).withColumn("bytes", best["b"])


def grid_library(islands: DataFrame, track: str, grid: str, order: str) -> DataFrame:
    """Equal grids of a track once: the first island that has it, for every island."""
    return islands.withColumn("library", F.min(order).over(Window.partitionBy(track, grid)))


def grid_sidecar(scans: DataFrame, grid: str, order: str, by: list[str]) -> DataFrame:
    """A scan's grid as first value and steps, whether steps need a sign, and whether it equals the scan before."""
    steps = F.zip_with(F.slice(grid, F.lit(2), F.size(grid)), F.slice(grid, F.lit(1), F.greatest(F.size(grid) - 1, F.lit(0))), lambda b, a: b - a)
    same = F.coalesce(F.col(grid) == F.lag(grid).over(Window.partitionBy(*by).orderBy(order)), F.lit(False))
    return scans.withColumn("first", F.get(grid, F.lit(0))).withColumn("steps", steps).withColumn("signed", F.exists("steps", lambda x: (x < 0) | (x > 4294967295))).withColumn("same_as_previous", same)


def from_steps(first: Column, steps: Column) -> Column:
    """A grid from its first value and steps."""
    start = F.struct(first.alias("at"), F.array(first).alias("out"))
    return F.aggregate(steps, start, lambda acc, s: F.struct((acc["at"] + s).alias("at"), F.concat(acc["out"], F.array(acc["at"] + s)).alias("out")), lambda acc: acc["out"])


def orphan_layouts(orphans: DataFrame, by: list[str]) -> DataFrame:
    """Bytes of orphan points as single points (8 each) and as runs (8 a run, 4 a point), and the smaller layout."""
    w = Window.partitionBy(*by).orderBy("pos")
    runs = orphans.withColumn("_r", F.col("pos") - F.row_number().over(w)).groupBy(*by, "_r").agg(F.count(F.lit(1)).alias("n"))
    out = runs.groupBy(*by).agg((F.sum("n") * 8).alias("point_bytes"), (F.count(F.lit(1)) * 8 + F.sum("n") * 4).alias("run_bytes"))
    return out.withColumn("layout", F.when(F.col("run_bytes") < F.col("point_bytes"), "runs").otherwise("points"))


def short_long(islands: DataFrame, track: str, short: int = 3) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(track))
    return islands.withColumn("track_length", n).withColumn("class", F.when(n <= short, "short").otherwise("long"))


def decode_dictionary(entries: DataFrame, window: list[str], mz_q: str = "mz_q", scan: str = "scan_idx") -> DataFrame:
    """Points from follow deltas (first value kept): running sums per entry, then scans with sorted arrays."""
    w = Window.partitionBy(*window, mz_q).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    points = entries.withColumn(scan, F.sum("scan_step").over(w)).withColumn("code", F.sum("code_step").over(w))
    z = F.array_sort(F.collect_list(F.struct(mz_q, "code")))
    return points.groupBy(*window, scan).agg(F.transform(z, lambda s: s[mz_q]).alias("mz_q"), F.transform(z, lambda s: s["code"]).alias("code"))


def section_baselines(scans: DataFrame, by: list[str], order: str, column: str) -> DataFrame:
    """Bytes of a section's doubles and of their zlib stream, compressed scan by scan in order, without holding them."""
    import zlib

    import numpy as np

    def run(group: pd.DataFrame) -> pd.DataFrame:
        z, raw, packed = zlib.compressobj(6), 0, 0
        for v in group.sort_values(order)[column]:
            b = np.asarray(v, "<f8").tobytes()
            raw += len(b)
            packed += len(z.compress(b))
        packed += len(z.flush())
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in by}, "raw_bytes": [raw], "zlib_bytes": [packed]})

    kinds = ", ".join(f"{k} {scans.schema[k].dataType.simpleString()}" for k in by)
    return scans.select(*by, order, column).groupBy(*by).applyInPandas(run, f"{kinds}, raw_bytes long, zlib_bytes long")


def breakdown(sections: DataFrame, by: list[str], name: str, size: str, whole: str, kinds: dict[str, str]) -> DataFrame:
    """Bytes by kind of section; what the sections leave of the whole counts as misc, never below 0."""
    pairs = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    kind = F.coalesce(F.try_element_at(pairs, F.col(name)), F.lit("misc"))
    names = sorted({*kinds.values(), "misc"})
    total = lambda k: F.coalesce(F.sum(F.when(kind == k, F.col(size))), F.lit(0))
    out = sections.groupBy(*by).agg(F.max(whole).alias("whole"), F.sum(size).alias("_known"), *(total(k).alias(k) for k in names))
    return out.withColumn("misc", F.col("misc") + F.greatest(F.lit(0), F.col("whole") - F.col("_known"))).drop("_known")


def balanced_batches(rows: DataFrame, size: str, tie: str, batch: int) -> DataFrame:
    """Batches of one of the largest with ``batch`` - 1 of the smallest, by rank from either end."""
    placed = numbered(rows, [F.desc(size), F.asc(tie)], name="_down")
    n = placed.agg(F.count(F.lit(1)).alias("_n"))
    down, up = F.col("_down"), F.col("_n") - 1 - F.col("_down")
    turn = F.when(down < F.ceil(F.col("_n") / batch), down).otherwise(F.floor(up / (batch - 1)))
    return placed.crossJoin(F.broadcast(n)).withColumn("batch", turn.cast("long")).drop("_down", "_n")


def first_existing(paths: DataFrame, key: list[str], path: str, root_order: str) -> DataFrame:
    return paths.groupBy(*key).agg(F.min_by(path, root_order).alias(path))


def keyed_by_content(df: DataFrame, columns: list[str]) -> DataFrame:
    """A digest of named columns, to recognise sections already made."""
    return df.withColumn("content_key", F.sha2(F.to_json(F.struct(*columns)), 256))
