"""Gaps and islands inside scans: peak segmentation, features, residues.

Input is the ``points`` form (scan_idx, pos, mz, intensity; any columns in ``by`` lead the key).  Every step partitions
by scan, so one exchange serves the whole chain and no scan-sized state is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCAN = ["scan_idx"]


def runs(points: DataFrame, test: Column, by: list[str] = SCAN, name: str = "run") -> DataFrame:
    """Points that pass ``test``, with a number that is shared by maximal runs of neighbouring positions."""
    w = Window.partitionBy(*by).orderBy("pos")
    return points.where(test).withColumn(name, F.col("pos") - F.row_number().over(w))


def features(members: DataFrame, key: list[str]) -> DataFrame:
    """Per island: start, length, weighted centre, step, maximum and sum."""
    total = F.sum("intensity")
    return members.groupBy(*key).agg(
        F.min("pos").alias("array_start"),
        F.count(F.lit(1)).alias("n_points"),
        F.when(total > 0, F.sum(F.col("mz") * F.col("intensity")) / total).otherwise(F.avg("mz")).alias("center_mz"),
        F.min("mz").alias("mz_start"),
        F.max("intensity").alias("max_intensity"),
        total.alias("sum_intensity"),
    )


def islands_positive(points: DataFrame, by: list[str] = SCAN, least: int = 1) -> DataFrame:
    """Strategy A: maximal runs of positive intensity."""
    found = features(runs(points, F.col("intensity") > 0, by), [*by, "run"]).drop("run")
    return found.where(F.col("n_points") >= least)


def valley_flags(points: DataFrame, by: list[str] = SCAN) -> DataFrame:
    """Positions whose intensity is a strict minimum of order 2 and under 1 % of the larger neighbourhood maximum.

    Neighbour positions beyond the ends are clipped to the end points."""
    w = Window.partitionBy(*by).orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i = F.col("intensity")
    first, last = F.first("intensity").over(whole), F.last("intensity").over(whole)
    low = F.lit(True)
    for k in (1, 2):
        low = low & (i < F.coalesce(F.lag(i, k).over(w), first)) & (i < F.coalesce(F.lead(i, k).over(w), last))
    left, right = F.max(i).over(w.rowsBetween(-5, -1)), F.max(i).over(w.rowsBetween(1, 5))
    inner = F.lag(i).over(w).isNotNull() & F.lead(i).over(w).isNotNull()
    return points.withColumn("valley", inner & low & (i < F.greatest(left, right) * 0.01))


def islands_valley(points: DataFrame, by: list[str] = SCAN, least: int = 3) -> DataFrame:
    """Strategy B: cut at valleys, trim zeros at both ends, keep ``least`` points; uncovered positive runs come back.

    A valley opens the segment to its right; inner zeros stay.  Runs are added back only where an island survived."""
    w = Window.partitionBy(*by).orderBy("pos")
    cut = valley_flags(points, by).withColumn("segment", F.sum(F.col("valley").cast("int")).over(w))
    seg = Window.partitionBy(*by, "segment")
    positive = F.when(F.col("intensity") > 0, F.col("pos"))
    sized = cut.withColumn("_n", F.count(F.lit(1)).over(seg)).withColumn("_a", F.min(positive).over(seg)).withColumn("_b", F.max(positive).over(seg))
    keep = (F.col("_n") >= least) & F.col("pos").between(F.col("_a"), F.col("_b")) & (F.col("_b") - F.col("_a") + 1 >= least)
    marked = sized.withColumn("kept", F.coalesce(keep, F.lit(False)))
    marked = marked.withColumn("_any", F.max("kept").over(Window.partitionBy(*by)))
    main = features(marked.where("kept"), [*by, "segment"]).drop("segment")
    rest = runs(marked.where("_any and not kept"), F.col("intensity") > 0, by)
    return main.unionByName(features(rest, [*by, "run"]).drop("run"))


def zero_share(points: DataFrame, by: list[str] = SCAN) -> DataFrame:
    """Strategy choice: A for scans under three points or with more than a fifth of zeros."""
    share = F.avg((F.col("intensity") == 0).cast("double"))
    n = F.count(F.lit(1))
    return points.groupBy(*by).agg(n.alias("n_points"), share.alias("zero_fraction"), F.when((n < 3) | (share > 0.20), "A").otherwise("B").alias("strategy"))


def islands_auto(points: DataFrame, by: list[str] = SCAN) -> DataFrame:
    w = Window.partitionBy(*by)
    a = (F.count(F.lit(1)).over(w) < 3) | (F.avg((F.col("intensity") == 0).cast("double")).over(w) > 0.20)
    marked = points.withColumn("_a", a)
    return islands_positive(marked.where("_a").drop("_a"), by).unionByName(islands_valley(marked.where("not _a").drop("_a"), by))


def members(points: DataFrame, islands: DataFrame, by: list[str] = SCAN) -> DataFrame:
    """Points of each island, by exploding its positions (an equi-join, no range join)."""
    spans = islands.select(*by, "array_start", "n_points", F.explode(F.sequence("array_start", F.col("array_start") + F.col("n_points").cast("int") - 1)).alias("pos"))
    return points.join(spans, [*by, "pos"])


def orphans(points: DataFrame, islands: DataFrame, by: list[str] = SCAN) -> DataFrame:
    """Positive points that no island covers."""
    spans = islands.select(*by, F.explode(F.sequence("array_start", F.col("array_start") + F.col("n_points").cast("int") - 1)).alias("pos"))
    return points.where(F.col("intensity") > 0).join(spans, [*by, "pos"], "left_anti")


def complement(islands: DataFrame, sizes: DataFrame, by: list[str] = SCAN) -> DataFrame:
    """Runs of positions outside all islands: overlapping spans are merged by a running maximum, gaps lie between.

    ``sizes`` has the length ``n`` of every scan."""
    spans = islands.select(*by, F.col("array_start").alias("a"), (F.col("array_start") + F.col("n_points")).alias("b"))
    ends = sizes.select(*by, F.col("n").alias("a"), F.col("n").alias("b"))
    w = Window.partitionBy(*by).orderBy("a", "b")
    reach = F.coalesce(F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = spans.unionByName(ends).withColumn("gap_start", reach).withColumn("gap_points", F.col("a") - F.col("gap_start"))
    return out.where("gap_points > 0").select(*by, F.col("gap_start").cast("long").alias("gap_start"), F.col("gap_points").cast("long").alias("gap_points"))


def merge_adjacent(spans: DataFrame, by: list[str] = SCAN, start: str = "array_start", n: str = "n_points") -> DataFrame:
    """Join spans that begin where the one before ends; an overlap is an error."""
    w = Window.partitionBy(*by).orderBy(start)
    before = F.lag(F.col(start) + F.col(n)).over(w)
    checked = F.when(F.col(start) < before, F.raise_error(F.lit("spans overlap")).cast("int")).when(F.col(start) == before, 0).otherwise(1)
    numbered = spans.withColumn("_new", checked).withColumn("_run", F.sum("_new").over(w))
    return numbered.groupBy(*by, "_run").agg(F.min(start).alias(start), F.sum(n).alias(n), F.count(F.lit(1)).alias("members")).drop("_run")


def sparse_statistics(points: DataFrame, islands: DataFrame, by: list[str] = SCAN) -> DataFrame:
    """Zero share, islands a scan and share of one-point islands over a run, and whether they call for the bypass."""
    z = points.groupBy(*by).agg(F.avg((F.col("intensity") == 0).cast("double")).alias("z")).agg(F.avg("z").alias("avg_zero_fraction"), F.count(F.lit(1)).alias("scans"))
    i = islands.agg(F.count(F.lit(1)).alias("islands"), F.avg((F.col("n_points") <= 1).cast("double")).alias("short_fraction"))
    out = z.crossJoin(F.broadcast(i)).withColumn("islands_per_scan", F.col("islands") / F.col("scans"))
    return out.withColumn("bypass", (F.col("avg_zero_fraction") >= 0.35) & (F.col("islands_per_scan") >= 5000) & (F.col("short_fraction") >= 0.5))


def grid_consistency(pairs: DataFrame) -> DataFrame:
    """strict, relaxed or inconsistent, for matched islands with start and step on both sides."""
    start, step = F.abs(F.col("mz_start_a") - F.col("mz_start_b")), F.abs(F.col("mz_step_a") - F.col("mz_step_b"))
    return pairs.withColumn("grid", F.when((start < 1e-6) & (step < 1e-8), "strict").when(step < 1e-8, "relaxed").otherwise("inconsistent"))


def scatter(islands: DataFrame, grid: DataFrame, by: list[str] = SCAN) -> DataFrame:
    """Island intensities (array ``values``) back on the grid; positions without one are 0, overruns an error."""
    flat = islands.select(*by, F.posexplode("values").alias("_k", "_v"), "array_start").select(*by, (F.col("array_start") + F.col("_k")).alias("pos"), F.col("_v"))
    both = grid.join(flat, [*by, "pos"], "full")
    checked = F.when(F.col("mz").isNull(), F.raise_error(F.lit("island beyond its scan")).cast("double")).otherwise(F.coalesce("_v", F.lit(0.0)))
    return both.withColumn("intensity", checked).drop("_v")


def overlay(base: DataFrame, patch: DataFrame, by: list[str] = SCAN) -> DataFrame:
    """Intensities of ``patch`` (the last of repeated positions, by ``ord``) over those of ``base``."""
    last = patch.groupBy(*by, "pos").agg(F.max_by("intensity", "ord").alias("_p"))
    return base.join(last, [*by, "pos"], "left").withColumn("intensity", F.coalesce("_p", "intensity")).drop("_p")
