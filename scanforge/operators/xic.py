"""Extracted time series: target discovery, band sums, metrics per target and file, gradients over rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import pearson
from .matching import band_join


def top_points(points: DataFrame, k: int = 80, by: str = "scan_idx") -> DataFrame:
    """The k most intense points of each scan (the lower position among equals)."""
    w = Window.partitionBy(by).orderBy(F.desc("intensity"), "pos")
    return points.where("intensity > 0").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def targets(points: DataFrame, k: int = 500, per_scan: int = 80, width: float = 0.01) -> DataFrame:
    """m/z buckets of the strongest points, ranked by summed intensity (lower m/z among equals)."""
    total = F.sum("intensity")
    found = top_points(points, per_scan).groupBy(F.rint(F.col("mz") / width).cast("long").alias("bucket")).agg(
        (F.sum(F.col("mz") * F.col("intensity")) / total).alias("target_mz"),
        (F.sum(F.col("rt") * F.col("intensity")) / total).alias("target_rt"),
        total.alias("signal"),
        F.count(F.lit(1)).alias("peaks"),
    )
    # only k rows are ranked, after a distributed top-k
    top = found.orderBy(F.desc(F.round("signal", 6)), "bucket").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("signal", 6)), "bucket")))


def extract(points: DataFrame, found: DataFrame, tol_ppm: float = 10.0) -> DataFrame:
    """Summed intensity of each (scan, target); scans without a point in the band give 0.

    Bands are met by bucketed equi-join, and sums aggregate before they are dealt.  The zero grid is scans x targets,
    the size of the result itself."""
    hits = band_join(points.select("scan_idx", "rt", "mz", "intensity"), F.broadcast(found.select("rank", "target_mz")), tol_ppm)
    sums = hits.groupBy("scan_idx", "rank").agg(F.sum("intensity").alias("s"))
    grid = points.select("scan_idx", "rt").distinct().crossJoin(F.broadcast(found.select("rank", "target_mz")))
    return grid.join(sums, ["scan_idx", "rank"], "left").withColumn("xic", F.coalesce("s", F.lit(0.0))).drop("s")


def area(by: list[str], value: str, rt: str = "rt") -> Column:
    """Summand of the trapezoid area over a window by scan."""
    w = Window.partitionBy(*by).orderBy("scan_idx")
    return F.coalesce((F.col(value) + F.lag(value).over(w)) / 2 * (F.col(rt) - F.lag(rt).over(w)), F.lit(0.0))


def target_metrics(both: DataFrame, by: list[str]) -> DataFrame:
    """Per target: areas, relative errors, correlation, shift of the apex.  ``both`` has xic_a and xic_b on one rt."""
    stepped = both.withColumn("_a", area(by, "xic_a")).withColumn("_b", area(by, "xic_b"))
    one = F.count(F.lit(1)) == 1
    total = lambda s: F.when(one, F.sum(f"xic_{s}")).otherwise(F.sum(f"_{s}"))
    apex = lambda s: F.min_by("rt", F.struct((-F.col(f"xic_{s}")).alias("v"), "scan_idx"))
    out = stepped.groupBy(*by).agg(
        total("a").alias("area_original"),
        total("b").alias("area_rebuilt"),
        F.sum("xic_a").alias("tic_a"),
        F.sum("xic_b").alias("tic_b"),
        pearson(F.col("xic_a"), F.col("xic_b"), 2, 1.0, 1.0, 0.0, clamp=True).alias("pearson"),
        (apex("b") - apex("a")).alias("apex_shift"),
    )
    base = lambda c: F.greatest(F.abs(F.col(c)), F.lit(1.0))
    signed = (F.col("area_rebuilt") - F.col("area_original")) / base("area_original")
    return out.withColumn("area_signed_rel_error", signed).withColumn("area_abs_rel_error", F.abs(signed)).withColumn("tic_abs_rel_error", F.abs(F.col("tic_b") - F.col("tic_a")) / base("tic_a")).drop("tic_a", "tic_b")


def summary(metrics: DataFrame, by: list[str]) -> DataFrame:
    e, r = "area_abs_rel_error", "pearson"
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("targets"), F.percentile(e, F.lit(0.5)).alias("area_median"), F.percentile(e, F.lit(0.95)).alias("area_p95"), F.max(e).alias("area_max"), F.percentile(r, F.lit(0.5)).alias("pearson_median"), F.percentile(r, F.lit(0.05)).alias("pearson_p05"), F.min(r).alias("pearson_min"), F.max(F.abs("apex_shift")).alias("apex_shift_max"))


def gradient(metrics: DataFrame, ks: list[int], by: list[str], rank: str = "rank") -> DataFrame:
    """The summary over targets with rank up to each k."""
    array = F.array(*(F.lit(k) for k in ks))
    return summary(metrics.withColumn("k", F.explode(F.filter(array, lambda k: k >= F.col(rank)))), [*by, "k"])
