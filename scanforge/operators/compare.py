"""Round-trip comparison of two streams of scans and its roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import relative_error

MZ_CEILING, INTENSITY_CEILING, INTENSITY_CEILING_F32, SLACK = 5e-7, 0.05, 0.1, 1e-10


def align(a: DataFrame, b: DataFrame, by: list[str], order: str) -> DataFrame:
    """Scans of both sides by ordinal; either may be missing.  Columns get the suffixes _a and _b."""
    w = Window.partitionBy(*by).orderBy(order)
    left = a.withColumn("ord", F.row_number().over(w) - 1)
    right = b.withColumn("ord", F.row_number().over(w) - 1)
    named = lambda df, s: df.select(*by, "ord", *(F.col(c).alias(c + s) for c in df.columns if c not in (*by, "ord")))
    return named(left, "_a").join(named(right, "_b"), [*by, "ord"], "full").withColumn("missing_a", F.col("mz_a").isNull()).withColumn("missing_b", F.col("mz_b").isNull())


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda n, x: n + x)


def spectrum_errors(pairs: DataFrame) -> DataFrame:
    """Per pair of scans: maximal and mean errors over the points both have, TIC, base peak, non-zero counts.

    Computed on the arrays themselves, without exploding points; percentiles sort the array of errors."""
    apart = lambda c: F.zip_with(F.slice(f"{c}_a", F.lit(1), F.col("n")), F.slice(f"{c}_b", F.lit(1), F.col("n")), lambda x, y: F.abs(x - y))
    n = F.least(F.size("mz_a"), F.size("mz_b"))
    rel = F.filter(F.zip_with(F.slice("intensity_a", F.lit(1), F.col("n")), F.slice("intensity_b", F.lit(1), F.col("n")), lambda x, y: F.when(x != 0, F.abs(x - y) / F.abs(x))), lambda x: x.isNotNull())
    out = pairs.where("not missing_a and not missing_b").withColumn("n", n)
    out = out.withColumn("_m", apart("mz")).withColumn("_i", apart("intensity")).withColumn("_r", rel)
    for name, col in (("mz", "_m"), ("intensity", "_i"), ("relative", "_r")):
        size = F.size(col)
        out = out.withColumn(f"max_{name}_error", F.coalesce(F.array_max(col), F.lit(0.0)))
        out = out.withColumn(f"mean_{name}_error", F.when(size > 0, _sum(F.col(col)) / size).otherwise(0.0))
        out = out.withColumn(f"p95_{name}_error", array_percentile(F.col(col), 0.95))
    for side in "ab":
        out = out.withColumn(f"tic_{side}", _sum(F.col(f"intensity_{side}"))).withColumn(f"bpi_{side}", F.coalesce(F.array_max(f"intensity_{side}"), F.lit(0.0)))
        out = out.withColumn(f"nonzero_{side}", F.size(F.filter(f"intensity_{side}", lambda x: x != 0)))
    out = out.withColumn("tic_error", relative_error(F.col("tic_a"), F.col("tic_b"))).withColumn("bpi_error", relative_error(F.col("bpi_a"), F.col("bpi_b")))
    return out.withColumn("same_length", F.size("mz_a") == F.size("mz_b")).drop("_m", "_i", "_r")


def array_percentile(xs: Column, p: float) -> Column:
    """Linear-interpolation percentile of an array; 0 if empty."""
    s = F.array_sort(xs)
    at = (F.size(xs) - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(xs) - 1))
    return F.when(F.size(xs) > 0, a + (b - a) * (at - low)).otherwise(0.0)


def rollup(pairs: DataFrame, errors: DataFrame, by: list[str]) -> DataFrame:
    """Per file: counters of structural mismatches and statistics of the per-scan vectors.

    Missing scans count as scans and as missing, and in no other counter."""
    count = lambda test: F.count(F.when(test, 1))
    present = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("spectrum_count"), count(F.col("missing_a")).alias("missing_original"), count(F.col("missing_b")).alias("missing_rebuilt"))
    stats = [F.max(f"max_{k}_error").alias(f"max_{k}_error") for k in ("mz", "intensity")]
    for col in ("mean_mz_error", "mean_intensity_error", "p95_relative_error", "tic_error"):
        q = F.percentile(col, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
        stats += [F.avg(col).alias(f"{col}_mean"), q.alias(f"_{col}")]
    agg = errors.groupBy(*by).agg(count(~F.col("same_length")).alias("length_mismatch"), count(F.col("nonzero_a") != F.col("nonzero_b")).alias("nonzero_mismatch"), count(F.col("max_mz_error") > 0).alias("any_mz_error"), count(F.col("max_intensity_error") > 0).alias("any_intensity_error"), *stats)
    for col in ("mean_mz_error", "mean_intensity_error", "p95_relative_error", "tic_error"):
        for i, name in enumerate(("median", "p95", "p99")):
            agg = agg.withColumn(f"{col}_{name}", F.col(f"_{col}")[i])
        agg = agg.drop(f"_{col}")
    return present.join(agg, by, "left")


def verdict(summary: DataFrame, float32: Column, aux_equal: Column, full: bool = True) -> DataFrame:
    """Whether the errors stay under their ceilings and the structure is whole; the weaker form skips two checks."""
    ceiling = F.when(float32, INTENSITY_CEILING_F32).otherwise(INTENSITY_CEILING)
    ok = (F.col("max_mz_error") <= MZ_CEILING + SLACK) & (F.col("max_intensity_error") <= ceiling + SLACK)
    ok = ok & (F.col("missing_original") + F.col("missing_rebuilt") + F.col("length_mismatch") == 0)
    if full:
        ok = ok & (F.col("nonzero_mismatch") == 0) & aux_equal
    return summary.withColumn("passed", F.coalesce(ok, F.lit(False)))


def exact_share(pairs: DataFrame, by: list[str]) -> DataFrame:
    same = (F.col("mz_a").eqNullSafe(F.col("mz_b"))) & (F.col("intensity_a").eqNullSafe(F.col("intensity_b")))
    return pairs.groupBy(*by).agg(F.avg(same.cast("double")).alias("exact_fraction"), F.count(F.lit(1)).alias("scans"))


def derived_values(scans: DataFrame) -> DataFrame:
    """Total, base peak (first among equals) and m/z range of each scan; 0 for empty or non-finite ones."""
    fine = lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    top = F.array_max("intensity")
    at = F.array_position("intensity", top).cast("int")
    return scans.withColumn("tic", fine(_sum(F.col("intensity")))).withColumn("base_peak", fine(top)).withColumn("base_peak_mz", fine(F.get("mz", at - 1))).withColumn("lowest_mz", fine(F.array_min("mz"))).withColumn("highest_mz", fine(F.array_max("mz")))


def worst_points(a: DataFrame, b: DataFrame, key: list[str], value: str, n: int | None = 20) -> DataFrame:
    """The largest error of each scan, and of these the ``n`` largest (None: all)."""
    diff = a.join(b.select(*key, "pos", F.col(value).alias("_other")), [*key, "pos"]).withColumn("diff", F.abs(F.col(value) - F.col("_other")))
    worst = diff.groupBy(*key).agg(F.max(F.struct("diff", (-F.col("pos")).alias("p"))).alias("w")).select(*key, F.col("w.diff").alias("diff"), (-F.col("w.p")).alias("pos"))
    return worst if n is None else worst.orderBy(F.desc("diff"), *key).limit(n)


def structure_digest(tokens: DataFrame, by: list[str], ord_: str, token: str) -> DataFrame:
    """An order-sensitive digest of a file's tokens, from digests of blocks so that no task gathers a whole file."""
    line = F.sha2(F.col(token), 256)
    block = F.floor(F.col(ord_) / 4096).cast("long")
    joined = lambda c, o: F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct(F.col(o).alias("o"), c.alias("t")))), lambda s: s["t"])), 256)
    blocks = tokens.groupBy(*by, block.alias("_b")).agg(joined(line, ord_).alias("_h"), F.count(F.lit(1)).alias("_n"))
    return blocks.groupBy(*by).agg(joined(F.col("_h"), "_b").alias("digest"), F.sum("_n").alias("tokens"))
