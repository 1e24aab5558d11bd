"""Set recovery and quantity agreement between an original and a rebuilt identification table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import pearson


def pairwise(a: DataFrame, b: DataFrame, key: list[str], quantity: str = "quantity") -> DataFrame:
    """Full outer join of quantities, 0 where a side lacks the id, with class and log2 difference."""
    both = a.select(*key, F.col(quantity).alias("qa")).join(b.select(*key, F.col(quantity).alias("qb")), key, "full").withColumn("qa", F.coalesce("qa", F.lit(0.0))).withColumn("qb", F.coalesce("qb", F.lit(0.0)))
    label = F.when((F.col("qa") > 0) & (F.col("qb") > 0), "shared").when(F.col("qa") > 0, "original_only").when(F.col("qb") > 0, "rebuilt_only").otherwise("zero")
    return both.withColumn("set_class", label).withColumn("log2fc", F.when(F.col("set_class") == "shared", F.log2(F.col("qb") / F.col("qa"))))


def count(test: Column) -> Column:
    return F.count(F.when(test, 1))


def set_metrics(pairs: DataFrame, by: list[str]) -> DataFrame:
    shared, left, right = (count(F.col("set_class") == k) for k in ("shared", "original_only", "rebuilt_only"))
    union = shared + left + right
    inside = F.col("set_class") == "shared"
    lx, ly = F.when(inside, F.log2(F.col("qa") + 1)), F.when(inside, F.log2(F.col("qb") + 1))
    fc = F.abs("log2fc")
    return pairs.groupBy(*by).agg(
        (shared + left).alias("original_count"),
        (shared + right).alias("rebuilt_count"),
        shared.alias("shared_count"),
        left.alias("original_only"),
        right.alias("rebuilt_only"),
        F.when(union > 0, shared / union).alias("jaccard"),
        F.when(shared + left > 0, shared / (shared + left)).alias("recovery_rate"),
        pearson(lx, ly).alias("pearson_log2"),
        F.percentile(fc, F.lit(0.5)).alias("median_abs_log2fc"),
        F.percentile(fc, F.lit(0.95)).alias("p95_abs_log2fc"),
    )


def tail(pairs: DataFrame, by: list[str], limits: tuple[float, ...] = (0.5, 1.0, 2.0)) -> DataFrame:
    """Counts and shares of large differences, extreme percentiles, and rates of one-sided ids."""
    fc = F.abs("log2fc")
    n = F.count("log2fc")
    cols = [n.alias("shared")]
    for x in limits:
        name = str(x).replace(".", "_")
        cols += [count(fc > x).alias(f"over_{name}"), F.when(n > 0, count(fc > x) / n).alias(f"share_over_{name}")]
    cols += [F.percentile(fc, F.lit(0.99)).alias("p99"), F.percentile(fc, F.lit(0.999)).alias("p999"), F.when(n > 0, count(fc > 0) / n).alias("nonzero_share")]
    return pairs.groupBy(*by).agg(*cols)


def membership(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Shared, lost and gained ids: counts and rates."""
    both = a.select(*key).distinct().withColumn("_a", F.lit(1)).join(b.select(*key).distinct().withColumn("_b", F.lit(1)), key, "full")
    shared, lost, gained = count(F.col("_a").isNotNull() & F.col("_b").isNotNull()), count(F.col("_b").isNull()), count(F.col("_a").isNull())
    return both.agg(shared.alias("shared"), lost.alias("lost"), gained.alias("gained")).select("*", *(F.when(F.col("shared") + F.col("lost") > 0, F.col(c) / (F.col("shared") + F.col("lost"))).alias(f"{c}_rate") for c in ("shared", "lost", "gained")))


def recovery_summary(rows: DataFrame, by: list[str], metric: str, name: str, order: str) -> DataFrame:
    """n, median, min, p05, max and the file of the (first) minimum."""
    return rows.groupBy(*by).agg(F.count(metric).alias("n"), F.percentile(metric, F.lit(0.5)).alias("median"), F.min(metric).alias("min"), F.percentile(metric, F.lit(0.05)).alias("p05"), F.max(metric).alias("max"), F.min_by(name, F.struct(metric, order)).alias("worst"))


def outliers(pairs: DataFrame, by: list[str], key: str, n: int = 25) -> DataFrame:
    """The ``n`` pairs of each group with the largest absolute change; without a group a distributed top-n."""
    order = [F.desc(F.round(F.abs("log2fc"), 9)), F.col(key)]
    known = pairs.where("log2fc is not null")
    if not by:
        known, w = known.orderBy(*order).limit(n), Window.orderBy(*order)
    else:
        w = Window.partitionBy(*by).orderBy(*order)
    return known.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by ``order`` (which must be total)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def shared_identity(a: DataFrame, b: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of both sides with equal keys, after keeping the first of each."""
    left, right = first_of(a, keys, order), first_of(b, keys, order)
    named = lambda df, s: df.select(*keys, *(F.col(c).alias(c + s) for c in df.columns if c not in keys))
    return named(left, "_a").join(named(right, "_b"), keys)
