"""Benchmark, ablation and bookkeeping tables: aggregates, references, pivots, latest rows, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import numbered

from ..functions.numeric import ratio


def method_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    r = ratio(F.col("raw"), F.col("compressed"))
    raw, packed = F.sum("raw"), F.sum("compressed")
    return rows.groupBy(*by).agg(F.count_distinct("sample").alias("samples"), raw.alias("raw"), packed.alias("compressed"), F.avg(r).alias("mean_ratio"), F.percentile(r, F.lit(0.5)).alias("median_ratio"), F.min(r).alias("min_ratio"), F.max(r).alias("max_ratio"), F.stddev_pop(r).alias("sd_ratio"), F.when(packed > 0, raw / packed).alias("aggregate_ratio"))


def against_reference(rows: DataFrame, within: list[str], label: str, reference: str, value: str) -> DataFrame:
    """Each row's value relative to that of the reference label of the same group."""
    ref = F.max(F.when(F.col(label) == reference, F.col(value))).over(Window.partitionBy(*within))
    return rows.withColumn("reference", ref).withColumn("percent", F.when(ref > 0, (F.col(value) / ref - 1) * 100))


def complete_groups(rows: DataFrame, group: str, member: str, expected: int) -> DataFrame:
    """Rows of the groups that have ``expected`` distinct members at least."""
    full = rows.groupBy(group).agg(F.count_distinct(member).alias("members")).where(F.col("members") >= expected)
    return rows.join(full.select(group, "members"), group)


def in_every(rows: DataFrame, item: str, across: str) -> DataFrame:
    """Items that stand with every value of ``across`` (relational division by counts)."""
    n = rows.agg(F.count_distinct(across).alias("n"))
    return rows.groupBy(item).agg(F.count_distinct(across).alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select(item)


def ordered_by_median(rows: DataFrame, item: str, value: Column, default: Column) -> DataFrame:
    found = rows.groupBy(item).agg(F.percentile(value, F.lit(0.5)).alias("median"), F.min(default).alias("_d"))
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("median", 9)), "_d"))).drop("_d")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The best row of each key by ``order``; among equals the later one must be named by the order's last column."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return new.unionByName(old.join(new.select(*key).distinct(), key, "left_anti"))


def union_roots(tables: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Same-named tables of several roots with their root, columns united, the first root's row kept for each key."""
    out = None
    for i, (root, df) in enumerate(tables.items()):
        own = df.withColumn("source_root", F.lit(root)).withColumn("_root", F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return latest(out, key, [F.col("_root")]).drop("_root")


def conformance(found: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Every wanted or found name as kept, missing or excluded."""
    a = found.select(key).distinct().withColumn("_f", F.lit(1))
    b = wanted.select(key).distinct().withColumn("_w", F.lit(1))
    status = F.when(F.col("_f").isNotNull() & F.col("_w").isNotNull(), "kept").when(F.col("_w").isNotNull(), "missing").otherwise("excluded")
    return a.join(b, key, "full").select(key, status.alias("status"))


def coverage(items: DataFrame, sets: dict[str, DataFrame], key: str) -> DataFrame:
    """Items with a flag for membership in each set."""
    for name, df in sets.items():
        items = items.join(df.select(key).distinct().withColumn(f"in_{name}", F.lit(True)), key, "left").withColumn(f"in_{name}", F.coalesce(f"in_{name}", F.lit(False)))
    return items


def with_total(rows: DataFrame, key: str, sums: list[str], total: str = "AGGREGATE") -> DataFrame:
    """Sums per key and a total row, in one pass (ROLLUP)."""
    out = rows.rollup(key).agg(F.grouping(key).alias("_g"), *(F.sum(c).alias(c) for c in sums))
    return out.withColumn(key, F.when(F.col("_g") == 1, total).otherwise(F.col(key).cast("string"))).drop("_g")


def normalised(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Min-max scaled within the group; 0.5 where it is constant."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return rows.withColumn("scaled", F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.5))


def common_files(rows: DataFrame, variant: str, base: str, file: str) -> DataFrame:
    """Rows of the files that the base variant has too."""
    return rows.join(rows.where(F.col(variant) == base).select(file).distinct(), file, "left_semi")


def variant_summary(rows: DataFrame, variant: str, base: str, file: str) -> DataFrame:
    """Per variant over the base's files: aggregate, mean and upper-median ratio, size against the base in percent."""
    own = common_files(rows, variant, base, file).withColumn("_r", ratio(F.col("raw"), F.col("compressed")))
    out = own.groupBy(variant).agg(F.count(F.lit(1)).alias("n"), F.count("_r").alias("_m"), F.sum("raw").alias("raw"), F.sum("compressed").alias("compressed"), F.avg("_r").alias("mean_ratio"))
    # the upper median is the ratio at half the number, by distributed places
    placed = numbered(own.where("_r is not null").select(variant, "_r"), [F.col("_r")], [variant], "_place")
    upper = placed.join(out.select(variant, "_m"), variant).where(F.col("_place") == F.floor(F.col("_m") / 2)).groupBy(variant).agg(F.max("_r").alias("upper_median"))
    out = out.join(upper, variant, "left").drop("_m").withColumn("aggregate_ratio", F.col("raw") / F.col("compressed"))
    size = out.agg(F.max(F.when(F.col(variant) == base, F.col("compressed"))).alias("_size"))
    return out.crossJoin(F.broadcast(size)).withColumn("size_delta_percent", (F.col("compressed") / F.col("_size") - 1) * 100).drop("_size")


def interleave(rows: DataFrame, size: str, large: Column, per_large: int = 4, tie: str = "sample") -> DataFrame:
    """A queue of one large item, then ``per_large`` small ones, each class by falling size."""
    w = Window.partitionBy(large).orderBy(F.desc(size), tie)
    k = F.row_number().over(w) - 1
    turn = F.when(large, k).otherwise(F.floor(k / per_large))
    return rows.withColumn("turn", turn.cast("long")).withColumn("is_large", large)


def timing_shares(rows: DataFrame, by: list[str], stage: str, seconds: str, total: str) -> DataFrame:
    """Seconds per stage, with what the stages leave of the total as a stage of its own, and percentages."""
    stages = rows.groupBy(*by, F.col(stage).alias("stage")).agg(F.sum(seconds).alias("seconds"))
    whole = rows.groupBy(*by).agg(F.sum(seconds).alias("_m"), F.max(total).alias("total"))
    rest = whole.select(*by, F.lit("unattributed").alias("stage"), F.greatest(F.lit(0.0), F.col("total") - F.col("_m")).alias("seconds"))
    return stages.unionByName(rest).join(whole.select(*by, "total"), by).withColumn("percent", F.when(F.col("total") > 0, F.col("seconds") / F.col("total") * 100))
