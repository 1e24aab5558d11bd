"""Numbers and running sums over a whole order, without a task that holds a group or the table.

Rows are dealt by range over (group, order), so a group with a third of all rows spans many tasks.  Each task numbers its
own sorted rows; where a (task, group) run begins follows from a table of at most tasks + groups rows, which is why that
table may be broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import ensure_checkpoint_dir


def numbered(df: DataFrame, order: list[Column], group: list[str] | None = None, name: str = "place", total: str | None = None) -> DataFrame:
    """``df`` with the 0-based number of each row in ``order`` within ``group``; with ``total`` also the sum of that
    column over the rows before it (``total`` + "_before")."""
    ensure_checkpoint_dir(df.sparkSession)
    group = group or []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *map(F.col, group), *order).sortWithinPartitions(*map(F.col, group), *order)
    held = dealt.withColumns({"_run": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).checkpoint()
    size = F.sum(total) if total else F.lit(None)
    runs = held.groupBy("_run", *group).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"), size.alias("_s"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = runs.select("_run", *group, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).alias("_from"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_head"))
    on = F.col("h._run") == F.col("s._run")
    for c in group:
        on = on & F.col(f"h.`{c}`").eqNullSafe(F.col(f"s.`{c}`"))
    out = held.alias("h").join(F.broadcast(sums).alias("s"), on)
    own = [F.col(f"h.`{c}`") for c in df.columns]
    place = (F.col("h._at") + F.col("s._from")).alias(name)
    if not total:
        return out.select(*own, place)
    # a run is sorted within one task; its own sums need no order but that
    inside = Window.partitionBy("h._run", *(F.col(f"h.`{c}`") for c in group)).orderBy("h._at").rowsBetween(Window.unboundedPreceding, -1)
    head = (F.col("s._head") + F.coalesce(F.sum(F.col(f"h.`{total}`")).over(inside), F.lit(0))).alias(f"{total}_before")
    return out.select(*own, place, head)


def average_ranks(df: DataFrame, value: str, name: str = "rank", ties: str | None = None) -> DataFrame:
    """``df`` with the 1-based rank of ``value``, ties at their mean, and on request the number of ties; only distinct
    values are put in order."""
    n = df.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = numbered(n, [F.col("_v")], name="_place", total="_n")
    ranks = placed.select("_v", (F.col("_n_before") + 1 + (F.col("_n") - 1) / 2.0).alias(name), *([F.col("_n").alias(ties)] if ties else []))
    return df.join(ranks, F.col(value) == F.col("_v")).drop("_v")
