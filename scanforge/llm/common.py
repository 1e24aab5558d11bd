"""Helpers shared by the training-data operators: shared-folder tables, distributed ranks, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What each open scope has written: paths and names of tables.  The first is that of callers without a scope.
_scopes: list[list[str]] = [[]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only where none is named and Spark is local."""
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="scanforge-")
        spark.sparkContext.setCheckpointDir(held)
    return held


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _scopes[-1].append(path)
    return path


def pin(df: DataFrame, what: str = "table", compression: str = "snappy") -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet in the shared folder and read it back.

    Unlike executor-local caching this survives the loss of any executor, and later scans keep column pruning."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scanforge_path = path
    return out


def held_table(df: DataFrame, what: str, buckets: int, key: list[str]) -> str:
    """Write ``df`` to the shared folder as a table bucketed by ``key``; name@path, for ``drop_path``."""
    name = f"{what}_{uuid.uuid4().hex}"
    path = new_path(df.sparkSession, what)
    df.write.option("path", path).bucketBy(buckets, *key).format("parquet").saveAsTable(name)
    _scopes[-1][-1] = f"{name}@{path}"
    return _scopes[-1][-1]


def drop_path(spark: SparkSession, what: str | None) -> None:
    """Remove the files of a path, or those and the entry of a bucketed table (name@path)."""
    if not what:
        return
    for held in _scopes:
        if what in held:
            held.remove(what)
    name, at, path = what.partition("@")
    if at and "/" not in name:
        spark.sql(f"drop table if exists {name}")
        what = path
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(what)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def unpin(df: DataFrame) -> None:
    """Remove the files of a pinned table that no later plan reads."""
    drop_path(df.sparkSession, getattr(df, "_scanforge_path", None))


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[], None]]:
    """Pinned tables made within belong to the scope; the call it gives removes them, once the results that read them are
    written.  Tables made outside stay."""
    own: list[str] = []
    _scopes.append(own)

    def release() -> None:
        while own:
            drop_path(spark, own.pop())

    try:
        yield release
    finally:
        _scopes[:] = [x for x in _scopes if x is not own]


def lean(run: Callable) -> Callable:
    """``run`` for mapInArrow, giving freed memory back to the system when its rows are through (workers are reused)."""

    @functools.wraps(run)
    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return bounded


def trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of ``column`` (one row at least), whatever a batch holds."""
    for batch in batches:
        if not batch.num_rows:
            continue
        stop = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64) + 64)
        low = 0
        while low < batch.num_rows:
            done = stop[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(stop, done + most, side="right")))
            yield batch.slice(low, high - low)
            low = high


def packed(docs: DataFrame, own: list[str]) -> DataFrame:
    """The columns in ``own`` and all others as one struct ``rest``, so that no name an operator uses can clash."""
    others = [c for c in docs.columns if c not in own]
    return docs.select(*(F.col(f"`{c}`") for c in own), F.struct(F.lit(True).alias("_"), *(F.col(f"`{c}`") for c in others)).alias("rest"))


def unpacked(df: DataFrame, columns: list[str], own: list[str], *more: Column) -> DataFrame:
    """The named columns again, from ``own`` and ``rest``, and more."""
    return df.select(*(F.col(f"`{c}`") if c in own else F.col("rest").getField(c).alias(c) for c in columns), *more)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Add the 0-based rank of each row within ``group``, sorted by ``order``, without a task per group.

    Rows are dealt by range over (group, order), so a group with a third of all rows spans many tasks.  Each task
    numbers its own sorted rows; the start of every (task, group) run comes from a count table that has at most
    tasks + groups rows, which is why it may be broadcast."""
    spark = df.sparkSession
    keys = [F.col(f"`{c}`") for c in group]
    dealt = df.repartitionByRange(partitions(spark), *keys, *order).sortWithinPartitions(*keys, *order)
    held = pin(dealt.withColumn("_run", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranked", "zstd")
    runs = held.groupBy("_run", *keys).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).drop("_n", "_low")
    s, h = starts.alias("s"), held.alias("h")
    on = F.col("s._run") == F.col("h._run")
    for c in group:
        on = on & F.col(f"s.`{c}`").eqNullSafe(F.col(f"h.`{c}`"))
    out = h.join(F.broadcast(s), on).select(*[F.col(f"h.`{c}`") for c in df.columns], (F.col("h._at") + F.col("s._from")).alias(name))
    out._scanforge_path = held._scanforge_path
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of the undirected ``edges``: columns ``node`` and ``component`` (smallest node id).

    Alternating large-star and small-star steps.  Each keeps the edge count at or below its input; least neighbours are
    partial aggregates, joined back to slim edges by sort-merge joins that spill.  Links and labels stay in Spark, only
    one counter a round reaches the driver."""
    spark = edges.sparkSession
    now = pin(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")

    def tally(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = tally(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.col("v").alias("u"), "m").where("u <> m").union(small_low.select("u", "m")).distinct()
        nxt = pin(small.select("u", F.col("m").alias("v")), "edges")
        got = tally(nxt)
        unpin(now)
        now = nxt
        if got == seen:
            break
        seen = got
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("v").agg(F.lit(1).alias("x")).select(F.col("v").alias("node"), F.col("v").alias("component"))
    out = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(roots)
    out._scanforge_path = now._scanforge_path
    return out
