"""Incremental reading: progress logs and scans that arrive as files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "job string, ts timestamp, stage string, done long, total long"


def tail(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    """JSON lines appended to a folder, as a stream."""
    return spark.readStream.schema(schema).json(folder)


def drain(spark: SparkSession, folder: str, seen: str, marks: str, schema: str = EVENTS) -> None:
    """Append what has come to ``folder`` since the last call to ``seen``; ``marks`` keeps how far earlier calls got."""
    query = tail(spark, folder, schema).writeStream.format("parquet").option("path", seen).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()


def stage_progress(events: DataFrame, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Highest progress of each job and stage in a window of event time; later events than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "job", "stage").agg(F.max("done").alias("done"), F.max("total").alias("total"), F.count(F.lit(1)).alias("events"))


def island_counts(points: DataFrame) -> DataFrame:
    """Per scan, running counts of positive points and their sum, for points that arrive in any order."""
    return points.where("intensity > 0").groupBy("scan_idx").agg(F.count(F.lit(1)).alias("points"), F.sum("intensity").alias("total"))


def job_states(events: DataFrame) -> DataFrame:
    """The state of each job as its events arrive: started, running, succeeded; a finished job stays finished."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, total = state.get if state.exists else (0, 0)
        for part in batches:
            done, total = max(done, int(part["done"].max())), max(total, int(part["total"].max()))
        state.update((done, total))
        name = "succeeded" if total and done >= total else "running" if done else "started"
        yield pd.DataFrame({"job": [key[0]], "state": [name], "done": [done], "total": [total]})

    return events.groupBy("job").applyInPandasWithState(step, "job string, state string, done long, total long", "done long, total long", "update", GroupStateTimeout.NoTimeout)
