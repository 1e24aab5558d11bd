"""Readers and writers of result tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_delimited(spark: SparkSession, path: str, sep: str = ",", schema: str | None = None) -> DataFrame:
    """CSV or TSV with a header; a byte-order mark is no part of the first name.  Without a schema all is text."""
    reader = spark.read.option("header", True).option("sep", sep)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in df.columns})


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Rows of Markdown tables as arrays of cells, with file and line order kept by the caller's key."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*\|") & ~F.col("value").rlike(r"^[\s|:-]+$"))
    inner = F.regexp_replace("value", r"^\s*\||\|\s*$", "")
    return lines.select(F.transform(F.split(inner, r"\|"), lambda x: F.trim(x)).alias("cells"))


def first_present(df: DataFrame, names: list[str]) -> Column:
    """The first of several candidate columns that the table has."""
    for n in names:
        if n in df.columns:
            return F.col(f"`{n}`")
    raise ValueError(f"none of {names} among {df.columns}")


def read_report(spark: SparkSession, path: str, key: str, q_columns: list[str], limit: float = 0.01) -> DataFrame:
    """A Parquet report cut at a q-value (a missing one counts as 1), one row a key."""
    df = spark.read.parquet(path)
    for q in q_columns:
        if q in df.columns:
            df = df.where(F.coalesce(F.col(f"`{q}`").try_cast("double"), F.lit(1.0)) <= limit)
    return df.dropDuplicates([key])


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def markdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as lines of a Markdown table, the header in ``value`` order 0."""
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    head = df.sparkSession.range(2).select(F.col("id").alias("part"), F.when(F.col("id") == 0, line([F.lit(c) for c in columns])).otherwise(line([F.lit("---") for _ in columns])).alias("value"))
    return head.unionByName(df.select(F.lit(2).cast("long").alias("part"), line(cells).alias("value")))


def missing_only(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What is wanted and not there yet: the cache check of an ingest."""
    return wanted.join(done.select(*key).distinct(), key, "left_anti")


#: How much of a file is searched for marks of unsupported inputs, in characters.
SNIFFED = 8 << 20


def supported(path: Column, head: Column, tokens: list[str], marks: list[str]) -> Column:
    """False for paths that hold one of ``tokens`` and for files whose first SNIFFED characters hold one of ``marks``."""
    named = F.lower(path).rlike("|".join(map(re.escape, tokens)))
    marked = F.lower(F.substring(head, 1, SNIFFED)).rlike("|".join(map(re.escape, marks)))
    return ~(F.coalesce(named, F.lit(False)) | F.coalesce(marked, F.lit(False)))
