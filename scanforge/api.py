"""The engine's front door: whole files to archives and back, and what an archive or a job is like."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources import archive, tables
from .streaming import progress


@dataclass(frozen=True)
class Options:
    """How files are compressed: a preset of ``archive.PRESETS``, and whether an archive that is there is kept."""

    preset: str = "lossless"
    keep_existing: bool = False

    def __post_init__(self):
        if self.preset not in archive.PRESETS:
            raise ValueError(f"no preset {self.preset!r}; there are {sorted(archive.PRESETS)}")


def compress(spark: SparkSession, path: str, folder: str, options: Options = Options()) -> DataFrame:
    """mzML files to an archive; returns its sections (see :func:`status`)."""
    store, place = archive.at(spark, folder)
    if not (options.keep_existing and store.exists(place)):
        archive.compress(spark, path, folder, options.preset)
    return status(spark, folder)


def decompress(spark: SparkSession, folder: str, options: Options = Options(), levels: tuple[str, ...] = ("ms1", "ms2")) -> DataFrame:
    return archive.decompress(spark, folder, levels, options.preset)


def export(spark: SparkSession, folder: str, out: str, options: Options = Options()) -> DataFrame:
    return archive.export(spark, folder, out, options.preset)


def validate(spark: SparkSession, original: str, rebuilt: str) -> DataFrame:
    return archive.validate(spark, original, rebuilt)


def round_trip(spark: SparkSession, path: str, folder: str, options: Options = Options()) -> DataFrame:
    """Compress, export beside the archive and validate."""
    compress(spark, path, folder, options)
    out = f"{folder.rstrip('/')}-export"
    export(spark, folder, out, options).count()
    return validate(spark, path, f"{out}/*.mzML")


def status(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of an archive: name, records, bytes; only footers and file sizes are read."""
    store, place = archive.at(spark, folder)
    rows = []
    for name in archive.SECTIONS:
        _, part = archive.at(spark, f"{folder.rstrip('/')}/{name}")
        if store.exists(part):
            rows.append((name, archive.section(spark, folder, name).count(), store.getContentSummary(part).getLength()))
    return spark.createDataFrame(rows, "section string, records long, bytes long")


def jobs(spark: SparkSession, log: str) -> DataFrame:
    """Where each job of a progress log stands: started, running or succeeded."""
    last = spark.read.schema(progress.EVENTS).json(log).groupBy("job").agg(F.max("done").alias("done"), F.max("total").alias("total"))
    state = F.when((F.col("total") > 0) & (F.col("done") >= F.col("total")), "succeeded").when(F.col("done") > 0, "running").otherwise("started")
    return last.select("job", state.alias("state"), "done", "total")


def report(df: DataFrame, path: str) -> None:
    """A result as CSV with a header."""
    tables.write_delimited(df, path)
