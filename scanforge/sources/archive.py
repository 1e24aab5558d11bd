"""Whole files: mzML into an archive of sections, and back.

An archive is a folder of Parquet sections (``ms1``, ``ms2``, ``auxiliary``, ``template``), whose columns are read and
filtered on their own.  The template holds every record of the file as it was, without payloads, so an export keeps
identifiers, parameters, auxiliary spectra and chromatograms.  Files are read by a separator and split among tasks; a
record's place is its block in the file and its number within the task.

A write goes to a folder beside the target that takes the target's name once it is whole; if it fails, the old archive
stays and nothing is left beside it."""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as num
from . import mzml

SECTIONS = ("ms1", "ms2", "auxiliary", "template")
#: How intensities are kept: exactly, or as whole numbers at a scale (half a unit of the last place is lost).
PRESETS = {"lossless": None, "near_0.001": 1000.0, "near_0.01": 100.0, "near_0.1": 10.0}
ARRAY = re.compile(r"<binaryDataArray\b[^>]*>.*?</binaryDataArray>", re.S)
BINARY = re.compile(r"<binary>([^<]*)</binary>|<binary\s*/>")
LEVEL = re.compile(rf'accession="{mzml.LEVEL}"[^>]*value="(\d+)"')
ACCESSION = re.compile(r'accession="([^"]+)"')


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of files, each ending before the end tag of a spectrum: file_id, block, seq, text."""
    rows = spark.read.option("lineSep", "</spectrum>").text(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.mzML)?$", 1)
    return rows.select(name.alias("file_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("text"))


def split_payloads(text: str) -> tuple[str, list[tuple[str, str]]]:
    """A piece without payloads, and of each array its accessions and payload."""
    found: list[tuple[str, str]] = []

    def empty(m: re.Match) -> str:
        whole = m[0]
        payload = BINARY.search(whole)
        found.append((" ".join(ACCESSION.findall(whole)), (payload[1] or "") if payload else ""))
        return re.sub(r'encodedLength="\d+"', 'encodedLength="0"', BINARY.sub("<binary></binary>", whole))

    return ARRAY.sub(empty, text), found


def numbers(kinds: str, payload: str) -> np.ndarray:
    raw = base64.b64decode(payload) if payload else b""
    own = kinds.split()
    if mzml.ZLIB in own:
        raw = zlib.decompress(raw) if raw else b""
    elif raw and mzml.PLAIN not in own:
        raise ValueError(f"unsupported compression among {own}")
    return np.frombuffer(raw, "<f4" if mzml.F32 in own else "<f8").astype(np.float64)


def ingest(spark: SparkSession, path: str) -> DataFrame:
    """One pass over files: the records' templates, the arrays of mass spectra, and the payloads of everything else.

    Columns: file_id, block, seq, template, ms_level (null for others), mz, intensity, other (accessions and payload of
    each array that is not one of the two, in order).  Arrays of different lengths are an error."""
    schema = "file_id string, block long, seq long, template string, ms_level int, mz array<double>, intensity array<double>, other array<struct<kinds:string,payload:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                template, arrays = split_payloads(r["text"])
                last = template.rfind("<spectrum ")
                level = LEVEL.search(template[last:]) if last >= 0 else None
                own = {k: next((i for i, (kinds, _) in enumerate(arrays) if k in kinds.split()), None) for k in (mzml.MZ, mzml.INTENSITY)} if level else {}
                mz, intensity = (numbers(*arrays[own[k]]) if own.get(k) is not None else None for k in (mzml.MZ, mzml.INTENSITY))
                if mz is not None and intensity is not None and len(mz) != len(intensity):
                    raise ValueError(f"{r['file_id']}: array lengths differ")
                if mz is None or intensity is None:
                    own, mz, intensity = {}, None, None
                other = [{"kinds": k, "payload": p} for i, (k, p) in enumerate(arrays) if i not in own.values()]
                rows.append((r["file_id"], r["block"], r["seq"], template, int(level[1]) if level and mz is not None else None, mz, intensity, other))
            cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.struct([("kinds", pa.string()), ("payload", pa.string())]))]
            names = ["file_id", "block", "seq", "template", "ms_level", "mz", "intensity", "other"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return fragments(spark, path).mapInArrow(run, schema)


def steps(xs: Column) -> Column:
    """First value and differences."""
    later = F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0)))
    return F.concat(F.slice(xs, F.lit(1), F.least(F.size(xs), F.lit(1))), F.zip_with(later, F.slice(xs, F.lit(1), F.greatest(F.size(xs) - 1, F.lit(0))), lambda b, a: b - a))


def sections(found: DataFrame, preset: str = "lossless") -> dict[str, DataFrame]:
    """The sections of an archive from ingested records."""
    scale = PRESETS[preset]
    key = ["file_id", "block", "seq"]
    mz = steps(F.transform("mz", lambda x: num.quantise(x))).alias("mz_steps")
    codes = F.transform("intensity", lambda x: F.rint(x * scale).cast("long")).alias("codes") if scale else F.col("intensity").alias("values")
    level = lambda test: found.where(test).select(*key, "ms_level", mz, codes)
    return {"ms1": level("ms_level = 1"), "ms2": level("ms_level > 1"), "auxiliary": found.where("size(other) > 0").select(*key, "other"), "template": found.select(*key, "template", "ms_level")}


def at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def write_atomically(parts: dict[str, DataFrame], folder: str) -> None:
    """All sections or none: an older archive of that name goes only when the new one is whole."""
    spark = next(iter(parts.values())).sparkSession
    folder = folder.rstrip("/")
    fresh, old = f"{folder}.new-{uuid.uuid4().hex}", f"{folder}.old-{uuid.uuid4().hex}"
    store, target = at(spark, folder)
    path = lambda x: at(spark, x)[1]
    try:
        for name, df in parts.items():
            df.write.option("compression", "zstd").parquet(f"{fresh}/{name}")
        if store.exists(target) and not store.rename(target, path(old)):
            raise OSError(f"{folder} cannot be replaced")
        if not store.rename(path(fresh), target):
            store.rename(path(old), target)
            raise OSError(f"{folder} cannot be written")
    finally:
        for gone in (fresh, old):
            store.delete(path(gone), True)


def compress(spark: SparkSession, path: str, folder: str, preset: str = "lossless") -> None:
    """mzML files to an archive.  The files are parsed once and the records written before they are dealt to sections."""
    staged = f"{folder.rstrip('/')}.records-{uuid.uuid4().hex}"
    try:
        ingest(spark, path).write.parquet(staged)
        write_atomically(sections(spark.read.parquet(staged), preset), folder)
    finally:
        store, place = at(spark, staged)
        store.delete(place, True)


def section(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}")


def decompress(spark: SparkSession, folder: str, levels: tuple[str, ...] = ("ms1", "ms2"), preset: str = "lossless") -> DataFrame:
    """Arrays of mass spectra: file_id, block, seq, ms_level, mz, intensity.  Only the named sections are read."""
    scale = PRESETS[preset]
    out = None
    for name in levels:
        rows = section(spark, folder, name)
        mz = F.transform(running(F.col("mz_steps")), lambda q: num.dequantise(q))
        values = F.transform("codes", lambda c: c / F.lit(scale)) if scale else F.col("values")
        one = rows.select("file_id", "block", "seq", "ms_level", mz.alias("mz"), values.alias("intensity"))
        out = one if out is None else out.unionByName(one)
    return out


def running(xs: Column) -> Column:
    """Running sums of an array, by numpy: in expressions each sum would copy the array before it."""

    @F.pandas_udf("array<bigint>")
    def run(s):
        return s.map(lambda x: np.cumsum(np.asarray(x, np.int64)).tolist())

    return run(xs)


def export(spark: SparkSession, folder: str, out: str, preset: str = "lossless") -> DataFrame:
    """Archive to mzML files: file_id, path, records.  Arrays get the type and compression that the template names."""
    key = ["file_id", "block", "seq"]
    arrays = decompress(spark, folder, preset=preset).drop("ms_level")
    rows = section(spark, folder, "template").join(arrays, key, "left").join(section(spark, folder, "auxiliary"), key, "left")

    def filled(r: dict) -> str:
        own = {mzml.MZ: r["mz"], mzml.INTENSITY: r["intensity"]} if r["ms_level"] is not None else {}
        others = iter(r["other"] or ())
        used: set[str] = set()

        def put(m: re.Match) -> str:
            kinds = ACCESSION.findall(m[0])
            name = next((k for k in own if k in kinds and k not in used), None)
            if name is None:
                text = next(others)["payload"]
            else:
                used.add(name)
                raw = np.asarray(own[name], "<f4" if mzml.F32 in kinds else "<f8").tobytes()
                text = base64.b64encode(zlib.compress(raw) if mzml.ZLIB in kinds else raw).decode()
            return re.sub(r'encodedLength="\d+"', f'encodedLength="{len(text)}"', BINARY.sub(f"<binary>{text}</binary>", m[0]))

        return ARRAY.sub(put, r["template"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(out)
        store.create_dir(top, recursive=True)
        now, f, n, done = None, None, 0, []

        def close() -> None:
            f.close()
            store.move(f"{top}/{now}.mzML.tmp", f"{top}/{now}.mzML")
            done.append((now, f"{out}/{now}.mzML", n))

        for batch in batches:
            for r in batch.to_pylist():
                if r["file_id"] != now:
                    if now is not None:
                        close()
                    now, n = r["file_id"], 0
                    f = store.open_output_stream(f"{top}/{now}.mzML.tmp")
                f.write((("</spectrum>" if n else "") + filled(r)).encode())
                n += 1
        if now is not None:
            close()
        cols = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64()))], names=["file_id", "path", "pieces"])

    # a file is one stream in the end, so it is one task that holds a record at a time
    dealt = rows.repartition("file_id").sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "file_id string, path string, pieces long")


def validate(spark: SparkSession, original: str, rebuilt: str) -> DataFrame:
    """Per file: the round-trip statistics and verdict of mass spectra, and whether auxiliary payloads are equal."""
    from ..operators import compare

    a, b = mzml.read_spectra(spark, original), mzml.read_spectra(spark, rebuilt)
    slim = lambda df: df.select("file_id", "spectrum_index", "mz", "intensity")
    both = compare.align(slim(a), slim(b), ["file_id"], "spectrum_index")
    told = compare.rollup(both, compare.spectrum_errors(both), ["file_id"])
    mark = lambda p: mzml.read_auxiliary(spark, p).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("record_id", "nth", "binary_text").cast("decimal(38,0)")).alias("h"))
    aux = mark(original).alias("x").join(mark(rebuilt).alias("y"), "file_id", "full").select("file_id", (F.col("x.n").eqNullSafe(F.col("y.n")) & F.col("x.h").eqNullSafe(F.col("y.h"))).alias("aux_equal"), F.col("x.n").alias("aux_records"))
    out = told.join(aux, "file_id", "left").withColumn("aux_equal", F.coalesce("aux_equal", F.lit(True)))
    return compare.verdict(out, F.lit(False), F.col("aux_equal"))
