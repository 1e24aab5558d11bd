"""mzML files as scans: a splittable reader on the XML source, and writers.

The reader leaves record finding to Spark (``rowTag``), so a large file is read by many tasks; only the payloads are
decoded in Python, in Arrow batches.  The writer makes one file a ``file_id``, streaming its sorted records."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Accessions of the controlled vocabulary.
LEVEL, MZ, INTENSITY, F32, F64, ZLIB, PLAIN, RT, WAVELENGTH, TIME = "MS:1000511", "MS:1000514", "MS:1000515", "MS:1000521", "MS:1000523", "MS:1000574", "MS:1000576", "MS:1000016", "MS:1000617", "MS:1000595"
TARGET, LOWER, UPPER = "MS:1000827", "MS:1000828", "MS:1000829"
DERIVED = {"tic": "MS:1000285", "base_peak_mz": "MS:1000504", "base_peak": "MS:1000505", "highest_mz": "MS:1000527", "lowest_mz": "MS:1000528"}

PARAM = "array<struct<_accession:string,_value:string>>"
SPECTRUM = (
    f"_index long, _id string, _defaultArrayLength long, cvParam {PARAM}, scanList struct<scan:array<struct<cvParam:{PARAM}>>>, "
    f"precursorList struct<precursor:array<struct<isolationWindow:struct<cvParam:{PARAM}>>>>, binaryDataArrayList struct<binaryDataArray:array<struct<_encodedLength:string,cvParam:{PARAM},binary:string>>>"
)
CHROMATOGRAM = f"_index long, _id string, _defaultArrayLength long, cvParam {PARAM}, binaryDataArrayList struct<binaryDataArray:array<struct<_encodedLength:string,cvParam:{PARAM},binary:string>>>"


def param(params: Column, accession: str) -> Column:
    """Value of the first parameter with an accession; null if there is none."""
    return F.get(F.filter(params, lambda p: p["_accession"] == accession), F.lit(0))["_value"]


def has(params: Column, accession: str) -> Column:
    return F.coalesce(F.exists(params, lambda p: p["_accession"] == accession), F.lit(False))


def number(text: Column) -> Column:
    return text.try_cast("double")


def decode_arrays(payload: Column, accessions: Column) -> Column:
    """base64, optionally zlib, little-endian floats of 32 or 64 bits as array<double>; anything else is an error."""

    @F.pandas_udf("array<double>")
    def run(text: pd.Series, kinds: pd.Series) -> pd.Series:
        out = []
        for t, k in zip(text, kinds):
            k = set(k if k is not None else ())
            raw = base64.b64decode(t) if t else b""
            if ZLIB in k:
                raw = zlib.decompress(raw) if raw else b""
            elif raw and PLAIN not in k:
                raise ValueError(f"unsupported compression among {sorted(k)}")
            if F64 not in k and F32 not in k:
                raise ValueError(f"unsupported data type among {sorted(k)}")
            out.append(np.frombuffer(raw, "<f8" if F64 in k else "<f4").astype(np.float64).tolist())
        return pd.Series(out)

    return run(payload, accessions)


def records(spark: SparkSession, path: str, tag: str = "spectrum", schema: str = SPECTRUM) -> DataFrame:
    df = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return df.withColumn("file_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.mzML)?$", 1))


def binary_arrays(found: DataFrame) -> DataFrame:
    """One row for each payload: file_id, record index and id, accessions, text."""
    each = found.select("file_id", "_index", "_id", F.posexplode("binaryDataArrayList.binaryDataArray").alias("nth", "b"))
    return each.select("file_id", F.col("_index").alias("record_index"), F.col("_id").alias("record_id"), "nth", F.col("b._encodedLength").alias("encoded_length"), F.transform("b.cvParam", lambda p: p["_accession"]).alias("accessions"), F.coalesce("b.binary", F.lit("")).alias("binary_text"))


def read_spectra(spark: SparkSession, path: str) -> DataFrame:
    """Scans of mass spectra: arrays, level, time, isolation window; scan_idx counts within file and level."""
    found = records(spark, path)
    level = param(F.col("cvParam"), LEVEL).try_cast("int")
    window = F.get("precursorList.precursor", F.lit(0))["isolationWindow"]["cvParam"]
    value = lambda a: F.coalesce(F.round(number(param(window, a)), 4), F.lit(0.0))
    arrays = F.col("binaryDataArrayList.binaryDataArray")
    one = lambda a: F.get(F.filter(arrays, lambda b: F.exists(b["cvParam"], lambda p: p["_accession"] == a)), F.lit(0))
    kinds = lambda b: F.transform(b["cvParam"], lambda p: p["_accession"])
    spectra = found.withColumn("ms_level", level).where("ms_level is not null").select(
        "file_id",
        F.col("_index").alias("spectrum_index"),
        F.col("_id").alias("spectrum_id"),
        "ms_level",
        F.coalesce(number(param(F.get("scanList.scan", F.lit(0))["cvParam"], RT)), F.lit(0.0)).alias("rt"),
        F.struct(value(TARGET).alias("target"), value(LOWER).alias("lower"), value(UPPER).alias("upper")).alias("window"),
        decode_arrays(one(MZ)["binary"], kinds(one(MZ))).alias("mz"),
        decode_arrays(one(INTENSITY)["binary"], kinds(one(INTENSITY))).alias("intensity"),
        F.when(has(one(INTENSITY)["cvParam"], F32), "float32").otherwise("float64").alias("intensity_dtype"),
    )
    # scans are counted on slim rows, so arrays are not shuffled for the count
    slim = spectra.select("file_id", "spectrum_index", "ms_level").withColumn("scan_idx", F.row_number().over(Window.partitionBy("file_id", "ms_level").orderBy("spectrum_index")) - 1)
    checked = spectra.withColumn("mz", F.when(F.size("mz") == F.size("intensity"), F.col("mz")).otherwise(F.raise_error(F.lit("array lengths differ")).cast("array<double>")))
    return checked.join(slim, ["file_id", "spectrum_index", "ms_level"])


def read_auxiliary(spark: SparkSession, path: str) -> DataFrame:
    """Payloads that are not a mass spectrum's m/z or intensity: those of other spectra and of chromatograms."""
    s = records(spark, path)
    other = binary_arrays(s.where(param(F.col("cvParam"), LEVEL).isNull())).withColumn("kind", F.lit("spectrum"))
    extra = binary_arrays(s.where(param(F.col("cvParam"), LEVEL).isNotNull())).where(~F.array_contains("accessions", MZ) & ~F.array_contains("accessions", INTENSITY)).withColumn("kind", F.lit("spectrum"))
    c = binary_arrays(records(spark, path, "chromatogram", CHROMATOGRAM)).withColumn("kind", F.lit("chromatogram"))
    return other.unionByName(extra).unionByName(c)


def chromatogram_statistics(spark: SparkSession, path: str) -> DataFrame:
    found = records(spark, path, "chromatogram", CHROMATOGRAM)
    flat = binary_arrays(found).withColumn("values", decode_arrays(F.col("binary_text"), F.col("accessions")))
    time = F.array_contains("accessions", TIME)
    return flat.groupBy("file_id", "record_id").agg(
        F.max(F.when(time, F.size("values"))).alias("points"),
        F.min(F.when(time, F.array_min("values"))).alias("time_min"),
        F.max(F.when(time, F.array_max("values"))).alias("time_max"),
        F.max(F.when(~time, F.array_max("values"))).alias("intensity_max"),
        F.sum(F.length(F.unbase64("binary_text"))).alias("blob_bytes"),
    )


def supported(spark: SparkSession, path: str, refuse: str = "timstof") -> DataFrame:
    """Files whose name or first 8 MiB do not name what is refused."""
    found = spark.read.format("binaryFile").load(path).select("path", "length", F.lower(F.substring("content", 1, 8388608).cast("string")).alias("head"))
    return found.where(~F.contains(F.lower("path"), F.lit(refuse)) & ~F.contains("head", F.lit(refuse))).select("path", "length").orderBy("path")


def skeleton(xml: Column, tag: str = "binary") -> Column:
    """The document without its payloads, the text of elements ``tag``."""
    emptied = F.regexp_replace(xml, rf"(<{tag}\b[^>]*>)[^<]*(</{tag}>)", "$1$2")
    return F.regexp_replace(emptied, r'encodedLength="\d+"', 'encodedLength="0"')


def payload(values, dtype: str, packed: bool) -> tuple[str, str]:
    raw = np.asarray(values, "<f4" if dtype == "float32" else "<f8").tobytes()
    raw = zlib.compress(raw) if packed else raw
    kinds = [F32 if dtype == "float32" else F64, ZLIB if packed else PLAIN]
    return base64.b64encode(raw).decode(), "".join(f'<cvParam accession="{k}" value=""/>' for k in kinds)


def fragment(row: dict, packed: bool = True) -> str:
    """One spectrum element, with its derived values made anew from the arrays."""
    mz, i = np.asarray(row["mz"], float), np.asarray(row["intensity"], float)
    fine = lambda x: format(float(x) if np.isfinite(x) else 0.0, ".15g")
    top = int(i.argmax()) if len(i) else 0
    derived = {"tic": i.sum(), "base_peak_mz": mz[top] if len(mz) else 0, "base_peak": i[top] if len(i) else 0, "highest_mz": mz.max() if len(mz) else 0, "lowest_mz": mz.min() if len(mz) else 0}
    params = f'<cvParam accession="{LEVEL}" value="{row["ms_level"]}"/>' + "".join(f'<cvParam accession="{DERIVED[k]}" value="{fine(v)}"/>' for k, v in derived.items())
    scan = f'<scanList count="1"><scan><cvParam accession="{RT}" value="{fine(row["rt"])}"/></scan></scanList>'
    w = row.get("window")
    window = ""
    if row["ms_level"] > 1 and w is not None:
        inner = "".join(f'<cvParam accession="{a}" value="{fine(w[k])}"/>' for a, k in ((TARGET, "target"), (LOWER, "lower"), (UPPER, "upper")))
        window = f'<precursorList count="1"><precursor><isolationWindow>{inner}</isolationWindow></precursor></precursorList>'
    arrays = ""
    for values, dtype, kind in ((mz, "float64", MZ), (i, row.get("intensity_dtype") or "float64", INTENSITY)):
        text, kinds = payload(values, dtype, packed)
        arrays += f'<binaryDataArray encodedLength="{len(text)}">{kinds}<cvParam accession="{kind}" value=""/><binary>{text}</binary></binaryDataArray>'
    return f'<spectrum index="{row["spectrum_index"]}" id={quoteattr(str(row["spectrum_id"]))} defaultArrayLength="{len(mz)}">{params}{scan}{window}<binaryDataArrayList count="2">{arrays}</binaryDataArrayList></spectrum>'


HEAD = '<?xml version="1.0" encoding="utf-8"?>\n<indexedmzML><mzML xmlns="http://psi.hupo.org/ms/mzml"><run id={0}><spectrumList>\n'
TAIL = "</run></mzML>\n"


def total_ion_chromatogram(times: list[float], totals: list[float], packed: bool) -> str:
    arrays = ""
    for values, kind in ((times, TIME), (totals, INTENSITY)):
        text, kinds = payload(values, "float64", packed)
        arrays += f'<binaryDataArray encodedLength="{len(text)}">{kinds}<cvParam accession="{kind}" value=""/><binary>{text}</binary></binaryDataArray>'
    return f'<chromatogram index="0" id="TIC" defaultArrayLength="{len(times)}"><cvParam accession="MS:1000235" value=""/><binaryDataArrayList count="2">{arrays}</binaryDataArrayList></chromatogram>'


def write_indexed(spectra: DataFrame, folder: str, packed: bool = True) -> DataFrame:
    """Write one indexed file for each file_id; returns file_id, path, spectra and the offset of the index.

    Records stream to the file in order, offsets are noted as they pass; a repeated record id is an error.  The file
    ends with its total ion chromatogram.  A file
    appears under its own name only once it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        now, out, at, offsets, times, totals = None, None, 0, {}, [], []

        def close() -> tuple:
            nonlocal at
            head = '</spectrumList><chromatogramList count="1">'
            last = total_ion_chromatogram(times, totals, packed)
            out.write(f"{head}{last}</chromatogramList>{TAIL}".encode())
            own = f'<index name="chromatogram"><offset idRef="TIC">{at + len(head)}</offset></index>'
            at += len(f"{head}{last}</chromatogramList>{TAIL}")
            index = "".join(f"<offset idRef={quoteattr(k)}>{v}</offset>\n" for k, v in offsets.items())
            out.write(f'<indexList count="2"><index name="spectrum">\n{index}</index>{own}</indexList><indexListOffset>{at}</indexListOffset></indexedmzML>'.encode())
            out.close()
            store.move(f"{top}/{now}.mzML.tmp", f"{top}/{now}.mzML")
            return now, f"{folder}/{now}.mzML", len(offsets), at

        done = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["file_id"] != now:
                    if now is not None:
                        done.append(close())
                    now, offsets, times, totals = row["file_id"], {}, [], []
                    out = store.open_output_stream(f"{top}/{now}.mzML.tmp")
                    head = HEAD.format(quoteattr(escape(str(now)))).encode()
                    out.write(head)
                    at = len(head)
                if row["spectrum_id"] in offsets:
                    raise ValueError(f"{now}: repeated record id {row['spectrum_id']}")
                offsets[row["spectrum_id"]] = at
                times.append(row["rt"] or 0.0)
                totals.append(float(np.sum(row["intensity"])))
                text = (fragment(row, packed) + "\n").encode()
                out.write(text)
                at += len(text)
        if now is not None:
            done.append(close())
        cols = list(zip(*done)) or [(), (), (), ()]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file_id", "path", "spectra", "index_offset"])

    sorted_ = spectra.repartition("file_id").sortWithinPartitions("file_id", "spectrum_index")
    return sorted_.mapInArrow(run, "file_id string, path string, spectra long, index_offset long")


def file_type(spectra: DataFrame, sample: int = 200) -> DataFrame:
    """DIA, DDA or UNKNOWN for each file: its name decides, else the isolation targets of its first records."""
    name = F.upper("file_id")
    few = spectra.where(F.col("spectrum_index") < sample).groupBy("file_id").agg(F.count(F.when(F.col("ms_level") == 2, 1)).alias("n"), F.count_distinct(F.when(F.col("ms_level") == 2, F.round("window.target", 2))).alias("d"))
    by_target = F.when(F.col("n") == 0, "UNKNOWN").when((F.col("d") < 50) & (F.col("n") / F.greatest("d", F.lit(1)) > 5), "DIA").otherwise("DDA")
    return few.select("file_id", "n", "d", F.when(F.contains(name, F.lit("DIA")), "DIA").when(F.contains(name, F.lit("DDA")), "DDA").otherwise(by_target).alias("file_type"))
