import base64
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from scanforge import api
from scanforge.__main__ import main
from scanforge.sources import archive, mzml, tables
from scanforge.streaming import progress


def array(values, kind, dtype=mzml.F64, packed=False):
    raw = struct.pack(f"<{len(values)}{'d' if dtype == mzml.F64 else 'f'}", *values)
    text = base64.b64encode(zlib.compress(raw) if packed else raw).decode()
    return f'<binaryDataArray encodedLength="{len(text)}"><cvParam accession="{dtype}" value=""/><cvParam accession="{mzml.ZLIB if packed else mzml.PLAIN}" value=""/><cvParam accession="{kind}" value=""/><binary>{text}</binary></binaryDataArray>'


@pytest.fixture()
def run_file(tmp_path):
    def make(packed=False, dtype=mzml.F64):
        ms1 = f'<spectrum index="0" id="scan=1" defaultArrayLength="2"><cvParam accession="{mzml.LEVEL}" value="1"/><scanList count="1"><scan><cvParam accession="{mzml.RT}" value="1.5"/></scan></scanList><binaryDataArrayList count="2">{array([100.0, 101.0], mzml.MZ, mzml.F64, packed)}{array([10.0, 2.5], mzml.INTENSITY, dtype, packed)}</binaryDataArrayList></spectrum>'
        other = f'<spectrum index="1" id="wave" defaultArrayLength="1"><cvParam accession="MS:1000804" value=""/><binaryDataArrayList count="2">{array([500.0], mzml.WAVELENGTH)}{array([20.0], mzml.INTENSITY)}</binaryDataArrayList></spectrum>'
        chrom = f'<chromatogram index="0" id="tic" defaultArrayLength="1"><binaryDataArrayList count="1">{array([1.0], mzml.TIME)}</binaryDataArrayList></chromatogram>'
        folder = tmp_path / f"in{packed}{dtype[-1]}"
        folder.mkdir()
        (folder / "run.mzML").write_text(f'<?xml version="1.0"?><mzML xmlns="http://psi.hupo.org/ms/mzml"><run id="r"><spectrumList count="2">{ms1}{other}</spectrumList><chromatogramList count="1">{chrom}</chromatogramList></run></mzML>')
        return str(folder / "run.mzML")

    return make


@pytest.mark.parametrize("packed, dtype", [(False, mzml.F64), (True, mzml.F64), (True, mzml.F32)])
def test_read(spark, run_file, packed, dtype):
    path = run_file(packed, dtype)
    got = mzml.read_spectra(spark, path).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["file_id"], r["scan_idx"], r["rt"], r["mz"], r["intensity"]) == ("run", 0, 1.5, [100.0, 101.0], [10.0, 2.5])
    assert r["intensity_dtype"] == ("float32" if dtype == mzml.F32 else "float64") and tuple(r["window"]) == (0.0, 0.0, 0.0)
    aux = mzml.read_auxiliary(spark, path)
    assert aux.count() == 3
    assert mzml.chromatogram_statistics(spark, path).first()["time_max"] == 1.0


def test_write_and_read_back(spark, tmp_path):
    rows = [("a", i, f"scan={i}", 1 if i % 2 == 0 else 2, 0.5 * i, (400.0 + i, 1.0, 1.0), [100.0 + i, 200.0], [1.0, 3.0], "float64") for i in range(5)] + [("b", 0, "x&y", 1, 0.0, None, [], [], "float32")]
    df = spark.createDataFrame(rows, "file_id string, spectrum_index long, spectrum_id string, ms_level int, rt double, window struct<target:double,lower:double,upper:double>, mz array<double>, intensity array<double>, intensity_dtype string")
    out = {r["file_id"]: r for r in mzml.write_indexed(df, f"file://{tmp_path}/out").collect()}
    assert out["a"]["spectra"] == 5
    text = (tmp_path / "out" / "a.mzML").read_bytes()
    for at in [int(x.split(b"<")[0]) for x in text.split(b'idRef="scan=')[1:] for x in [x.split(b">", 1)[1]]]:
        assert text[at : at + 9] == b"<spectrum"
    back = {(r["file_id"], r["spectrum_index"]): r for r in mzml.read_spectra(spark, f"{tmp_path}/out/*.mzML").collect()}
    assert len(back) == 6 and back[("a", 3)]["mz"] == [103.0, 200.0] and back[("a", 3)]["window"]["target"] == 403.0
    assert back[("a", 4)]["scan_idx"] == 2
    again = df.where("file_id = 'a'").unionByName(df.where("spectrum_index = 1").withColumn("spectrum_index", F.lit(9).cast("long")))
    with pytest.raises(Exception, match="repeated record id"):
        mzml.write_indexed(again, f"file://{tmp_path}/bad").collect()


def test_unsupported_compression_is_an_error(spark):
    df = spark.createDataFrame([("AAAA", [mzml.F64])], "t string, k array<string>")
    with pytest.raises(Exception, match="compression"):
        df.select(mzml.decode_arrays(F.col("t"), F.col("k"))).collect()


def test_skeleton(spark):
    df = spark.createDataFrame([('<a encodedLength="4"><binary>AAAA</binary></a>',)], "x string")
    assert df.select(mzml.skeleton(F.col("x")).alias("s")).first()["s"] == '<a encodedLength="0"><binary></binary></a>'


def test_tables(spark, tmp_path):
    (tmp_path / "t.tsv").write_bytes("﻿id\tq\n1\t0.5\n2\tx\n".encode())
    assert tables.read_delimited(spark, str(tmp_path / "t.tsv"), "\t").columns == ["id", "q"]
    (tmp_path / "m.md").write_text("| a | b |\n|---|---|\n| 1 | 2 |\ntext\n")
    assert [r["cells"] for r in tables.read_markdown(spark, str(tmp_path / "m.md")).collect()] == [["a", "b"], ["1", "2"]]
    df = spark.createDataFrame([(1, None), (2, "z")], "id long, v string")
    assert [r["value"] for r in tables.markdown(df, ["id", "v"]).orderBy("part", "value").collect()][0] == "| id | v |"


def test_progress_stream(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    (src / "1.json").write_text('{"job":"a","ts":"2024-01-01T00:00:01Z","stage":"s","done":1,"total":3}\n{"job":"b","ts":"2024-01-01T00:00:02Z","stage":"s","done":0,"total":2}\n')
    q = progress.job_states(progress.tail(spark, str(src))).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        (src / "2.json").write_text('{"job":"a","ts":"2024-01-01T00:00:09Z","stage":"s","done":3,"total":3}\n')
        q.processAllAvailable()
        got = {(r["job"], r["state"]) for r in spark.sql("select * from states").collect()}
    finally:
        q.stop()
    assert got == {("a", "running"), ("b", "started"), ("a", "succeeded")}


def test_progress_batch_windows(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:01", "s", 1, 3), ("a", "2024-01-01 00:00:30", "s", 2, 3)], "job string, ts string, stage string, done long, total long").withColumn("ts", F.to_timestamp("ts"))
    assert progress.stage_progress(df).first()["done"] == 2


def records(spark, n=6):
    rows = [("a", i, f"scan={i}", i % 2 + 1, 0.5 * i, (400.0, 1.0, 1.0), [100.0 + i, 200.0 + i], [1.0, 3.25], "float64") for i in range(n)]
    return spark.createDataFrame(rows, "file_id string, spectrum_index long, spectrum_id string, ms_level int, rt double, window struct<target:double,lower:double,upper:double>, mz array<double>, intensity array<double>, intensity_dtype string")


def test_archive_round_trip_keeps_the_rest_of_the_file(spark, tmp_path, run_file):
    path = run_file(True, mzml.F32)
    told = api.round_trip(spark, path, f"file://{tmp_path}/archive").first()
    assert told["passed"] and told["aux_equal"] and told["aux_records"] == 3
    text = (tmp_path / "archive-export" / "run.mzML").read_text()
    assert 'id="wave"' in text and 'id="tic"' in text and text.count("<binary>") == 5 and text.endswith("</mzML>")
    assert {r["section"] for r in api.status(spark, f"file://{tmp_path}/archive").collect()} == {"ms1", "ms2", "auxiliary", "template"}


def test_arrays_of_different_lengths_are_an_error(spark, tmp_path):
    bad = f'<mzML><spectrum index="0" id="x"><cvParam accession="{mzml.LEVEL}" value="1"/><binaryDataArrayList>{array([1.0, 2.0], mzml.MZ)}{array([1.0], mzml.INTENSITY)}</binaryDataArrayList></spectrum></mzML>'
    (tmp_path / "bad.mzML").write_text(bad)
    for read in (archive.ingest, mzml.read_spectra):
        with pytest.raises(Exception, match="array lengths differ"):
            read(spark, str(tmp_path / "bad.mzML")).collect()


def test_a_failed_archive_leaves_the_old_one(spark, tmp_path):
    folder = f"file://{tmp_path}/kept"
    one = spark.createDataFrame([(1,)], "x int")
    archive.write_atomically({"ms1": one}, folder)
    with pytest.raises(Exception, match="on purpose"):
        archive.write_atomically({"ms1": spark.createDataFrame([(2,)], "x int"), "ms2": one.select(F.raise_error(F.lit("on purpose")).alias("x"))}, folder)
    assert archive.section(spark, folder, "ms1").first()["x"] == 1 and [p.name for p in tmp_path.iterdir()] == ["kept"]
    archive.write_atomically({"ms1": spark.createDataFrame([(3,)], "x int")}, folder)
    assert archive.section(spark, folder, "ms1").first()["x"] == 3 and [p.name for p in tmp_path.iterdir()] == ["kept"]


def test_near_lossless_preset_and_command_line(spark, tmp_path, capsys):
    mzml.write_indexed(records(spark), f"file://{tmp_path}/in").collect()
    main(["compress", f"{tmp_path}/in/*.mzML", f"file://{tmp_path}/arc", "--preset", "near_0.1"], spark)
    assert "ms2" in capsys.readouterr().out
    back = {r["mz"][0]: r["intensity"] for r in api.decompress(spark, f"file://{tmp_path}/arc", api.Options("near_0.1")).collect()}
    assert len(back) == 6 and back[103.0] == [1.0, 3.2]
    with pytest.raises(ValueError, match="no preset"):
        api.Options("best")
