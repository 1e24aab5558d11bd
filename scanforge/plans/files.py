"""Queries that write files, read them back, and hold what comes back against the tables; registered in the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import codec, islands
from ..operators.ranks import numbered
from ..sources import archive, mzml
from ..sources import tables as readers
from ..sources.shared import new_folder
from ..sources.views import Views
from ..streaming import progress
from .catalog import CODES, codes, island_arrays, long, query, r


def files(v: Views) -> DataFrame:
    """The scans as records of one file for each window, levels 1 and 2 in turn."""
    placed = numbered(v.scans, [F.col("scan_idx")], ["win"], name="spectrum_index")
    target = F.struct((F.col("win") * 1.5).alias("target"), F.lit(1.0).alias("lower"), F.lit(1.0).alias("upper"))
    return placed.select(F.concat(F.lit("run"), F.col("win").cast("string")).alias("file_id"), "spectrum_index", F.concat(F.lit("scan="), F.col("scan_idx").cast("string")).alias("spectrum_id"), (F.col("scan_idx") % 2 + 1).cast("int").alias("ms_level"), "rt", target.alias("window"), "mz", "intensity", F.lit("float64").alias("intensity_dtype"))


def written(v: Views, rows: DataFrame | None = None) -> str:
    folder = f"{new_folder(v.spark)}/in"
    mzml.write_indexed(files(v) if rows is None else rows, folder).count()
    return f"{folder}/*.mzML"


def scan_of(c: str = "spectrum_id") -> F.Column:
    return F.substring_index(c, "=", -1).cast("long").alias("scan_idx")


def total(c: str) -> F.Column:
    return F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)


@query("o_s1_mzml_read", "points", sql="select scan_idx, scan_idx % 2 + 1 as ms_level, row_number() over (partition by win, scan_idx % 2 order by scan_idx) - 1 as local_idx, round(rt, 6) as rt, case when scan_idx % 2 = 1 then round(win * 1.5::double, 4) else 0 end as target, n, mz_total, total from (select scan_idx, win, rt, count(*) as n, round(sum(mz), 6) as mz_total, round(sum(intensity), 6) as total from points group by all)")
def _(v: Views) -> DataFrame:
    back = mzml.read_spectra(v.spark, written(v))
    return back.select(scan_of(), long("ms_level"), F.col("scan_idx").cast("long").alias("local_idx"), r("rt"), F.col("window.target").alias("target"), F.size("mz").cast("long").alias("n"), total("mz").alias("mz_total"), total("intensity").alias("total"))


@query("o_s7_ingest", sql="select 'run' || label as file_id, count(*) + 1 as pieces, count(*) filter (where vec_id % 2 = 0) as ms1, count(*) filter (where vec_id % 2 = 1) as ms2, 64 * count(*) as points, 2::bigint as auxiliary from embeddings group by label")
def _(v: Views) -> DataFrame:
    found = archive.ingest(v.spark, written(v))
    count = lambda test: F.count(F.when(test, 1))
    return found.groupBy("file_id").agg(F.count(F.lit(1)).alias("pieces"), count(F.col("ms_level") == 1).alias("ms1"), count(F.col("ms_level") == 2).alias("ms2"), F.sum(F.coalesce(F.size("mz"), F.lit(0))).cast("long").alias("points"), F.sum(F.size("other")).cast("long").alias("auxiliary"))


@query("o_k1_archive", "points", sql=f", {CODES} select 'ms' || (scan_idx % 2 + 1) as section, count(distinct scan_idx) as records, sum(code)::bigint as code_total, count(*) as points from codes group by scan_idx % 2")
def _(v: Views) -> DataFrame:
    """An archive in place of an older one; sections are read by themselves."""
    path, folder = written(v), f"{new_folder(v.spark)}/archive"
    for preset in ("lossless", "near_0.001"):
        archive.compress(v.spark, path, folder, preset)
    one = lambda name: archive.section(v.spark, folder, name).agg(F.count(F.lit(1)).alias("records"), F.sum(F.aggregate("codes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("code_total"), F.sum(F.size("mz_steps")).cast("long").alias("points")).select(F.lit(name).alias("section"), "records", "code_total", "points")
    return one("ms1").unionByName(one("ms2"))


@query("o_k2_export", sql="select 'run' || label as file_id, count(*) as spectrum_count, 0::bigint as missing, 0::bigint as length_mismatch, 0.0::double as max_intensity_error, true as aux_equal, 2::bigint as aux_records, true as passed from embeddings group by label")
def _(v: Views) -> DataFrame:
    """Files to an archive, out again through their templates, and compared."""
    path, top = written(v), new_folder(v.spark)
    archive.compress(v.spark, path, f"{top}/archive")
    archive.export(v.spark, f"{top}/archive", f"{top}/out").count()
    told = archive.validate(v.spark, path, f"{top}/out/*.mzML")
    return told.select("file_id", "spectrum_count", (F.col("missing_original") + F.col("missing_rebuilt")).alias("missing"), "length_mismatch", F.round("max_intensity_error", 6).alias("max_intensity_error"), "aux_equal", "aux_records", "passed")


@query("o_k7_ms1_only", "points", sql="select scan_idx, count(*) as n, round(sum(intensity), 6) as total from points where scan_idx % 2 = 0 group by 1")
def _(v: Views) -> DataFrame:
    back = mzml.read_spectra(v.spark, written(v, files(v).where("ms_level = 1")))
    return back.where("ms_level = 1").select(scan_of(), F.size("mz").cast("long").alias("n"), total("intensity").alias("total"))


@query("o_s13_tables", sql="select k as kind, n_nationkey as id, n_name as name from nation, (values ('csv'), ('tsv'), ('json'), ('markdown')) t(k)")
def _(v: Views) -> DataFrame:
    n, top = v.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), new_folder(v.spark)
    readers.write_delimited(n, f"{top}/csv")
    readers.write_delimited(n, f"{top}/tsv", "\t")
    n.write.json(f"{top}/json")
    readers.markdown(n, ["id", "name"]).select("value").write.text(f"{top}/markdown")
    cells = readers.read_markdown(v.spark, f"{top}/markdown").where(F.get("cells", F.lit(0)) != "id").select(F.get("cells", F.lit(0)).alias("id"), F.get("cells", F.lit(1)).alias("name"))
    out = None
    for kind, df in (("csv", readers.read_delimited(v.spark, f"{top}/csv")), ("tsv", readers.read_delimited(v.spark, f"{top}/tsv", "\t")), ("json", v.spark.read.json(f"{top}/json")), ("markdown", cells)):
        one = df.select(F.lit(kind).alias("kind"), F.col("id").cast("int").alias("id"), "name")
        out = one if out is None else out.unionByName(one)
    return out


@query("o_k8_progress", sql="select 'job' || user_id % 50 as job, max(event_id % 100)::bigint as done, 100::bigint as total, count(*) as events from events group by 1")
def _(v: Views) -> DataFrame:
    """Progress lines that arrive in two portions, drained by a stream from where it stopped."""
    top = new_folder(v.spark)
    lines = v.table("events").select(F.concat(F.lit("job"), (F.col("user_id") % 50).cast("string")).alias("job"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.lit("s").alias("stage"), (F.col("event_id") % 100).alias("done"), F.lit(100).alias("total"), (F.col("event_id") % 2).alias("half"))
    for half in (0, 1):
        lines.where(F.col("half") == half).drop("half").write.mode("append").json(f"{top}/log")
        progress.drain(v.spark, f"{top}/log", f"{top}/seen", f"{top}/marks")
    return v.spark.read.schema(progress.EVENTS).parquet(f"{top}/seen").groupBy("job").agg(F.max("done").alias("done"), F.max("total").alias("total"), F.count(F.lit(1)).alias("events"))


SCAN_TOTALS = f", {CODES} select scan_idx, count(*) as n, sum(mz_q)::bigint as mz_total, sum(code)::bigint as total from codes where code > 0 group by 1"


def totals(points: DataFrame) -> DataFrame:
    return points.groupBy("scan_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("mz_q").alias("mz_total"), F.sum("code").alias("total"))


def exploded(rows: DataFrame) -> DataFrame:
    return rows.select("scan_idx", F.explode(F.arrays_zip("mz_q", "codes")).alias("z")).select("scan_idx", F.col("z.mz_q").alias("mz_q"), F.col("z.codes").alias("code"))


@query("o_c26_track_codec", "points", sql=SCAN_TOTALS)
def _(v: Views) -> DataFrame:
    a = island_arrays(v).select("scan_idx", "start", "track", "pos_in_track", "codes", "mz_q")
    return totals(exploded(codec.decode_tracks(codec.encode_tracks(a))))


@query("o_c26_reconstruct", "points", sql="select scan_idx, pos, round(case when intensity > 0 then round_even(intensity * 1000, 0) / 1000 else 0 end, 6) as intensity from points")
def _(v: Views) -> DataFrame:
    a = island_arrays(v).select("scan_idx", "start", "track", "pos_in_track", "codes", "mz_q")
    back = codec.decode_tracks(codec.encode_tracks(a))
    found = back.select("scan_idx", F.col("start").alias("array_start"), F.transform("codes", lambda c: c / 1000.0).alias("values"))
    return islands.scatter(found, v.points.select("scan_idx", "pos", "mz")).select("scan_idx", "pos", r("intensity"))


def scan_codes(v: Views) -> DataFrame:
    z = F.array_sort(F.collect_list(F.struct("pos", "mz_q", "code")))
    one = codes(v).where("code > 0").groupBy("scan_idx").agg(z.alias("z"))
    return one.select("scan_idx", F.transform("z", lambda s: s["mz_q"]).alias("mz_q"), F.transform("z", lambda s: s["code"]).alias("codes"))


@query("o_c36_zdpd", "points", sql=SCAN_TOTALS)
def _(v: Views) -> DataFrame:
    return totals(exploded(codec.decode_scans(codec.encode_scans(scan_codes(v)))))


@query("o_c36_stack_zdpd", "points", sql=SCAN_TOTALS)
def _(v: Views) -> DataFrame:
    return totals(codec.decode_stacks(codec.encode_stacks(codes(v).where("code > 0").select("scan_idx", "pos", "mz_q", "code"))))


@query("o_j24_infer_start", "points", "islands", sql="select scan_idx, array_start, array_start as inferred from islands")
def _(v: Views) -> DataFrame:
    m = islands.runs(v.points, F.col("intensity") > 0)
    z = F.transform(F.array_sort(F.collect_list(F.struct("pos", "mz"))), lambda s: s["mz"])
    found = m.groupBy("scan_idx", "run").agg(F.min("pos").alias("array_start"), z.alias("target"))
    both = found.join(v.scans.select("scan_idx", "mz"), "scan_idx")
    return both.select("scan_idx", "array_start", codec.infer_start(F.col("mz"), F.transform("target", lambda x: x + F.lit(1e-7))).alias("inferred"))


@query("o_c38_member_bytes")
def _(v: Views) -> DataFrame:
    """Estimated description bytes of each user's events as members of the first one's group."""
    g = v.table("events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("z"))
    ids, values = F.transform("z", lambda s: s["event_id"]), F.transform("z", lambda s: s["value"])
    later = F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))
    return g.select("user_id", F.size("z").cast("long").alias("members"), codec.member_bytes(F.get(ids, F.lit(0)), later, F.transform("z", lambda s: F.lit(0.0)), values).alias("bytes"))
