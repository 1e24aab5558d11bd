"""The engine's queries over the driver's tables, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions import stats
from ..operators import compare, encode, islands, matching, recovery, tables, xic
from ..operators.ranks import average_ranks, numbered
from ..sources import mzml
from ..sources.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TOL = 2000.0


def query(name: str, *views: str, sql: str | None = None):
    def add(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Views(spark, folder))
        if sql is not None:
            ORACLE[name] = f"{with_views(*views)}\n{sql}" if views else sql
        return f

    return add


def r(c: str | Column, places: int = 6) -> Column:
    name = c if isinstance(c, str) else None
    out = F.round(F.col(c) if isinstance(c, str) else c, places)
    return out.alias(name) if name else out


def long(c: str) -> Column:
    return F.col(c).cast("long").alias(c)


# ---------------------------------------------------------------- scans, points, quantisation


@query(
    "o_s4_scan_numbering",
    sql="select vec_id as scan_idx, label as win, row_number() over (partition by label order by vec_id) - 1 as local_idx, sum(16 * len(embedding)) over (partition by label order by vec_id)::bigint as raw_bytes from embeddings",
)
def _(v: Views) -> DataFrame:
    w = Window.partitionBy("win").orderBy("scan_idx")
    return v.scans.select("scan_idx", "win", (F.row_number().over(w) - 1).cast("long").alias("local_idx"), F.sum(16 * F.size("mz")).over(w).cast("long").alias("raw_bytes"))


@query(
    "o_s2_run_type",
    "centroid",
    sql="""select case when n = 0 then 'UNKNOWN' when d < 50 and n / d > 5 then 'DIA' else 'DDA' end as run_type, n as targets, d as distinct_targets
from (select count(*) as n, count(distinct round(mz, 2)) as d from (select * from centroid where idx < 200))""",
)
def _(v: Views) -> DataFrame:
    rows = v.centroid.select(F.lit("run").alias("file_id"), F.col("idx").alias("spectrum_index"), F.lit(2).alias("ms_level"), F.struct(F.col("mz").alias("target")).alias("window"))
    return mzml.file_type(rows).select(F.col("file_type").alias("run_type"), F.col("n").alias("targets"), F.col("d").alias("distinct_targets"))


@query(
    "o_s11_windows",
    "points",
    sql="select win, count(distinct scan_idx) as scans, min(scan_idx) as first_scan, max(scan_idx) as last_scan, count(*) as points from points group by win",
)
def _(v: Views) -> DataFrame:
    return v.scans.groupBy("win").agg(F.count(F.lit(1)).alias("scans"), F.min("scan_idx").alias("first_scan"), F.max("scan_idx").alias("last_scan"), F.sum(F.size("mz")).cast("long").alias("points"))


@query("o_p1_quantise", "points", sql="select scan_idx, pos, round_even(mz * 1e6::double, 0)::bigint as mz_q, round(round_even(mz * 1e6::double, 0)::bigint / 1e6::double, 6) as back from points")
def _(v: Views) -> DataFrame:
    q = v.points.select("scan_idx", "pos", num.quantise(F.col("mz")).alias("mz_q"))
    return q.withColumn("back", r(num.dequantise(F.col("mz_q"))))


SCALED = "scaled as (select scan_idx, win, pos, intensity * 1e9::double as x from points)"


@query(
    "o_c7_szdpd",
    "points",
    sql=f""", {SCALED}, p as (select win, case when bool_or(abs(x - round_even(x, 0)) > 1e-9) then 10 else 1 end::bigint as precision from scaled group by win)
select scan_idx, pos, precision, (case when x * precision <= 2147483647 then round_even(x * precision, 0) else -round_even(log2(x * precision) * 1e5, 0) end)::bigint as code from scaled join p using (win)""",
)
def _(v: Views) -> DataFrame:
    scaled = v.points.select("scan_idx", "win", "pos", (F.col("intensity") * 1e9).alias("x"))
    p = scaled.groupBy("win").agg(F.when(num.has_fraction(F.col("x")), 10).otherwise(1).cast("long").alias("precision"))
    return scaled.join(p, "win").select("scan_idx", "pos", "precision", num.log_code(F.col("x"), F.col("precision")).alias("code"))


@query(
    "o_c6_near_lossless",
    "points",
    sql="select scan_idx, pos, least(greatest(round_even(intensity / case when m > 0 then m else 1 end * 4095, 0), 0), 4095)::bigint as code from (select *, max(intensity) over (partition by scan_idx) as m from points)",
)
def _(v: Views) -> DataFrame:
    high = F.max("intensity").over(Window.partitionBy("scan_idx"))
    return v.points.withColumn("m", high).select("scan_idx", "pos", num.level_code(F.col("intensity"), F.col("m"), F.lit(12)).alias("code"))


@query(
    "o_c8_adaptive_bits",
    "points",
    sql=""", s as (select *, max(intensity) over (partition by scan_idx) as m, count(*) filter (where intensity > 0) over (partition by scan_idx) as n from points),
b as (select *, case when n > 30 then 20 when n >= 10 then 16 else 12 end as bits from s)
select scan_idx, pos, bits, least(greatest(round_even(intensity / case when m > 0 then m else 1 end * (pow(2, bits) - 1), 0), 0), pow(2, bits) - 1)::bigint as code from b""",
)
def _(v: Views) -> DataFrame:
    w = Window.partitionBy("scan_idx")
    s = v.points.withColumn("m", F.max("intensity").over(w)).withColumn("n", F.count(F.when(F.col("intensity") > 0, 1)).over(w))
    s = s.withColumn("bits", F.when(F.col("n") > 30, 20).when(F.col("n") >= 10, 16).otherwise(12))
    return s.select("scan_idx", "pos", "bits", num.level_code(F.col("intensity"), F.col("m"), F.col("bits")).alias("code"))


@query(
    "o_c9_equal_fidelity",
    "points",
    sql=""", p as (select win, case when bool_or(abs(intensity - round_even(intensity, 0)) > 1e-9) then 10 else 1 end::bigint as precision from points group by win)
select scan_idx, pos, round_even(intensity * precision, 0)::bigint as code from points join p using (win)""",
)
def _(v: Views) -> DataFrame:
    p = v.points.groupBy("win").agg(F.when(num.has_fraction(F.col("intensity")), 10).otherwise(1).cast("long").alias("precision"))
    return v.points.join(p, "win").select("scan_idx", "pos", F.rint(F.col("intensity") * F.col("precision")).cast("long").alias("code"))


@query("o_p12_mode", "points", sql="select win, case when z > 0.2 then 'profile' when z > 0 then 'mixed' else 'centroid' end as mode from (select win, avg((intensity = 0)::int) as z from points group by win)")
def _(v: Views) -> DataFrame:
    z = v.points.groupBy("win").agg(F.avg((F.col("intensity") == 0).cast("int")).alias("z"))
    return z.select("win", F.when(F.col("z") > 0.2, "profile").when(F.col("z") > 0, "mixed").otherwise("centroid").alias("mode"))


@query("o_p14_samples", sql="select n, list_sort(list_distinct(list_transform(range(0, 9), lambda i: round_even(i * (n - 1) / 8.0::double, 0)::bigint))) as at from (select count(*)::bigint as n from embeddings)")
def _(v: Views) -> DataFrame:
    n = v.scans.agg(F.count(F.lit(1)).alias("n"))
    return n.select("n", F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.rint(i * (F.col("n") - 1) / 8.0).cast("long")))).alias("at"))


# ---------------------------------------------------------------- islands


ISLAND = ["scan_idx", "array_start", "n_points", "center_mz", "mz_start", "max_intensity", "sum_intensity"]


def told(found: DataFrame) -> DataFrame:
    return found.select("scan_idx", long("array_start"), "n_points", r("center_mz"), r("mz_start"), r("max_intensity"), r("sum_intensity"))


TOLD = "scan_idx, array_start::bigint as array_start, n_points, round(center_mz, 6) as center_mz, round(mz_start, 6) as mz_start, round(max_intensity, 6) as max_intensity, round(sum_intensity, 6) as sum_intensity"


@query("o_w1_islands_a", "points", "islands", sql=f"select {TOLD} from islands")
def _(v: Views) -> DataFrame:
    return told(islands.islands_positive(v.points))


@query(
    "o_w2_islands_b",
    "points",
    sql=f""", a as (select *, lag(intensity, 1) over w as l1, lag(intensity, 2) over w as l2, lead(intensity, 1) over w as r1, lead(intensity, 2) over w as r2,
  first_value(intensity) over (partition by scan_idx order by pos rows between unbounded preceding and unbounded following) as f, last_value(intensity) over (partition by scan_idx order by pos rows between unbounded preceding and unbounded following) as e,
  max(intensity) over (partition by scan_idx order by pos rows between 5 preceding and 1 preceding) as ml, max(intensity) over (partition by scan_idx order by pos rows between 1 following and 5 following) as mr
  from points window w as (partition by scan_idx order by pos)),
b as (select *, sum((l1 is not null and r1 is not null and intensity < l1 and intensity < coalesce(l2, f) and intensity < r1 and intensity < coalesce(r2, e) and intensity < greatest(ml, mr) * 0.01::double)::int) over (partition by scan_idx order by pos) as segment from a),
c as (select *, count(*) over s as n, min(case when intensity > 0 then pos end) over s as lo, max(case when intensity > 0 then pos end) over s as hi from b window s as (partition by scan_idx, segment)),
d as (select *, coalesce(n >= 3 and pos between lo and hi and hi - lo + 1 >= 3, false) as kept from c),
e2 as (select *, bool_or(kept) over (partition by scan_idx) as alive from d),
rest as (select *, pos - row_number() over (partition by scan_idx order by pos) as run from e2 where alive and not kept and intensity > 0),
u as (select scan_idx, segment as g, pos, mz, intensity, 0 as kind from e2 where kept union all select scan_idx, run, pos, mz, intensity, 1 from rest),
i as (select scan_idx, min(pos) as array_start, count(*) as n_points, case when sum(intensity) > 0 then sum(mz * intensity) / sum(intensity) else avg(mz) end as center_mz, min(mz) as mz_start, max(intensity) as max_intensity, sum(intensity) as sum_intensity from u group by scan_idx, kind, g)
select {TOLD} from i""",
)
def _(v: Views) -> DataFrame:
    return told(islands.islands_valley(v.points))


@query("o_w3_strategy", "points", sql="select scan_idx, count(*) as n_points, round(avg((intensity = 0)::int), 6) as zero_fraction, case when count(*) < 3 or avg((intensity = 0)::int) > 0.2 then 'A' else 'B' end as strategy from points group by scan_idx")
def _(v: Views) -> DataFrame:
    return islands.zero_share(v.points).select("scan_idx", "n_points", r("zero_fraction"), "strategy")


@query(
    "o_w4_island_features",
    "points",
    "islands",
    sql="select win, count(*) as islands, round(avg(n_points), 6) as mean_points, round(sum(sum_intensity), 6) as total, round(arg_max(center_mz, max_intensity), 6) as strongest_mz from islands group by win",
)
def flagship(v: Views) -> DataFrame:
    found = islands.islands_positive(v.points, ["win", "scan_idx"])
    return found.groupBy("win").agg(F.count(F.lit(1)).alias("islands"), r(F.avg("n_points")).alias("mean_points"), r(F.sum("sum_intensity")).alias("total"), r(F.max_by("center_mz", "max_intensity")).alias("strongest_mz"))


@query(
    "o_w5_grid_consistency",
    "points",
    "islands",
    sql="""select grid, count(*) as n from (select case when abs(a.mz_start - b.mz_start) < 1e-6 then 'strict' else 'relaxed' end as grid from islands a join islands b on b.scan_idx = a.scan_idx + 1 and a.n_points = b.n_points and a.array_start = b.array_start) group by 1""",
)
def _(v: Views) -> DataFrame:
    i = islands.islands_positive(v.points).withColumn("step", F.lit(0.01))
    a = i.select((F.col("scan_idx") + 1).alias("scan_idx"), "array_start", "n_points", F.col("mz_start").alias("mz_start_a"), F.col("step").alias("mz_step_a"))
    b = i.select("scan_idx", "array_start", "n_points", F.col("mz_start").alias("mz_start_b"), F.col("step").alias("mz_step_b"))
    return islands.grid_consistency(a.join(b, ["scan_idx", "array_start", "n_points"])).groupBy("grid").agg(F.count(F.lit(1)).alias("n"))


@query(
    "o_a31_sparse_stats",
    "points",
    "islands",
    sql="""select round(z.z, 6) as avg_zero_fraction, z.n as scans, i.n as islands, round(i.s, 6) as short_fraction, round(i.n / z.n, 6) as islands_per_scan, z.z >= 0.35 and i.n / z.n >= 5000 and i.s >= 0.5 as bypass
from (select avg(z) as z, count(*) as n from (select avg((intensity = 0)::int) as z from points group by scan_idx)) z, (select count(*) as n, avg((n_points <= 1)::int) as s from islands) i""",
)
def _(v: Views) -> DataFrame:
    out = islands.sparse_statistics(v.points, islands.islands_positive(v.points))
    return out.select(r("avg_zero_fraction"), "scans", "islands", r("short_fraction"), r("islands_per_scan"), "bypass")


@query("o_c23_sparse_bypass", "points", "islands", sql="select scan_idx, count(*) as kept, sum(n_points)::bigint as points from islands where n_points > 1 group by scan_idx")
def _(v: Views) -> DataFrame:
    return islands.islands_positive(v.points, least=2).groupBy("scan_idx").agg(F.count(F.lit(1)).alias("kept"), F.sum("n_points").cast("long").alias("points"))


@query("o_j20_orphans", "points", "islands", sql="select p.scan_idx, p.pos, round(p.intensity, 6) as intensity from points p where intensity > 0 and not exists (select 1 from islands i where i.scan_idx = p.scan_idx and i.n_points >= 3 and p.pos >= i.array_start and p.pos < i.array_start + i.n_points)")
def _(v: Views) -> DataFrame:
    return islands.orphans(v.points, islands.islands_positive(v.points, least=3)).select("scan_idx", "pos", r("intensity"))


@query(
    "o_j19_complement_runs",
    "points",
    "islands",
    sql=""", s as (select scan_idx, pos from points p where not exists (select 1 from islands i where i.scan_idx = p.scan_idx and p.pos >= i.array_start and p.pos < i.array_start + i.n_points))
select scan_idx, min(pos)::bigint as gap_start, count(*) as gap_points from (select *, pos - row_number() over (partition by scan_idx order by pos) as g from s) group by scan_idx, g""",
)
def _(v: Views) -> DataFrame:
    sizes = v.scans.select("scan_idx", F.size("mz").cast("long").alias("n"))
    return islands.complement(islands.islands_positive(v.points), sizes)


@query(
    "o_w14_run_merge",
    "points",
    sql="""select scan_idx, min(b)::bigint * 4 as array_start, count(*)::bigint * 4 as n_points, count(*) as members from (select *, b - row_number() over (partition by scan_idx order by b) as g from (select scan_idx, pos // 4 as b from points group by 1, 2 having max(intensity) > 0.1)) group by scan_idx, g""",
)
def _(v: Views) -> DataFrame:
    spans = v.points.groupBy("scan_idx", F.floor(F.col("pos") / 4).alias("b")).agg(F.max("intensity").alias("m")).where("m > 0.1").select("scan_idx", (F.col("b") * 4).alias("array_start"), F.lit(4).cast("long").alias("n_points"))
    return islands.merge_adjacent(spans).select("scan_idx", long("array_start"), long("n_points"), "members")


@query("o_j22_scatter", "points", sql="select scan_idx, pos, round(intensity, 6) as intensity from points")
def _(v: Views) -> DataFrame:
    m = islands.runs(v.points, F.col("intensity") > 0)
    found = m.groupBy("scan_idx", "run").agg(F.min("pos").alias("array_start"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "intensity"))), lambda s: s["intensity"]).alias("values")).drop("run")
    return islands.scatter(found, v.points.select("scan_idx", "pos", "mz")).select("scan_idx", "pos", r("intensity"))


@query("o_j23_overlay", "points", sql="select scan_idx, pos, case when pos % 5 = 0 then pos * 2.0::double else round(intensity, 6) end as intensity from points")
def _(v: Views) -> DataFrame:
    twice = F.explode(F.array(F.lit(1), F.lit(2)))
    patch = v.points.where("pos % 5 = 0").select("scan_idx", "pos", twice.alias("ord")).withColumn("intensity", F.col("pos") * F.col("ord").cast("double"))
    return islands.overlay(v.points.select("scan_idx", "pos", "intensity"), patch).select("scan_idx", "pos", r("intensity"))


# ---------------------------------------------------------------- matching and tracks


NEAR = f""", near as (
  select c.scan_idx as pair, c.idx as curr, c.mz as curr_mz, unnest([(select {{'m': p.mz, 'i': p.idx}} from centroid p where p.scan_idx = c.scan_idx - 1 and p.mz < c.mz order by p.mz desc, p.idx desc limit 1),
    (select {{'m': p.mz, 'i': p.idx}} from centroid p where p.scan_idx = c.scan_idx - 1 and p.mz >= c.mz order by p.mz, p.idx limit 1)]) as p from centroid c),
cand as (select pair, p.i as prev, curr, abs(curr_mz - p.m) / p.m * 1e6 as ppm from near where p is not null and abs(curr_mz - p.m) / p.m * 1e6 < {TOL})"""


@query("o_j14_ppm_neighbours", "centroid", sql=f"{NEAR} select pair, prev, curr, round(ppm, 3) as ppm from cand")
def _(v: Views) -> DataFrame:
    return matching.neighbours(v.centroid, TOL).select("pair", "prev", "curr", r("ppm", 3))


def assigned(v: Views) -> DataFrame:
    return matching.mutual_best(matching.neighbours(v.centroid, TOL), ["pair"], "prev", "curr", [F.col(c) for c in ("ppm", "prev", "curr")])


@query("o_j16_greedy_match")
def _(v: Views) -> DataFrame:
    return assigned(v).select("pair", "prev", "curr", r("ppm", 3))


@query("o_w6_tracks")
def _(v: Views) -> DataFrame:
    from ..sources.shared import ensure_checkpoint_dir

    ensure_checkpoint_dir(v.spark)
    found = matching.tracks(v.centroid.select("idx", "scan_idx", "mz", "intensity"), assigned(v))
    return found.groupBy("track_start").agg(F.count(F.lit(1)).alias("length"), F.min("scan_idx").alias("first_scan"), r(F.avg("mz")).alias("mean_mz"), F.max("intensity").alias("max_intensity"))


@query("o_j17_features")
def _(v: Views) -> DataFrame:
    base = v.table("events").where("value > 0").select(F.floor(F.col("user_id") / 50).alias("file"), F.col("event_id").alias("feature_idx"), F.col("value").alias("mz"), (F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600.0).alias("rt"), (F.col("user_id") + 1).cast("double").alias("intensity"))
    rebuilt = base.where("feature_idx % 7 <> 0").withColumn("mz", F.col("mz") * 1.000001).withColumn("rt", F.col("rt") + 0.5)
    found = matching.match_features(base, rebuilt, ["file"])
    n = base.groupBy("file").agg(F.count(F.lit(1)).alias("original")).join(rebuilt.groupBy("file").agg(F.count(F.lit(1)).alias("rebuilt")), "file").join(found.groupBy("file").agg(F.count(F.lit(1)).alias("matched")), "file")
    return n.select("file", "original", "rebuilt", "matched", *matching.match_quality(F.col("original"), F.col("rebuilt"), F.col("matched")))


# ---------------------------------------------------------------- encodings


CODES = "codes as (select scan_idx, win, pos, round_even(mz * 1e6::double, 0)::bigint as mz_q, round_even(intensity * 1000, 0)::bigint as code from points)"


def codes(v: Views) -> DataFrame:
    return v.points.select("scan_idx", "win", "pos", "intensity", num.quantise(F.col("mz")).alias("mz_q"), F.rint(F.col("intensity") * 1000).cast("long").alias("code"))


@query(
    "o_w8_delta_zigzag",
    "points",
    sql=f""", {CODES}, d as (select *, code - lag(code, 1, 0) over (partition by scan_idx order by pos) as delta from codes), e as (select *, delta - lag(delta, 1, 0) over (partition by scan_idx order by pos) as delta2 from d)
select scan_idx, pos, delta, delta2, case when delta < 0 then -2 * delta - 1 else 2 * delta end as zz, case when delta2 < 0 then -2 * delta2 - 1 else 2 * delta2 end as zz2 from e""",
)
def _(v: Views) -> DataFrame:
    return encode.deltas(codes(v), "code", ["scan_idx"], ["pos"]).select("scan_idx", "pos", "delta", "delta2", "zz", "zz2")


@query("o_w9_cumsum_roundtrip", "points", sql=f", {CODES} select scan_idx, pos, code as value from codes")
def _(v: Views) -> DataFrame:
    d = encode.deltas(codes(v), "code", ["scan_idx"], ["pos"])
    back = encode.undelta(d.select("scan_idx", "pos", num.unzigzag(F.col("zz2")).alias("value")), "value", ["scan_idx"], ["pos"], 2)
    return back.select("scan_idx", "pos", "value")


@query(
    "o_c11_zero_rle",
    "points",
    sql=f""", {CODES}, g as (select *, code = 0 as z, row_number() over (partition by scan_idx order by pos) - row_number() over (partition by scan_idx, code = 0 order by pos) as run from codes),
s as (select *, count(*) over (partition by scan_idx, z, run) as n, min(pos) over (partition by scan_idx, z, run) as f from g)
select scan_idx, pos, case when z and n >= 4 then '0,' || n else (code + 1)::varchar end as codes from s where not (z and n >= 4) or pos = f""",
)
def _(v: Views) -> DataFrame:
    return encode.zero_runs(codes(v), "code", ["scan_idx"], "pos").select("scan_idx", "pos", F.concat_ws(",", F.transform("codes", lambda x: x.cast("string"))).alias("codes"))


WIDTH = "case when {0} <= 0 then 0 else length(bin({0})) end"


@query(
    "o_c13_sizes",
    "points",
    sql=f""", {CODES}, s as (select scan_idx, count(*) as n, count(*) filter (where code <> 0) as nonzero, max({WIDTH.format("(2 * code)::bigint")})::int as bits from codes group by scan_idx)
select scan_idx, n, nonzero, bits, (ceil(bits * n / 8.0) + 8)::bigint as dense_bytes, (12 + ceil({WIDTH.format("(n - 1)")} * nonzero / 8.0) + 8 + ceil(bits * nonzero / 8.0) + 8)::bigint as sparse_bytes, least((ceil(bits * n / 8.0) + 8)::bigint, (12 + ceil({WIDTH.format("(n - 1)")} * nonzero / 8.0) + 8 + ceil(bits * nonzero / 8.0) + 8)::bigint) as best_bytes from s""",
)
def _(v: Views) -> DataFrame:
    return encode.stream_sizes(codes(v), "code", ["scan_idx"])


@query(
    "o_c17_sparse_l0",
    "points",
    sql=f", {CODES} select scan_idx, pos, code, pos - lag(pos, 1, 0) over (partition by scan_idx order by pos) as gap from codes where code <> 0",
)
def _(v: Views) -> DataFrame:
    return encode.sparse_stream(codes(v), "code", ["scan_idx"], "pos").select("scan_idx", "pos", "code", "gap")


@query(
    "o_c18_transform_choice",
    "points",
    sql=f""", {CODES}, d as (select *, mz_q - lag(mz_q, 1, 0) over (partition by scan_idx order by pos) as delta from codes), e as (select *, delta - lag(delta, 1, 0) over (partition by scan_idx order by pos) as delta2 from d),
b as (select scan_idx, max({WIDTH.format("(2 * mz_q)")})::int as raw_bits, max({WIDTH.format("(case when delta < 0 then -2 * delta - 1 else 2 * delta end)")})::int as delta_bits, max({WIDTH.format("(case when delta2 < 0 then -2 * delta2 - 1 else 2 * delta2 end)")})::int as delta2_bits from e group by scan_idx)
select *, case when raw_bits <= delta_bits and raw_bits <= delta2_bits then 'raw' when delta_bits <= delta2_bits then 'delta' else 'delta2' end as choice from b""",
)
def _(v: Views) -> DataFrame:
    return encode.transform_choice(codes(v), "mz_q", ["scan_idx"], ["pos"]).select("scan_idx", "raw_bits", "delta_bits", "delta2_bits", "choice")


@query(
    "o_c29_ms2_dictionary",
    "points",
    sql=f", {CODES} select win, mz_q, count(*) as length, sum(code)::bigint as total from codes where code > 0 group by win, mz_q",
)
def _(v: Views) -> DataFrame:
    return codes(v).where("code > 0").groupBy("win", "mz_q").agg(F.count(F.lit(1)).alias("length"), F.sum("code").alias("total"))


@query(
    "o_t3_top_entries",
    "points",
    sql=f""", {CODES}, e as (select win, mz_q, count(*) as length, sum(code)::bigint as total, count(distinct scan_idx) as s from codes where code > 0 group by win, mz_q)
select * exclude (s) from (select *, row_number() over (partition by win order by length desc, total desc, mz_q) as rank from e where s = length and length >= 3) where rank <= 96""",
)
def _(v: Views) -> DataFrame:
    e = encode.dictionary(codes(v).where("code > 0").withColumn("intensity", F.col("code")), ["win"])
    return encode.top_entries(e, ["win"], 96).select("win", "mz_q", "length", "total", long("rank"))


@query(
    "o_c30_entry_classes",
    "points",
    sql=f""", {CODES}, e as (select win, mz_q, count(*) as length, sum(code) as total, count(distinct scan_idx) as s from codes where code > 0 group by win, mz_q),
t as (select win, mz_q, row_number() over (partition by win order by length desc, total desc, mz_q) as rank from e where s = length and length >= 3)
select win, class, count(*) as entries, sum(length)::bigint as points from (select e.*, case when t.rank <= 32 then 'dense' when length >= 2 then 'track' else 'sparse' end as class from e left join t using (win, mz_q)) group by win, class""",
)
def _(v: Views) -> DataFrame:
    e = encode.dictionary(codes(v).where("code > 0").withColumn("intensity", F.col("code")), ["win"])
    return encode.entry_classes(e, ["win"]).groupBy("win", "class").agg(F.count(F.lit(1)).alias("entries"), F.sum("length").alias("points"))


@query(
    "o_w13_follow_deltas",
    "points",
    sql=f", {CODES} select scan_idx, win, pos, mz_q, scan_idx - lag(scan_idx) over w as scan_gap, code - lag(code) over w as code_delta from codes where code > 0 window w as (partition by win, mz_q order by scan_idx, pos)",
)
def _(v: Views) -> DataFrame:
    return encode.follow_deltas(codes(v).where("code > 0"), ["win"], "code").select("scan_idx", "win", "pos", "mz_q", "scan_gap", "code_delta")


@query(
    "o_c31_anchors",
    "points",
    sql=f""", {CODES}, e as (select distinct win, mz_q * 12 as mz_q from codes where code > 0), d as (select *, mz_q - lag(mz_q) over (partition by win order by mz_q) as d from e)
select win, min(mz_q) as anchor, max(d) as max_delta, max(mz_q) > 4294967295 as beyond_u32 from d group by win""",
)
def _(v: Views) -> DataFrame:
    e = codes(v).where("code > 0").select("win", (F.col("mz_q") * 12).alias("mz_q")).distinct()
    return encode.offset_anchors(e, ["win"])


@query("o_c32_dda_blocks", "points", sql="select scan_idx // 64 as block, count(distinct scan_idx) as scans, count(*) filter (where intensity > 0) as points from points group by 1")
def _(v: Views) -> DataFrame:
    return v.points.groupBy(F.floor(F.col("scan_idx") / 64).alias("block")).agg(F.count_distinct("scan_idx").alias("scans"), F.count(F.when(F.col("intensity") > 0, 1)).alias("points"))


@query("o_t9_stack_merge", "points", sql=f", {CODES} select scan_idx, pos, scan_idx // 256 as block, scan_idx % 256 as tag, row_number() over (partition by scan_idx // 256 order by mz_q, scan_idx, pos) - 1 as place from codes where code > 0")
def _(v: Views) -> DataFrame:
    return encode.stack_blocks(codes(v).where("code > 0")).select("scan_idx", "pos", "block", "tag", long("place"))


ISLAND_ARRAYS = f""", {CODES}, m as (select *, pos - row_number() over (partition by scan_idx order by pos) as run from codes where code > 0),
f as (select scan_idx, win, min(pos) as start, list(code order by pos) as codes, list(mz_q order by pos) as mz_q, count(*) as n from m group by scan_idx, win, run),
isl as (select *, row_number() over (partition by win, start order by scan_idx) as pos_in_track from f)"""


def island_arrays(v: Views) -> DataFrame:
    m = islands.runs(codes(v), F.col("code") > 0)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "code", "mz_q")))
    found = m.groupBy("scan_idx", "win", "run").agg(F.min("pos").alias("start"), ordered.alias("z")).withColumn("codes", F.transform("z", lambda s: s["code"])).withColumn("mz_q", F.transform("z", lambda s: s["mz_q"]))
    # islands that start at the same place of a window's scans play the part of tracks
    w = Window.partitionBy("win", "start").orderBy("scan_idx")
    return found.select("scan_idx", "start", "codes", "mz_q", F.concat_ws("-", F.col("win").cast("string"), F.col("start").cast("string")).alias("track"), F.row_number().over(w).alias("pos_in_track"), F.size("codes").alias("n_points"))


ZIGZAG_BYTES = "list_sum(list_transform({0}, lambda x: case when x = 0 then 1 else ceil(length(bin(case when x >= 0 then 2 * x else -2 * x - 1 end)) / 8.0)::int end))"


@query(
    "o_w10_delta_reference",
    "points",
    sql=f"""{ISLAND_ARRAYS}, r as (select *, {ZIGZAG_BYTES.format("codes")} as full_bytes from isl),
o as (select a.scan_idx, a.start, a.full_bytes, a.pos_in_track - b.pos_in_track as back, abs(a.n - b.n) as apart, list_transform(a.codes, lambda x, i: x - coalesce(b.codes[i], 0)) as d from r a join r b on a.win = b.win and a.start = b.start and b.pos_in_track between a.pos_in_track - 4 and a.pos_in_track - 1 and abs(a.n - b.n) <= 1),
c as (select *, {ZIGZAG_BYTES.format("d")} as bytes, list_sum(list_transform(d, lambda x: abs(x)))::double / len(d) as mad from o),
best as (select scan_idx, start, arg_min(struct_pack(bytes := bytes, back := back), (bytes, mad, apart, back)) as x from c where bytes < full_bytes group by 1, 2)
select r.scan_idx, r.start, r.full_bytes::int as full_bytes, x.bytes::int as delta_bytes, x.back::int as back from r left join best using (scan_idx, start)""",
)
def _(v: Views) -> DataFrame:
    out = encode.reference_choice(island_arrays(v))
    return out.select("scan_idx", "start", "full_bytes", F.col("reference.bytes").alias("delta_bytes"), F.col("reference.back").alias("back"))


@query(
    "o_w11_mz_model",
    "points",
    sql=f"""{ISLAND_ARRAYS}, p as (select *, lag(mz_q) over (partition by win, start order by pos_in_track) as prev from isl),
d as (select *, case when prev is not null and len(prev) = n then list_transform(mz_q, lambda x, i: x - prev[i]) end as diff from p),
c as (select *, list_max(diff) - list_min(diff) as spread from d)
select scan_idx, start, diff[1] as "offset", case when diff is not null and spread = 0 then 'PREV_OFFSET' when diff is not null and length(bin(spread * 2)) * n + 64 < length(bin(list_max(mz_q))) * n then 'RESIDUAL' else 'RAW' end as model from c""",
)
def _(v: Views) -> DataFrame:
    return encode.grid_model(island_arrays(v)).select("scan_idx", "start", "offset", "model")


@query(
    "o_j21_cross_candidates",
    "points",
    "islands",
    sql=""", n as (select scan_idx, n_points, row_number() over (partition by scan_idx order by array_start) as island_idx from islands),
c as (select a.scan_idx, a.island_idx, b.island_idx as ref, abs(a.n_points - b.n_points) as apart, row_number() over (partition by a.scan_idx, a.island_idx, b.n_points order by b.island_idx desc) as k from n a join n b on a.scan_idx = b.scan_idx and b.island_idx < a.island_idx and abs(a.n_points - b.n_points) <= 1)
select scan_idx, island_idx, ref, apart, choice from (select *, row_number() over (partition by scan_idx, island_idx order by apart, ref desc) as choice from c where k <= 4) where choice <= 4""",
)
def _(v: Views) -> DataFrame:
    w = Window.partitionBy("scan_idx").orderBy("array_start")
    n = islands.islands_positive(v.points).select("scan_idx", "n_points", F.row_number().over(w).cast("long").alias("island_idx"))
    return encode.cross_candidates(n).select("scan_idx", "island_idx", "ref", "apart", long("choice"))


@query("o_c35_blob_dedupe", sql="select doc_id, sha1(text) as sha1, min(doc_id) over (partition by sha1(text)) as first, count(*) over (partition by sha1(text)) as copies, doc_id = min(doc_id) over (partition by sha1(text)) as kept from documents")
def _(v: Views) -> DataFrame:
    d = v.table("documents").select("doc_id", F.col("text").cast("binary").alias("blob"))
    return encode.dedupe_blobs(d, "blob", "doc_id").select("doc_id", "sha1", "first", "copies", "kept")


@query("o_c34_metadata_strip", sql="select page_id, length(regexp_replace(html, '(<p\\b[^>]*>)[^<]*(</p>)', '\\1\\2', 'g')) as stripped from pages")
def _(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", F.length(mzml.skeleton(F.col("html"), "p")).cast("long").alias("stripped"))


@query("o_c2_backends")
def _(v: Views) -> DataFrame:
    d = v.scans.select(encode.pack_doubles(F.col("intensity"), planes=True).alias("payload"))
    return encode.codec_benchmark(d, "payload").groupBy("codec").agg(F.sum("raw_bytes").alias("raw_bytes"), F.sum("packed_bytes").alias("packed_bytes"))


@query("o_c3_byte_planes", "points", sql="select scan_idx, 64::bigint as n, true as same from points group by scan_idx")
def _(v: Views) -> DataFrame:
    packed = v.scans.select("scan_idx", "intensity", encode.compress(encode.pack_doubles(F.col("intensity"), planes=True), "zlib-6").alias("b"))
    back = encode.unpack_doubles(encode.decompress(F.col("b"), "zlib-6"), planes=True)
    return packed.withColumn("back", back).select("scan_idx", F.size("back").cast("long").alias("n"), (F.col("back") == F.col("intensity")).alias("same"))


# ---------------------------------------------------------------- round-trip comparison


def aligned(v: Views) -> DataFrame:
    return compare.align(v.scans, v.recon, ["win"], "scan_idx")


ERR = """, e as (select p.scan_idx, p.win, abs(p.mz - q.mz) as m, abs(p.intensity - q.intensity) as d, case when p.intensity <> 0 then abs(p.intensity - q.intensity) / p.intensity end as x, p.intensity as a, q.intensity as b from points p join recon q using (scan_idx, pos)),
s as (select scan_idx, any_value(win) as win, max(m) as max_mz_error, avg(m) as mean_mz_error, max(d) as max_intensity_error, avg(d) as mean_intensity_error, coalesce(quantile_cont(x, 0.95), 0) as p95_relative_error, sum(a) as tic_a, sum(b) as tic_b, count(*) filter (where a <> 0) as nonzero_a, count(*) filter (where b <> 0) as nonzero_b,
  case when sum(a) = 0 then case when sum(b) = 0 then 0 else 'inf'::double end else abs(sum(b) - sum(a)) / sum(a) end as tic_error from e group by scan_idx)"""


@query(
    "o_a1_spectrum_errors",
    "points",
    "recon",
    sql=f"""{ERR} select scan_idx, round(max_mz_error, 9) as max_mz_error, round(max_intensity_error, 6) as max_intensity_error, round(mean_intensity_error, 6) as mean_intensity_error, round(p95_relative_error, 6) as p95_relative_error, round(tic_a, 6) as tic_a, round(tic_b, 6) as tic_b, nonzero_a, nonzero_b, round(tic_error, 6) as tic_error from s""",
)
def _(v: Views) -> DataFrame:
    e = compare.spectrum_errors(aligned(v))
    return e.select(F.col("scan_idx_a").alias("scan_idx"), r("max_mz_error", 9), r("max_intensity_error"), r("mean_intensity_error"), r("p95_relative_error"), r("tic_a"), r("tic_b"), long("nonzero_a"), long("nonzero_b"), r("tic_error"))


@query(
    "o_a2_rollup",
    "points",
    "recon",
    sql=f"""{ERR} select win, count(*) as spectrum_count, count(*) filter (where nonzero_a <> nonzero_b) as nonzero_mismatch, count(*) filter (where max_intensity_error > 0) as any_intensity_error, round(max(max_intensity_error), 6) as max_intensity_error,
round(avg(mean_intensity_error), 6) as mean_intensity_error_mean, round(quantile_cont(mean_intensity_error, 0.5), 6) as mean_intensity_error_median, round(quantile_cont(p95_relative_error, 0.95), 6) as p95_relative_error_p95, round(quantile_cont(tic_error, 0.99), 6) as tic_error_p99 from s group by win""",
)
def _(v: Views) -> DataFrame:
    pairs = aligned(v)
    out = compare.rollup(pairs, compare.spectrum_errors(pairs), ["win"])
    return out.select("win", "spectrum_count", "nonzero_mismatch", "any_intensity_error", r("max_intensity_error"), r("mean_intensity_error_mean"), r("mean_intensity_error_median"), r("p95_relative_error_p95"), r("tic_error_p99"))


@query("o_m10_verdict", "points", "recon", sql=f"{ERR} select win, max(max_mz_error) <= 5e-7 + 1e-10 and max(max_intensity_error) <= 0.05 + 1e-10 and count(*) filter (where nonzero_a <> nonzero_b) = 0 as strict, max(max_mz_error) <= 5e-7 + 1e-10 and max(max_intensity_error) <= 0.05 + 1e-10 as weak from s group by win")
def _(v: Views) -> DataFrame:
    pairs = aligned(v)
    out = compare.rollup(pairs, compare.spectrum_errors(pairs), ["win"])
    strict = compare.verdict(out, F.lit(False), F.lit(True)).withColumnRenamed("passed", "strict")
    return compare.verdict(strict, F.lit(False), F.lit(True), full=False).select("win", "strict", F.col("passed").alias("weak"))


@query("o_m12_exact_fraction", "points", "recon", sql="select win, round(avg(same::int), 6) as exact_fraction, count(*) as scans from (select scan_idx, any_value(p.win) as win, bool_and(p.mz = q.mz and p.intensity = q.intensity) as same from points p join recon q using (scan_idx, pos) group by scan_idx) group by win")
def _(v: Views) -> DataFrame:
    return compare.exact_share(aligned(v), ["win"]).select("win", r("exact_fraction"), "scans")


@query(
    "o_k4_derived",
    "points",
    sql="select scan_idx, round(sum(intensity), 6) as tic, round(max(intensity), 6) as base_peak, round(arg_min(mz, (-intensity, pos)), 6) as base_peak_mz, round(min(mz), 6) as lowest_mz, round(max(mz), 6) as highest_mz from points group by scan_idx",
)
def _(v: Views) -> DataFrame:
    return compare.derived_values(v.scans).select("scan_idx", r("tic"), r("base_peak"), r("base_peak_mz"), r("lowest_mz"), r("highest_mz"))


@query(
    "o_t4_outliers",
    "points",
    "recon",
    sql="select scan_idx, round(diff, 9) as diff from (select scan_idx, round(max(abs(p.intensity - q.intensity)), 9) as diff from points p join recon q using (scan_idx, pos) group by scan_idx) order by diff desc, scan_idx limit 20",
)
def _(v: Views) -> DataFrame:
    worst = compare.worst_points(v.points, v.recon_points.select("scan_idx", "pos", "intensity"), ["scan_idx"], "intensity", None)
    return worst.select("scan_idx", r("diff", 9)).orderBy(F.desc("diff"), "scan_idx").limit(20)


@query("o_a4_dtype_hist", sql="select case when l_quantity = round(l_quantity) then 'int' else 'float' end as dtype, count(*) as n from lineitem group by 1")
def _(v: Views) -> DataFrame:
    return v.table("lineitem").groupBy(F.when(F.col("l_quantity") == F.round("l_quantity"), "int").otherwise("float").alias("dtype")).agg(F.count(F.lit(1)).alias("n"))


@query("o_m9_ppm_median", "points", "recon", sql="select round(median(p), 9) as ppm from (select scan_idx, quantile_cont(abs(p.mz - q.mz) / p.mz * 1e6, 0.95) as p from points p join recon q using (scan_idx, pos) group by scan_idx)")
def _(v: Views) -> DataFrame:
    both = v.points.join(v.recon_points.select("scan_idx", "pos", F.col("mz").alias("mz_b")), ["scan_idx", "pos"])
    p95 = both.groupBy("scan_idx").agg(F.percentile(F.abs(F.col("mz") - F.col("mz_b")) / F.col("mz") * 1e6, F.lit(0.95)).alias("p"))
    return p95.agg(r(F.percentile("p", F.lit(0.5)), 9).alias("ppm"))


@query(
    "o_a3_structure",
    sql="""with t as (select page_id, unnest(string_split(html, '<')) as token, generate_subscripts(string_split(html, '<'), 1) - 1 as ord from pages),
b as (select page_id, ord // 4096 as blk, sha256(string_agg(sha256(token), chr(10) order by ord)) as h, count(*) as n from t group by 1, 2)
select page_id, sha256(string_agg(h, chr(10) order by blk)) as digest, sum(n)::bigint as tokens from b group by 1""",
)
def _(v: Views) -> DataFrame:
    tokens = v.table("pages").select("page_id", F.posexplode(F.split("html", "<")).alias("ord", "token"))
    return compare.structure_digest(tokens, ["page_id"], "ord", "token")


# ---------------------------------------------------------------- extracted time series


TARGETS = """, top as (select * from (select *, row_number() over (partition by scan_idx order by intensity desc, pos) as k from points where intensity > 0) where k <= 80),
b as (select round_even(mz / 0.01::double, 0)::bigint as bucket, sum(mz * intensity) / sum(intensity) as target_mz, sum(rt * intensity) / sum(intensity) as target_rt, sum(intensity) as signal, count(*) as peaks from top group by 1),
targets as (select *, row_number() over (order by round(signal, 6) desc, bucket) as rank from b qualify rank <= 500)"""
XIC = f"""{TARGETS}, lim as (select *, target_mz * (1 - 10::double * 1e-6::double) as lo, target_mz * (1 + 10::double * 1e-6::double) as hi from targets),
grid as (select distinct scan_idx, rt, rank from points, targets),
xa as (select scan_idx, rank, sum(intensity) as xic from points join lim on mz between lo and hi group by 1, 2), xb as (select scan_idx, rank, sum(intensity) as xic from recon join lim on mz between lo and hi group by 1, 2),
both_ as (select g.scan_idx, g.rank, g.rt, coalesce(xa.xic, 0) as a, coalesce(xb.xic, 0) as b from grid g left join xa using (scan_idx, rank) left join xb using (scan_idx, rank)),
step as (select *, (a + lag(a) over w) / 2 * (rt - lag(rt) over w) as ta, (b + lag(b) over w) / 2 * (rt - lag(rt) over w) as tb from both_ window w as (partition by rank order by scan_idx)),
met as (select rank, sum(ta) as area_a, sum(tb) as area_b, greatest(-1, least(1, corr(a, b))) as pearson, arg_min(rt, (-b, scan_idx)) - arg_min(rt, (-a, scan_idx)) as shift from step group by rank),
metrics as (select *, (area_b - area_a) / greatest(abs(area_a), 1) as signed from met)"""


def found_targets(v: Views) -> DataFrame:
    return xic.targets(v.points)


def series(v: Views) -> DataFrame:
    t = found_targets(v).persist()
    a = xic.extract(v.points, t).withColumnRenamed("xic", "xic_a")
    b = xic.extract(v.recon_points, t).select("scan_idx", "rank", F.col("xic").alias("xic_b"))
    return a.join(b, ["scan_idx", "rank"])


@query("o_t2_xic_targets", "points", sql=f"{TARGETS} select rank, bucket, round(target_mz, 6) as target_mz, round(target_rt, 6) as target_rt, round(signal, 6) as signal, peaks from targets")
def _(v: Views) -> DataFrame:
    return found_targets(v).select(long("rank"), "bucket", r("target_mz"), r("target_rt"), r("signal"), "peaks")


@query("o_j18_xic", "points", "recon", sql=f"{XIC} select scan_idx, rank, round(a, 6) as xic from both_")
def _(v: Views) -> DataFrame:
    return xic.extract(v.points, found_targets(v)).select("scan_idx", long("rank"), r("xic"))


@query("o_a22_xic_metrics", "points", "recon", sql=f"{XIC} select rank, round(area_a, 5) as area_original, round(area_b, 5) as area_rebuilt, round(pearson, 6) as pearson, round(shift, 6) as apex_shift, round(abs(signed), 6) as area_abs_rel_error from metrics")
def _(v: Views) -> DataFrame:
    m = xic.target_metrics(series(v), ["rank"])
    return m.select(long("rank"), r("area_original", 5), r("area_rebuilt", 5), r("pearson"), r("apex_shift"), r("area_abs_rel_error"))


@query("o_a23_xic_file", "points", "recon", sql=f"{XIC} select count(*) as targets, round(quantile_cont(abs(signed), 0.5), 6) as area_median, round(max(abs(signed)), 6) as area_max, round(min(pearson), 6) as pearson_min from metrics")
def _(v: Views) -> DataFrame:
    return xic.summary(xic.target_metrics(series(v), ["rank"]), []).select("targets", r("area_median"), r("area_max"), r("pearson_min"))


@query("o_a24_topk_gradient", "points", "recon", sql=f"{XIC} select k, count(*) as targets, round(quantile_cont(abs(signed), 0.95), 6) as area_p95, round(min(pearson), 6) as pearson_min from metrics, (values (5), (10), (20), (50), (100), (250), (500)) t(k) where rank <= k group by k")
def _(v: Views) -> DataFrame:
    return xic.gradient(xic.target_metrics(series(v), ["rank"]), [5, 10, 20, 50, 100, 250, 500], []).select("k", "targets", r("area_p95"), r("pearson_min"))


@query("o_t1_top_points", "points", sql="select scan_idx, pos, k from (select scan_idx, pos, row_number() over (partition by scan_idx order by intensity desc, pos) as k from points where intensity > 0) where k <= 80")
def _(v: Views) -> DataFrame:
    w = Window.partitionBy("scan_idx").orderBy(F.desc("intensity"), "pos")
    return xic.top_points(v.points).select("scan_idx", "pos", F.row_number().over(w).cast("long").alias("k"))


# ---------------------------------------------------------------- recovery


def pairs(v: Views) -> DataFrame:
    return recovery.pairwise(v.quantities("original"), v.quantities("rebuilt"), ["id"])


PAIRS = ("qa", "qb", "pairs")


@query("o_j5_pairwise", *PAIRS, sql="select id, round(qa, 2) as qa, round(qb, 2) as qb, set_class, round(fc, 6) as log2fc from pairs")
def _(v: Views) -> DataFrame:
    return pairs(v).select("id", r("qa", 2), r("qb", 2), "set_class", r("log2fc"))


@query("o_j6_quantified", "qa", "qb", sql="select id, round(qa.quantity, 2) as qa, round(qb.quantity, 2) as qb from qa join qb using (id) where qa.quantity > 0 and qb.quantity > 0")
def _(v: Views) -> DataFrame:
    a, b = v.quantities("original").withColumnRenamed("quantity", "qa"), v.quantities("rebuilt").withColumnRenamed("quantity", "qb")
    return a.join(b, "id").where("qa > 0 and qb > 0").select("id", r("qa", 2), r("qb", 2))


@query(
    "o_a17_set_metrics",
    *PAIRS,
    sql="""select count(*) filter (where set_class in ('shared', 'original_only')) as original_count, count(*) filter (where set_class in ('shared', 'rebuilt_only')) as rebuilt_count, count(*) filter (where set_class = 'shared') as shared_count, round(count(*) filter (where set_class = 'shared') / count(*), 6) as jaccard,
round(corr(log2(qa + 1), log2(qb + 1)) filter (where set_class = 'shared'), 6) as pearson_log2, round(quantile_cont(abs(fc), 0.5), 6) as median_abs_log2fc, round(quantile_cont(abs(fc), 0.95), 6) as p95_abs_log2fc from pairs""",
)
def _(v: Views) -> DataFrame:
    return recovery.set_metrics(pairs(v), []).select("original_count", "rebuilt_count", "shared_count", r("jaccard"), r("pearson_log2"), r("median_abs_log2fc"), r("p95_abs_log2fc"))


@query("o_a18_set_class", *PAIRS, sql="select set_class, count(*) as n from pairs group by set_class")
def _(v: Views) -> DataFrame:
    return pairs(v).groupBy("set_class").agg(F.count(F.lit(1)).alias("n"))


@query("o_j7_membership", "ia", "ib", sql="select s as shared, l as lost, g as gained, round(s / (s + l), 6) as shared_rate, round(l / (s + l), 6) as lost_rate, round(g / (s + l), 6) as gained_rate from (select count(*) filter (where ia.id is not null and ib.id is not null) as s, count(*) filter (where ib.id is null) as l, count(*) filter (where ia.id is null) as g from ia full join ib on ia.id = ib.id)")
def _(v: Views) -> DataFrame:
    m = recovery.membership(v.ids("original"), v.ids("rebuilt"), ["id"])
    return m.select("shared", "lost", "gained", r("shared_rate"), r("lost_rate"), r("gained_rate"))


@query("o_u2_set_operations", "ia", "ib", sql="select 'both' as kind, count(*) as n from (select id from ia intersect select id from ib) union all select 'first', count(*) from (select id from ia except select id from ib) union all select 'second', count(*) from (select id from ib except select id from ia)")
def _(v: Views) -> DataFrame:
    a, b = v.ids("original"), v.ids("rebuilt")
    n = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(a.intersect(b), "both").union(n(a.subtract(b), "first")).union(n(b.subtract(a), "second"))


@query("o_a32_tail", *PAIRS, sql="select count(fc) as shared, count(*) filter (where abs(fc) > 1) as over_1_0, round(count(*) filter (where abs(fc) > 1) / count(fc), 6) as share_over_1_0, round(quantile_cont(abs(fc), 0.99), 6) as p99, round(quantile_cont(abs(fc), 0.999), 6) as p999, round(count(*) filter (where abs(fc) > 0) / count(fc), 6) as nonzero_share from pairs")
def _(v: Views) -> DataFrame:
    return recovery.tail(pairs(v), []).select("shared", "over_1_0", r("share_over_1_0"), r("p99"), r("p999"), r("nonzero_share"))


@query("o_a21_quantiles", *PAIRS, sql="select set_class, count(*) as n, " + ", ".join(f"round(quantile_cont(greatest(qa, qb), 0.{p}), 4) as p{p}" for p in ("10", "25", "50", "75", "90", "95")) + " from pairs group by set_class")
def _(v: Views) -> DataFrame:
    q = F.greatest("qa", "qb")
    named = [r(c, 4).alias(f"p{p}") for p, c in ((p, F.percentile(q, F.lit(int(p) / 100))) for p in ("10", "25", "50", "75", "90", "95"))]
    return pairs(v).groupBy("set_class").agg(F.count(F.lit(1)).alias("n"), *named)


@query("o_t5_outliers", *PAIRS, sql="select rank, id, round(fc, 6) as log2fc from (select *, row_number() over (order by round(abs(fc), 9) desc, id) as rank from pairs where fc is not null) where rank <= 25")
def _(v: Views) -> DataFrame:
    return recovery.outliers(pairs(v), [], "id").select(long("rank"), "id", r("log2fc"))


@query(
    "o_a20_recovery_summary",
    "bench",
    sql=", f as (select method, section, file, raw / compressed as x from bench) select method, section, count(*) as n, round(median(x), 6) as median, round(min(x), 6) as min, round(quantile_cont(x, 0.05), 6) as p05, round(max(x), 6) as max, arg_min(file, (round(x, 6), file)) as worst from f group by method, section",
)
def _(v: Views) -> DataFrame:
    rows = v.bench.withColumn("x", F.round(F.col("raw") / F.col("compressed"), 6))
    return recovery.recovery_summary(rows, ["method", "section"], "x", "file", "file").select("method", "section", "n", r("median"), r("min"), r("p05"), r("max"), "worst")


@query(
    "o_j2_psm_identity",
    sql="""with a as (select * from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_extendedprice desc, l_partkey, l_suppkey) as n from lineitem where l_returnflag = 'R') where n = 1),
b as (select * from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_extendedprice desc, l_partkey, l_suppkey) as n from lineitem where l_linestatus = 'F') where n = 1)
select l_orderkey, l_linenumber, a.l_partkey as part_a, b.l_partkey as part_b from a join b using (l_orderkey, l_linenumber)""",
)
def _(v: Views) -> DataFrame:
    order = [F.desc("l_extendedprice"), F.col("l_partkey"), F.col("l_suppkey")]
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    t = v.table("lineitem")
    both = recovery.shared_identity(t.where("l_returnflag = 'R'").select(cols), t.where("l_linestatus = 'F'").select(cols), ["l_orderkey", "l_linenumber"], order)
    return both.select("l_orderkey", "l_linenumber", F.col("l_partkey_a").alias("part_a"), F.col("l_partkey_b").alias("part_b"))


@query("o_a15_preaggregate", sql="select concat_ws('|', l_returnflag, l_linestatus, l_linenumber::varchar) as id, round(sum(l_quantity), 2) as quantity from lineitem group by 1")
def _(v: Views) -> DataFrame:
    key = F.concat_ws("|", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    return v.table("lineitem").groupBy(key.alias("id")).agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))


# ---------------------------------------------------------------- benchmark tables


def rr(*cols: str, places: int = 6) -> list[Column]:
    return [r(c, places) for c in cols]


@query(
    "o_a5_method_agg",
    "bench",
    sql="select method, count(distinct sample) as samples, round(sum(raw), 2) as raw, round(sum(compressed), 2) as compressed, round(avg(raw / compressed), 6) as mean_ratio, round(median(raw / compressed), 6) as median_ratio, round(sum(raw) / sum(compressed), 6) as aggregate_ratio, round(stddev_pop(raw / compressed), 6) as sd_ratio from bench group by method",
)
def _(v: Views) -> DataFrame:
    return tables.method_summary(v.bench, ["method"]).select("method", "samples", *rr("raw", "compressed", places=2), *rr("mean_ratio", "median_ratio", "aggregate_ratio", "sd_ratio"))


@query("o_a6_section_agg", "bench", sql="select section, round(sum(raw) filter (where compressed > 20000), 2) as raw, count(*) filter (where compressed > 20000) as n, round(sum(compressed), 2) as all_compressed from bench group by section")
def _(v: Views) -> DataFrame:
    big = F.col("compressed") > 20000
    return v.bench.groupBy("section").agg(r(F.sum(F.when(big, F.col("raw"))), 2).alias("raw"), F.count(F.when(big, 1)).alias("n"), r(F.sum("compressed"), 2).alias("all_compressed"))


@query(
    "o_a7_vs_reference",
    "bench",
    sql=", g as (select section, method, avg(raw / compressed) as mean from bench group by 1, 2) select section, method, round(mean, 6) as mean, round((mean / max(mean) filter (where method = 'BUILDING') over (partition by section) - 1) * 100, 6) as percent from g",
)
def _(v: Views) -> DataFrame:
    g = v.bench.groupBy("section", "method").agg(F.avg(F.col("raw") / F.col("compressed")).alias("mean"))
    return tables.against_reference(g, ["section"], "method", "BUILDING", "mean").select("section", "method", r("mean"), r("percent"))


@query("o_a8_common_methods", "bench", sql="select method from bench group by method having count(distinct section) = (select count(distinct section) from bench)")
def _(v: Views) -> DataFrame:
    return tables.in_every(v.bench, "method", "section")


@query("o_a9_median_order", "bench", sql="select method, round(median(raw / compressed), 6) as median, row_number() over (order by round(median(raw / compressed), 9) desc, method) as place from bench group by method")
def _(v: Views) -> DataFrame:
    return tables.ordered_by_median(v.bench, "method", F.col("raw") / F.col("compressed"), F.col("method")).select("method", r("median"), long("place"))


@query("o_u5_pivot", "bench", sql="select section, " + ", ".join(f"round(max(raw / compressed) filter (where method = '{m}'), 6) as {m.lower()}" for m in ("AUTOMOBILE", "BUILDING", "FURNITURE")) + " from bench group by section")
def _(v: Views) -> DataFrame:
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE"]
    p = v.bench.groupBy("section").pivot("method", names).agg(F.max(F.col("raw") / F.col("compressed")))
    return p.select("section", *(F.round(F.col(m), 6).alias(m.lower()) for m in names))


@query("o_u4_unpivot", "bench", sql="select section, 'raw' as level, round(sum(raw), 2) as value from bench group by 1 union all select section, 'compressed', round(sum(compressed), 2) from bench group by 1")
def _(v: Views) -> DataFrame:
    g = v.bench.groupBy("section").agg(F.round(F.sum("raw"), 2).alias("raw"), F.round(F.sum("compressed"), 2).alias("compressed"))
    return g.unpivot(["section"], ["raw", "compressed"], "level", "value")


@query("o_j13_reference_delta", "bench", sql=", g as (select sample, method, max(raw) as top from bench group by 1, 2), h as (select method, max(top) as top from g group by 1) select sample, method, round(g.top / h.top, 6) as share from g join h using (method)")
def _(v: Views) -> DataFrame:
    g = v.bench.groupBy("sample", "method").agg(F.max("raw").alias("top"))
    return g.join(g.groupBy("method").agg(F.max("top").alias("most")), "method").select("sample", "method", r(F.col("top") / F.col("most")).alias("share"))


@query(
    "o_a13_variant_vs_a0",
    "bench",
    sql=", s as (select *, o % 50 as f from (select *, file as o from bench)), own as (select * from s where f in (select f from s where section = '1-URGENT')) select section, count(*) as n, round(sum(raw) / sum(compressed), 6) as aggregate_ratio, round(list_sort(list(round(raw / compressed, 6)))[count(*) // 2 + 1], 6) as upper_median, round((sum(compressed) / (select sum(compressed) from own where section = '1-URGENT') - 1) * 100, 6) as size_delta_percent from own group by section",
)
def _(v: Views) -> DataFrame:
    rows = v.bench.withColumn("f", F.col("file") % 50)
    out = tables.variant_summary(rows, "section", "1-URGENT", "f")
    return out.select("section", "n", r("aggregate_ratio"), r("upper_median"), r("size_delta_percent"))


@query("o_a14_rollup", "bench", sql="select coalesce(section, 'AGGREGATE') as section, round(sum(raw), 2) as raw, round(sum(compressed), 2) as compressed from bench group by rollup (section)")
def _(v: Views) -> DataFrame:
    return tables.with_total(v.bench, "section", ["raw", "compressed"]).select("section", *rr("raw", "compressed", places=2))


@query("o_a10_grouping_sets", sql="select r_name as region, n_name as nation, count(*) as suppliers, round(sum(s_acctbal), 2) as balance, string_agg(distinct n_name, ', ' order by n_name) as nations from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by grouping sets ((r_name), (r_name, n_name))")
def _(v: Views) -> DataFrame:
    n = v.table("nation").join(F.broadcast(v.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    s = v.table("supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("own", F.col("n_name"))
    g = s.groupingSets([["r_name"], ["r_name", "n_name"]], "r_name", "n_name")
    return g.agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"), F.array_join(F.array_sort(F.collect_set("own")), ", ").alias("nations")).withColumnsRenamed({"r_name": "region", "n_name": "nation"})


@query("o_p9_completeness", "bench", sql="select sample, count(distinct section) as members from bench group by sample having count(distinct section) >= 4")
def _(v: Views) -> DataFrame:
    return tables.complete_groups(v.bench, "sample", "section", 4).select("sample", "members").distinct()


@query("o_m8_paired_gain", "bench", sql=", p as (select sample, avg(raw / compressed) filter (where section = '1-URGENT') as a, avg(raw / compressed) filter (where section = '5-LOW') as b from bench group by sample) select count(*) as n, round(avg((a / b - 1) * 100), 6) as mean_gain, round(median((a / b - 1) * 100), 6) as median_gain, round(min((a / b - 1) * 100), 6) as min_gain, round(max((a / b - 1) * 100), 6) as max_gain from p where a is not null and b is not null")
def _(v: Views) -> DataFrame:
    g = (F.col("a") / F.col("b") - 1) * 100
    return paired(v).withColumn("g", g).agg(F.count(F.lit(1)).alias("n"), r(F.avg("g")).alias("mean_gain"), r(F.percentile("g", F.lit(0.5))).alias("median_gain"), r(F.min("g")).alias("min_gain"), r(F.max("g")).alias("max_gain"))


def paired(v: Views) -> DataFrame:
    x = F.col("raw") / F.col("compressed")
    p = v.bench.groupBy("sample").agg(F.avg(F.when(F.col("section") == "1-URGENT", x)).alias("a"), F.avg(F.when(F.col("section") == "5-LOW", x)).alias("b"))
    return p.where("a is not null and b is not null")


PAIRED = ", p as (select sample, avg(raw / compressed) filter (where section = '1-URGENT') as a, avg(raw / compressed) filter (where section = '5-LOW') as b from bench group by sample), q as (select *, round(a - b, 6) as d from p where a is not null and b is not null)"


@query(
    "o_m3_wilcoxon_w",
    "bench",
    sql=f"""{PAIRED}, z as (select *, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0 as r from q where d <> 0)
select count(*) as n, round(sum(r) filter (where d > 0), 3)::double as w_plus, round(sum(r) filter (where d < 0), 3)::double as w_minus, round((sum(r) filter (where d > 0) - sum(r) filter (where d < 0)) / sum(r), 6) as rank_biserial from z""",
)
def _(v: Views) -> DataFrame:
    out = stats.signed_ranks(paired(v), [], F.round(F.col("a") - F.col("b"), 6))
    return out.select("n", r("w_plus", 3), r("w_minus", 3), r("rank_biserial"))


@query(
    "o_m3_wilcoxon_p",
    "bench",
    sql=f"""{PAIRED}, z as (select *, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0::double as r, count(*) over (partition by abs(d)) as t from q where d <> 0),
g as (select count(*) as n, coalesce(sum(r) filter (where d > 0), 0) as up, coalesce(sum(r) filter (where d < 0), 0) as down, sum((t - 1) * (t + 1))::double as ties from z),
w as (select n, least(up, down) as w, greatest(abs(least(up, down) - n * (n + 1) / 4.0::double) - 0.5::double, 0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::double - ties / 48) as z from g)
select n, w, round(z, 6) as z, round(1 - sqrt(2 / pi()) * (select sum(exp(-pow(z * (i + 0.5::double) / 20000, 2) / 2)) * z / 20000 from generate_series(0, 19999) s(i)), 6) as p_value from w""",
)
def _(v: Views) -> DataFrame:
    return stats.wilcoxon(paired(v), [], F.round(F.col("a") - F.col("b"), 6)).select("n", "w", r("z"), r("p_value"))


@query(
    "o_m6_paired_t",
    "bench",
    sql=f"""{PAIRED}, g as (select count(*) as n, avg(a - b) as m, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) as t, (count(*) - 1)::double as v from q),
f as (select *, exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) as c from g)
select n, round(m, 6) as mean_diff, round(t, 6) as t, round(greatest(0, 1 - 2 * c * (select sum(pow(1 + pow(abs(t) * (i + 0.5::double) / 40000, 2) / v, -(v + 1) / 2)) * abs(t) / 40000 from generate_series(0, 39999) s(i))), 6) as p_value from f""",
)
def _(v: Views) -> DataFrame:
    return stats.paired_t(paired(v), [], F.col("a") - F.col("b")).select("n", r("mean_diff"), r("t"), r("p_value"))


@query("o_m1_pearson", "bench", sql="select section, round(corr(raw, compressed), 6) as strict from bench group by section")
def _(v: Views) -> DataFrame:
    return v.bench.groupBy("section").agg(r(stats.pearson(F.col("raw"), F.col("compressed"))).alias("strict"))


@query("o_m1_pearson_conventions", "points", sql="select scan_idx, 1.0::double as flat_xic, null::double as flat_strict, 0.0::double as one_flat from points group by scan_idx")
def _(v: Views) -> DataFrame:
    one = F.lit(2.0)
    return v.points.groupBy("scan_idx").agg(stats.pearson(one + F.col("pos") * 0, one + F.col("pos") * 0, 2, 1.0, 1.0, 0.0, True).alias("flat_xic"), stats.pearson(one + F.col("pos") * 0, F.col("pos")).alias("flat_strict"), stats.pearson(one + F.col("pos") * 0, F.col("pos"), 2, None, 1.0, 0.0).alias("one_flat"))


@query("o_m2_spearman", "bench", sql=", k as (select section, rank() over (partition by section order by raw) + (count(*) over (partition by section, raw) - 1) / 2.0 as a, rank() over (partition by section order by compressed) + (count(*) over (partition by section, compressed) - 1) / 2.0 as b from bench) select section, round(corr(a::double, b::double), 6) as spearman from k group by section")
def _(v: Views) -> DataFrame:
    return stats.spearman(v.bench.select("section", "raw", "compressed"), ["section"], "raw", "compressed").select("section", r("spearman"))


@query("o_w15_average_rank", sql="select p_partkey, rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0::double as rank from part")
def _(v: Views) -> DataFrame:
    return average_ranks(v.table("part").select("p_partkey", "p_size"), "p_size").select("p_partkey", "rank")


@query("o_w16_minmax", "bench", sql="select file, round(case when max(raw) over w > min(raw) over w then (raw - min(raw) over w) / (max(raw) over w - min(raw) over w) else 0.5 end, 6) as scaled from bench window w as (partition by section)")
def _(v: Views) -> DataFrame:
    return tables.normalised(v.bench, ["section"], "raw").select("file", r("scaled"))


# ---------------------------------------------------------------- bookkeeping


@query("o_w18_latest_wins", "status", sql="select user_id, event_id, event_type, k from (select *, row_number() over (partition by user_id order by (event_type = 'purchase')::int desc, k desc, event_id desc) as n from status) where n = 1")
def _(v: Views) -> DataFrame:
    order = [F.desc((F.col("event_type") == "purchase").cast("int")), F.desc("k"), F.desc("event_id")]
    return tables.latest(v.status, ["user_id"], order).select("user_id", "event_id", "event_type", "k")


@query("o_k6_upsert", "status", sql="select user_id, sum(k)::bigint as total, count(*) as n from (select user_id, k from status where event_id % 2 = 0 union all select user_id, k from status where event_id % 2 = 1 and user_id not in (select user_id from status where event_id % 2 = 0)) group by user_id")
def _(v: Views) -> DataFrame:
    s = v.status.select("user_id", "event_id", "k")
    out = tables.upsert(s.where("event_id % 2 = 1"), s.where("event_id % 2 = 0"), ["user_id"])
    return out.groupBy("user_id").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("n"))


@query("o_u1_union_dedupe", sql="select id, min(source_root) as source_root from (select c_nationkey as id, 'a' as source_root from customer union all select s_nationkey, 'b' from supplier) group by id")
def _(v: Views) -> DataFrame:
    a = v.table("customer").select(F.col("c_nationkey").alias("id"))
    b = v.table("supplier").select(F.col("s_nationkey").alias("id"), F.lit(1).alias("extra"))
    return tables.union_roots({"a": a, "b": b}, ["id"]).select("id", "source_root")


@query("o_j9_reindex", sql="select n_nationkey as at, count(*) as n from customer join nation on c_nationkey = n_nationkey where n_nationkey % 2 = 0 group by 1")
def _(v: Views) -> DataFrame:
    wanted = v.table("nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("at"))
    return v.table("customer").join(F.broadcast(wanted), F.col("c_nationkey") == F.col("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n"))


@query("o_j10_left_lookup", sql="select n_name as nation, count(s_suppkey) as suppliers, coalesce(round(sum(s_acctbal), 2), 0) as balance from nation left join supplier on s_nationkey = n_nationkey group by 1")
def _(v: Views) -> DataFrame:
    j = v.table("nation").join(v.table("supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy(F.col("n_name").alias("nation")).agg(F.count("s_suppkey").alias("suppliers"), F.coalesce(F.round(F.sum("s_acctbal"), 2), F.lit(0.0)).alias("balance"))


@query("o_j11_conformance", sql="select coalesce(f, w) as key, case when f is not null and w is not null then 'kept' when w is not null then 'missing' else 'excluded' end as status from (select distinct s_nationkey as f from supplier) full join (select n_nationkey as w from nation where n_nationkey < 15) on f = w")
def _(v: Views) -> DataFrame:
    found = v.table("supplier").select(F.col("s_nationkey").alias("key"))
    wanted = v.table("nation").where("n_nationkey < 15").select(F.col("n_nationkey").alias("key"))
    return tables.conformance(found, wanted, "key")


@query("o_j12_three_way", sql="with a as (select c_nationkey as k, count(*) as n from customer group by 1), b as (select s_nationkey as k, count(*) as n from supplier group by 1), c as (select n_nationkey as k, n_regionkey::bigint as n from nation) select coalesce(a.k, b.k, c.k) as k, coalesce(a.n, 0) as customers, coalesce(b.n, 0) as suppliers, coalesce(c.n, 0) as region from a full join b on a.k = b.k full join c on coalesce(a.k, b.k) = c.k")
def _(v: Views) -> DataFrame:
    a = v.table("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = v.table("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    c = v.table("nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").cast("long").alias("region"))
    return a.join(b, "k", "full").join(c, "k", "full").na.fill(0)


@query("o_a26_coverage", sql="select n_nationkey as id, n_nationkey in (select s_nationkey from supplier) as in_suppliers, n_nationkey in (select c_nationkey from customer) as in_customers from nation")
def _(v: Views) -> DataFrame:
    items = v.table("nation").select(F.col("n_nationkey").alias("id"))
    return tables.coverage(items, {"suppliers": v.table("supplier").select(F.col("s_nationkey").alias("id")), "customers": v.table("customer").select(F.col("c_nationkey").alias("id"))}, "id")


@query(
    "o_a27_stage_timing",
    "status",
    sql=", t as (select user_id, event_type as stage, sum(k)::double as seconds from status group by 1, 2), w as (select user_id, sum(k)::double as m, max(k) * 10.0::double as total from status group by 1), u as (select * from t union all select user_id, 'unattributed', greatest(0, total - m) from w) select user_id, stage, seconds, round(case when total > 0 then seconds / total * 100 end, 6) as percent from u join w using (user_id)",
)
def _(v: Views) -> DataFrame:
    s = v.status.withColumn("seconds", F.col("k").cast("double")).withColumn("total", F.max(F.col("k") * 10.0).over(Window.partitionBy("user_id")))
    return tables.timing_shares(s.select("user_id", "event_type", F.col("seconds").alias("s"), "total"), ["user_id"], "event_type", "s", "total").select("user_id", "stage", "seconds", r("percent"))


@query("o_a25_validation_summary", "status", sql="select event_type, count(*) as n, count(*) filter (where k > 50) as high, max(k) as top, bool_and(k >= 0) as fine from status group by 1")
def _(v: Views) -> DataFrame:
    return v.status.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("k") > 50, 1)).alias("high"), F.max("k").alias("top"), F.bool_and(F.col("k") >= 0).alias("fine"))


@query("o_w19_cycle", "status", sql=", l as (select event_id, event_type, lag(event_type, 5) over (partition by user_id order by event_id) as p from status) select count(*) filter (where event_type = p) as same, count(p) as compared from l")
def _(v: Views) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    p = v.status.withColumn("p", F.lag("event_type", 5).over(w))
    return p.agg(F.count(F.when(F.col("event_type") == F.col("p"), 1)).alias("same"), F.count("p").alias("compared"))


@query("o_p4_modality", sql="select p_partkey, case when regexp_matches(p_name, '(?i)a.*e') then 'ETD' when regexp_matches(p_name, '(?i)b') then 'DIA' when regexp_matches(p_name, '(?i)c') then 'DDA' else 'UNKNOWN' end as modality from part")
def _(v: Views) -> DataFrame:
    return v.table("part").select("p_partkey", num.first_match(F.col("p_name"), [("(?i)a.*e", "ETD"), ("(?i)b", "DIA"), ("(?i)c", "DDA")], "UNKNOWN").alias("modality"))


@query("o_p6_assignment", sql="select p_partkey, case when p_size > 30 then 'dia' when p_size > 10 then 'dda' else 'none' end as workflow, case when p_size > 30 then 'high' when p_size > 10 then 'medium' else 'low' end as confidence from part")
def _(v: Views) -> DataFrame:
    kind = lambda a, b, c: F.when(F.col("p_size") > 30, a).when(F.col("p_size") > 10, b).otherwise(c)
    return v.table("part").select("p_partkey", kind("dia", "dda", "none").alias("workflow"), kind("high", "medium", "low").alias("confidence"))


@query("o_p8_terms", sql="select count(*) as n from part where contains(lower(p_name), 're') or contains(lower(p_name), 'blue')")
def _(v: Views) -> DataFrame:
    name = F.lower("p_name")
    return v.table("part").where(F.exists(F.array(F.lit("re"), F.lit("blue")), lambda t: F.contains(name, t))).agg(F.count(F.lit(1)).alias("n"))


@query("o_p10_status_filter", "status", sql="select count(*) filter (where event_type in ('click', 'purchase') and value > 0) as kept, count(*) filter (where event_type not in ('click', 'purchase')) as wrong_status, count(*) filter (where event_type in ('click', 'purchase') and not value > 0) as bad_size from status")
def _(v: Views) -> DataFrame:
    ok, size = F.col("event_type").isin("click", "purchase"), F.col("value") > 0
    return v.status.agg(F.count(F.when(ok & size, 1)).alias("kept"), F.count(F.when(~ok, 1)).alias("wrong_status"), F.count(F.when(ok & ~size, 1)).alias("bad_size"))


@query("o_p11_keep_exclude", sql="select count(*) as n from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1) and c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def _(v: Views) -> DataFrame:
    keep = v.table("nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    drop = v.table("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return v.table("customer").join(F.broadcast(keep), "c_nationkey", "left_semi").join(drop, "c_custkey", "left_anti").agg(F.count(F.lit(1)).alias("n"))


@query("o_p13_labels", sql="select p_partkey, regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g') as safe, p_brand || chr((96 + row_number() over (partition by p_brand order by p_partkey) % 26)::int) as label from part")
def _(v: Views) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return v.table("part").select("p_partkey", F.regexp_replace("p_name", "[^A-Za-z0-9]+", "_").alias("safe"), F.concat("p_brand", F.char(96 + n % 26)).alias("label"))


@query("o_s16_size_text", sql="select p_partkey, (case p_size % 4 when 0 then round_even(p_retailprice * 1024, 0) when 1 then round_even(p_retailprice * 1048576, 0) when 2 then round_even(p_retailprice * 1073741824, 0) else round_even(p_retailprice, 0) end)::bigint as bytes from part")
def _(v: Views) -> DataFrame:
    unit = F.element_at(F.array(F.lit(" KiB"), F.lit(" MB"), F.lit("GiB"), F.lit(" B")), (F.col("p_size") % 4 + 1).cast("int"))
    return v.table("part").select("p_partkey", num.size_bytes(F.concat(F.col("p_retailprice").cast("string"), unit)).alias("bytes"))


@query("o_t7_interleave", "bench", sql=", q as (select file, raw, raw > 300000 as is_large from bench) select file, is_large, (case when is_large then row_number() over (partition by is_large order by raw desc, file) - 1 else (row_number() over (partition by is_large order by raw desc, file) - 1) // 4 end)::bigint as turn from q")
def _(v: Views) -> DataFrame:
    return tables.interleave(v.bench, "raw", F.col("raw") > 300000, 4, "file").select("file", "is_large", "turn")


@query("o_t6_cutoff_examples", sql="select category, id, n from (select p_type as category, p_partkey as id, row_number() over (partition by p_type order by p_size desc, p_retailprice, p_partkey) as n from part) where n <= 3")
def _(v: Views) -> DataFrame:
    w = Window.partitionBy("p_type").orderBy(F.desc("p_size"), "p_retailprice", "p_partkey")
    return v.table("part").select(F.col("p_type").alias("category"), F.col("p_partkey").alias("id"), F.row_number().over(w).cast("long").alias("n")).where("n <= 3")


@query("o_u6_ordered_distinct", sql="select o_custkey as id, min(o_orderkey) as first from orders group by 1")
def _(v: Views) -> DataFrame:
    return v.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("first"))


@query("o_u3_stack", sql="select 'customer' as kind, c_custkey as id, c_acctbal as balance, null::int as size from customer union all select 'part', p_partkey, null, p_size from part")
def _(v: Views) -> DataFrame:
    a = v.table("customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    b = v.table("part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    return a.unionByName(b, allowMissingColumns=True)


@query("o_w17_offsets", sql="select doc_id, coalesce(sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as low from documents")
def _(v: Views) -> DataFrame:
    sizes = v.table("documents").select("doc_id", "source", F.col("n_chars").cast("long").alias("n"))
    return numbered(sizes, [F.col("doc_id")], ["source"], total="n").select("doc_id", F.col("n_before").alias("low"))


@query("o_a33_worst", "bench", sql="select section, arg_min(file, (round(raw, 2), file)) as worst, round(min(raw), 2) as least from bench group by section")
def _(v: Views) -> DataFrame:
    return v.bench.groupBy("section").agg(F.min_by("file", F.struct(F.round("raw", 2), "file")).alias("worst"), F.round(F.min("raw"), 2).alias("least"))


@query(
    "o_a28_composition",
    "bench",
    sql="select section, round(sum(raw) filter (where file % 3 = 0), 2) as mz, round(sum(raw) filter (where file % 3 = 1), 2) as int_, round(sum(raw) filter (where file % 3 = 2), 2) as meta from bench group by section",
)
def _(v: Views) -> DataFrame:
    kind = F.element_at(F.array(F.lit("mz"), F.lit("int_"), F.lit("meta")), (F.col("file") % 3 + 1).cast("int"))
    p = v.bench.withColumn("kind", kind).groupBy("section").pivot("kind", ["mz", "int_", "meta"]).agg(F.sum("raw"))
    return p.select("section", *rr("mz", "int_", "meta", places=2))


@query("o_a35_container", "bench", sql=", g as (select sample, sum(raw) as raw, sum(compressed) as compressed, count(*) as n from bench group by sample) select sample, round(raw, 2) as raw, case when compressed > 0 then round(raw / compressed, 6) else 0 end as ratio, case when n >= 3 then n end as complete from g")
def _(v: Views) -> DataFrame:
    g = v.bench.groupBy("sample").agg(F.sum("raw").alias("raw"), F.sum("compressed").alias("compressed"), F.count(F.lit(1)).alias("n"))
    return g.select("sample", r("raw", 2), F.when(F.col("compressed") > 0, F.round(F.col("raw") / F.col("compressed"), 6)).otherwise(0.0).alias("ratio"), F.when(F.col("n") >= 3, F.col("n")).alias("complete"))
