"""Queries for sources, sinks, sections and the remaining tables; registered in the same catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions import stats
from ..operators import compare, encode, islands, matching, recovery, sections
from ..operators.ranks import numbered
from ..sources import mzml
from ..sources import tables as readers
from ..sources.views import Views
from .catalog import CODES, ISLAND_ARRAYS, PAIRED, PAIRS, codes, island_arrays, long, paired, pairs, query, r

# ---------------------------------------------------------------- sources and sinks


@query("o_s3_discovery", sql="select page_id, url, row_number() over (order by (contains(lower(url), 'a'))::int desc, url, page_id) as place from pages where not contains(lower(url), 'zz')")
def _(v: Views) -> DataFrame:
    pages = v.table("pages").where(~F.contains(F.lower("url"), F.lit("zz"))).select("page_id", "url")
    order = [F.desc(F.contains(F.lower("url"), F.lit("a"))), F.col("url"), F.col("page_id")]
    return numbered(pages, order).select("page_id", "url", (F.col("place") + 1).alias("place"))


@query("o_s5_level_limit", sql="select vec_id as scan_idx from embeddings where label % 2 = 1 order by vec_id limit 50")
def _(v: Views) -> DataFrame:
    return v.scans.where("win % 2 = 1").select("scan_idx").orderBy("scan_idx").limit(50)


@query("o_s6_array_decode", "points", sql="select scan_idx, 64::bigint as n, round(sum(intensity), 6) as total from points group by scan_idx")
def _(v: Views) -> DataFrame:
    packed = v.scans.select("scan_idx", F.base64(encode.compress(encode.pack_doubles(F.col("intensity")), "zlib-6")).alias("t"))
    back = mzml.decode_arrays(F.regexp_replace("t", r"\s", ""), F.array(F.lit(mzml.F64), F.lit(mzml.ZLIB)))
    return packed.withColumn("x", back).select("scan_idx", F.size("x").cast("long").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


@query("o_s8_window_values", sql="select n_nationkey as id, round(n_nationkey * 1.23456::double, 4) as target, case when n_regionkey > 1 then round(n_regionkey * 0.25, 4) else 0 end::double as lower from nation")
def _(v: Views) -> DataFrame:
    entry = lambda name, x: F.struct(F.lit(name).alias("_accession"), x.cast("string").alias("_value"))
    target, lower = entry(mzml.TARGET, F.col("n_nationkey") * F.lit(1.23456)), entry(mzml.LOWER, F.col("n_regionkey") * F.lit(0.25))
    p = F.when(F.col("n_regionkey") > 1, F.array(lower, target)).otherwise(F.array(target))  # an offset that is not given is 0
    value = lambda a: F.coalesce(F.round(mzml.number(mzml.param(p, a)), 4), F.lit(0.0))
    return v.table("nation").select(F.col("n_nationkey").alias("id"), value(mzml.TARGET).alias("target"), value(mzml.LOWER).alias("lower"))


@query("o_s9_missing_only", sql="select c_custkey as id from customer where c_custkey not in (select o_custkey from orders)")
def _(v: Views) -> DataFrame:
    done = v.table("orders").select(F.col("o_custkey").alias("id"))
    return readers.missing_only(v.table("customer").select(F.col("c_custkey").alias("id")), done, ["id"])


@query("o_s10_supported", sql="select page_id from pages where not contains(lower(url), 'blog') and not contains(lower(html), '&amp;')")
def _(v: Views) -> DataFrame:
    return v.table("pages").where(readers.supported(F.col("url"), F.col("html"), ["blog"], ["&amp;"])).select("page_id")


@query("o_s12_sections", sql="select l_returnflag as section, count(*) as records, round(sum(l_tax), 4) as size from lineitem where l_returnflag in ('A', 'R') group by 1")
def _(v: Views) -> DataFrame:
    return v.table("lineitem").where(F.col("l_returnflag").isin("A", "R")).groupBy(F.col("l_returnflag").alias("section")).agg(F.count(F.lit(1)).alias("records"), F.round(F.sum("l_tax"), 4).alias("size"))


@query("o_s14_q_filter", sql="select distinct on (user_id) user_id from (select user_id, try_cast(json_extract_string(props, '$.k') as double) as q from events) where coalesce(q, 1) <= 0.01 or q is not null and q <= 5")
def _(v: Views) -> DataFrame:
    q = F.get_json_object("props", "$.k").try_cast("double")
    return v.table("events").where((F.coalesce(q, F.lit(1.0)) <= 0.01) | (q <= 5)).select("user_id").dropDuplicates(["user_id"])


@query("o_s15_inventory", sql="select label as win, count(*) as scans, min(vec_id) as first, max(vec_id) as last from embeddings group by 1")
def _(v: Views) -> DataFrame:
    # array columns are not read: only ids and windows reach the scan
    return v.table("embeddings").groupBy(F.col("label").alias("win")).agg(F.count(F.lit(1)).alias("scans"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))


@query("o_k3_index_offsets", sql="select doc_id, coalesce(sum(octet_length(encode(text)) + 1) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as at from documents")
def _(v: Views) -> DataFrame:
    size = v.table("documents").select("doc_id", "source", (F.octet_length("text") + 1).cast("long").alias("n"))
    return numbered(size, [F.col("doc_id")], ["source"], total="n").select("doc_id", F.col("n_before").alias("at"))


@query("o_k5_markdown", sql="select '| ' || n_nationkey || ' | ' || n_name || ' |' as value from nation union all select '| n_nationkey | n_name |' union all select '| --- | --- |'")
def _(v: Views) -> DataFrame:
    return readers.markdown(v.table("nation"), ["n_nationkey", "n_name"]).select("value")


# ---------------------------------------------------------------- projections


@query("o_p2_levels", sql="select label % 2 + 1 as ms_level, count(*) as scans from embeddings where label % 2 + 1 in (2) group by 1")
def _(v: Views) -> DataFrame:
    return v.scans.select((F.col("win") % 2 + 1).alias("ms_level")).where(F.col("ms_level").isin(2)).groupBy("ms_level").agg(F.count(F.lit(1)).alias("scans"))


@query("o_p3_sorted_arrays", "points", sql="select scan_idx, pos, round(mz, 6) as mz, round(intensity, 6) as intensity from points")
def _(v: Views) -> DataFrame:
    mixed = v.scans.withColumn("mz", F.reverse("mz")).withColumn("intensity", F.reverse("intensity"))
    z = F.array_sort(F.arrays_zip("mz", "intensity"))
    falls = F.exists(F.zip_with(F.slice("mz", F.lit(2), F.size("mz")), F.slice("mz", F.lit(1), F.size("mz") - 1), lambda b, a: b - a), lambda d: d < 0)
    done = mixed.withColumn("z", F.when(falls, z).otherwise(F.arrays_zip("mz", "intensity")))
    done = done.withColumn("mz", F.transform("z", lambda s: s["mz"])).withColumn("intensity", F.transform("z", lambda s: s["intensity"]))
    return Views.explode(done).select("scan_idx", "pos", r("mz"), r("intensity"))


@query("o_p5_vendor", sql="select p_partkey, case when regexp_matches(lower(p_name), 're|ro') then 'alpha' when regexp_matches(lower(p_name), 'a') then 'beta' else 'other' end as vendor from part")
def _(v: Views) -> DataFrame:
    return v.table("part").select("p_partkey", num.first_match(F.lower("p_name"), [("re|ro", "alpha"), ("a", "beta")], "other").alias("vendor"))


@query("o_p7_scope", sql="select c_custkey, c_mktsegment in ('BUILDING', 'MACHINERY') and c_acctbal > 0 as chosen from customer")
def _(v: Views) -> DataFrame:
    return v.table("customer").select("c_custkey", (F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_acctbal") > 0)).alias("chosen"))


@query("o_p15_flags", sql="select c_nationkey as nation, bool_and(coalesce(lower(trim(c_mktsegment)) not in ('household', 'machinery'), true)) as fine from customer group by 1")
def _(v: Views) -> DataFrame:
    fine = F.coalesce(~F.lower(F.trim("c_mktsegment")).isin("household", "machinery"), F.lit(True))
    return v.table("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.bool_and(fine).alias("fine"))


# ---------------------------------------------------------------- joins


@query(
    "o_j1_alignment",
    sql="with a as (select label as win, vec_id as x, row_number() over (partition by label order by vec_id) - 1 as ord from embeddings), b as (select label as win, vec_id as y, row_number() over (partition by label order by vec_id) - 1 as ord from embeddings where vec_id % 7 <> 0) select win, ord, x as scan_a, y as scan_b, y is null as missing_b from a full join b using (win, ord)",
)
def _(v: Views) -> DataFrame:
    slim = lambda df: df.select("win", "scan_idx", "mz")
    a = compare.align(slim(v.scans), slim(v.recon.where("scan_idx % 7 <> 0")), ["win"], "scan_idx")
    return a.select("win", long("ord"), F.col("scan_idx_a").alias("scan_a"), F.col("scan_idx_b").alias("scan_b"), "missing_b")


@query("o_j3_key_join", sql="select a.o_orderkey as id, count(*) as pairs from (select distinct o_orderkey from orders where o_orderstatus = 'F') a join (select distinct l_orderkey, l_partkey from lineitem where l_quantity > 40) b on a.o_orderkey = b.l_orderkey group by 1")
def _(v: Views) -> DataFrame:
    a = v.table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")).distinct()
    b = v.table("lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("id"), "l_partkey").distinct()
    return a.join(b, "id").groupBy("id").agg(F.count(F.lit(1)).alias("pairs"))


@query("o_j4_precursor_join", "qa", "qb", sql="select count(*) as shared, round(corr(qa.quantity, qb.quantity), 6) as pearson from qa join qb using (id)")
def _(v: Views) -> DataFrame:
    a, b = v.quantities("original").withColumnRenamed("quantity", "x"), v.quantities("rebuilt").withColumnRenamed("quantity", "y")
    return a.join(b, "id").agg(F.count(F.lit(1)).alias("shared"), F.round(stats.pearson(F.col("x"), F.col("y")), 6).alias("pearson"))


@query("o_j8_method_pairs", "bench", sql=", g as (select sample, section, max(raw) as x from bench group by 1, 2) select a.sample, round(a.x, 2) as first, round(b.x, 2) as second from g a join g b using (sample) where a.section = '1-URGENT' and b.section = '2-HIGH'")
def _(v: Views) -> DataFrame:
    g = v.bench.groupBy("sample", "section").agg(F.max("raw").alias("x"))
    side = lambda s, n: g.where(F.col("section") == s).select("sample", F.round("x", 2).alias(n))
    return side("1-URGENT", "first").join(side("2-HIGH", "second"), "sample")


WIDE = """, i as (select scan_idx, idx, mz, mz - 0.02 as lo, mz + 0.01 * (idx % 3) as hi, intensity, idx % 3 + 1 as n from centroid),
p as (select *, scan_idx + 1 as pair, row_number() over (partition by scan_idx order by mz, idx) as k from i),
c as (select * from (select scan_idx, idx, mz, lo, hi, intensity, n, side, sum(side) over (partition by scan_idx order by mz, side, idx rows between unbounded preceding and current row) as k from (select *, 0 as side from i union all select scan_idx + 1, idx, mz, lo, hi, intensity, n, 1 from i)) where side = 0),
m as (select c.scan_idx as pair, p.idx as prev, c.idx as curr, abs(c.mz - p.mz) / p.mz * 1e6 as ppm, greatest(c.lo, p.lo) as a, least(c.hi, p.hi) as b, greatest(c.hi, p.hi) - least(c.lo, p.lo) as span, 1 - abs(log2(c.intensity / p.intensity)) / 5 as alike, case when c.n = p.n then 1.0 else 0.5 end as same from c join p on p.pair = c.scan_idx and p.k between c.k - 1 and c.k + 3)
select pair, prev, curr, round(ppm, 3) as ppm, round(score, 6) as score from (select *, 0.5::double * (1 - ppm / 5000) + 0.2::double * (case when b > a then (b - a) / span else 0 end) + 0.2::double * greatest(0, alike) + 0.1::double * same as score from m where ppm < 5000) where score >= 0.3"""


@query("o_j15_wide_candidates", "centroid", sql=WIDE)
def _(v: Views) -> DataFrame:
    low, high = F.col("mz") - 0.02, F.col("mz") + 0.01 * (F.col("idx") % 3)
    i = v.centroid.select("scan_idx", "idx", F.col("mz").alias("center_mz"), low.alias("mz_low"), high.alias("mz_high"), F.col("intensity").alias("max_intensity"), (F.col("idx") % 3 + 1).alias("n_points"))
    return matching.wide_candidates(i, 5000.0).select("pair", "prev", "curr", r("ppm", 3), r("score"))


@query("o_j25_island_round_trip", "points", "islands", "recon", sql=", q as (select scan_idx, min(pos) as array_start, count(*) as n, max(intensity) as top from (select *, pos - row_number() over (partition by scan_idx order by pos) as run from recon where pos in (select pos from points p where p.scan_idx = recon.scan_idx and p.intensity > 0)) group by scan_idx, run) select scan_idx, count(*) as islands, round(max(abs(i.max_intensity - q.top)), 6) as max_error from islands i join q using (scan_idx, array_start) group by scan_idx")
def _(v: Views) -> DataFrame:
    a = islands.islands_positive(v.points).select("scan_idx", "array_start", "n_points", "max_intensity")
    both = v.points.select("scan_idx", "pos", "intensity").join(v.recon_points.select("scan_idx", "pos", F.col("mz"), F.col("intensity").alias("other")), ["scan_idx", "pos"])
    b = islands.runs(both, F.col("intensity") > 0).groupBy("scan_idx", "run").agg(F.min("pos").alias("array_start"), F.max("other").alias("top"))
    return a.join(b, ["scan_idx", "array_start"]).groupBy("scan_idx").agg(F.count(F.lit(1)).alias("islands"), F.round(F.max(F.abs(F.col("max_intensity") - F.col("top"))), 6).alias("max_error"))


@query("o_j26_first_existing", sql="select k as id, arg_min(p, o) as path from (select c_nationkey as k, 'c/' || c_nationkey as p, 1 as o from customer union all select n_nationkey, 'n/' || n_nationkey, 2 from nation) group by k")
def _(v: Views) -> DataFrame:
    a = v.table("customer").select(F.col("c_nationkey").alias("id"), F.concat(F.lit("c/"), F.col("c_nationkey").cast("string")).alias("path"), F.lit(1).alias("o"))
    b = v.table("nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("n/"), F.col("n_nationkey").cast("string")).alias("path"), F.lit(2).alias("o"))
    return sections.first_existing(a.union(b), ["id"], "path", "o")


# ---------------------------------------------------------------- aggregates


KINDS = {"A": "ms1", "N": "ms2", "R": "metadata"}


@query("o_a11_bytes", "points", sql="select win, count(*) * 8 as mz_bytes, count(*) filter (where intensity > 0) * 8 as intensity_bytes, greatest(0, 40000 - count(*) * 8)::bigint as other from points group by win")
def _(v: Views) -> DataFrame:
    n, k = F.count(F.lit(1)), F.count(F.when(F.col("intensity") > 0, 1))
    return v.points.groupBy("win").agg((n * 8).alias("mz_bytes"), (k * 8).alias("intensity_bytes"), F.greatest(F.lit(0), 40000 - n * 8).cast("long").alias("other"))


@query("o_a12_chromatogram", "points", sql="select win, count(distinct scan_idx) as points, round(min(rt), 6) as time_min, round(max(rt), 6) as time_max, round(max(intensity), 6) as intensity_max from points group by win")
def _(v: Views) -> DataFrame:
    return v.scans.groupBy("win").agg(F.count(F.lit(1)).alias("points"), F.round(F.min("rt"), 6).alias("time_min"), F.round(F.max("rt"), 6).alias("time_max"), F.round(F.max(F.array_max("intensity")), 6).alias("intensity_max"))


@query("o_a16_quality", sql="select l_partkey as id, round(sum(l_extendedprice), 2) as quantity, min(l_tax) as least_q, max(l_discount) as best, count(*) as n, round(log10(sum(l_extendedprice)), 6) as log_quantity from lineitem group by 1")
def _(v: Views) -> DataFrame:
    total = F.sum("l_extendedprice")
    return v.table("lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.round(total, 2).alias("quantity"), F.min("l_tax").alias("least_q"), F.max("l_discount").alias("best"), F.count(F.lit(1)).alias("n"), F.round(F.log10(total), 6).alias("log_quantity"))


@query("o_a19_rates", *PAIRS, sql="select round(s / a, 6) as recovery, round(l / a, 6) as loss, round(g / a, 6) as gain from (select count(*) filter (where set_class = 'shared') as s, count(*) filter (where set_class = 'original_only') as l, count(*) filter (where set_class = 'rebuilt_only') as g, count(*) filter (where qa > 0) as a from pairs)")
def _(v: Views) -> DataFrame:
    m = recovery.set_metrics(pairs(v), [])
    a = F.col("original_count")
    return m.select(F.round(F.col("shared_count") / a, 6).alias("recovery"), F.round(F.col("original_only") / a, 6).alias("loss"), F.round(F.col("rebuilt_only") / a, 6).alias("gain"))


@query("o_a29_index_bytes", sql="select event_type as level, sum(json_extract_string(props, '$.k')::int)::bigint as bytes, count(*) filter (where json_extract_string(props, '$.k') is null) as bad from events group by 1")
def _(v: Views) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return v.table("events").groupBy(F.col("event_type").alias("level")).agg(F.sum(k).cast("long").alias("bytes"), F.count(F.when(k.isNull(), 1)).alias("bad"))


@query("o_a30_tail_audit", *PAIRS, sql="select count(*) filter (where abs(fc) > 0.5) as over_0_5, count(*) filter (where abs(fc) > 2) as over_2_0, round(count(*) filter (where abs(fc) > 2) / count(fc), 6) as share_over_2_0 from pairs")
def _(v: Views) -> DataFrame:
    return recovery.tail(pairs(v), []).select("over_0_5", "over_2_0", r("share_over_2_0"))


@query("o_a34_breakdown", sql="select l_linestatus as file, (sum(l_quantity) filter (where l_returnflag = 'A'))::bigint as ms1, (sum(l_quantity) filter (where l_returnflag = 'N'))::bigint as ms2, (sum(l_quantity) filter (where l_returnflag = 'R'))::bigint as metadata, greatest(0, 10000000 - sum(l_quantity))::bigint as misc from lineitem group by 1")
def _(v: Views) -> DataFrame:
    rows = v.table("lineitem").select(F.col("l_linestatus").alias("file"), "l_returnflag", F.col("l_quantity").cast("long").alias("size"), F.lit(10000000).cast("long").alias("whole"))
    out = sections.breakdown(rows, ["file"], "l_returnflag", "size", "whole", KINDS)
    zero = lambda c: F.when(F.col(c) > 0, F.col(c)).alias(c)
    return out.select("file", zero("ms1"), zero("ms2"), zero("metadata"), "misc")


@query("o_a36_method_statistics", "bench", sql="select method, round(stddev_pop(raw), 4) as sd, round(min(raw), 2) as least, round(max(raw), 2) as most, round(median(raw), 4) as median, bool_and(compressed > 0) as fine from bench group by 1")
def _(v: Views) -> DataFrame:
    return v.bench.groupBy("method").agg(F.round(F.stddev_pop("raw"), 4).alias("sd"), F.round(F.min("raw"), 2).alias("least"), F.round(F.max("raw"), 2).alias("most"), F.round(F.percentile("raw", F.lit(0.5)), 4).alias("median"), F.bool_and(F.col("compressed") > 0).alias("fine"))


# ---------------------------------------------------------------- windows, sorts


@query("o_w7_numbering", sql="select vec_id as scan_idx, row_number() over (partition by label % 2 order by vec_id) - 1 as global_idx, row_number() over (partition by label order by vec_id) - 1 as local_idx from embeddings")
def _(v: Views) -> DataFrame:
    n = lambda key: (F.row_number().over(Window.partitionBy(key).orderBy("scan_idx")) - 1).cast("long")
    return v.scans.select("scan_idx", n(F.col("win") % 2).alias("global_idx"), n("win").alias("local_idx"))


@query("o_w12_delta2", "points", sql=f""", {CODES}, d as (select *, code - lag(code, 1, 0) over (partition by scan_idx order by pos) as d1 from codes), e as (select *, d1 - lag(d1, 1, 0) over (partition by scan_idx order by pos) as d2 from d) select scan_idx, sum(abs(code))::bigint as full, sum(abs(d1))::bigint as delta, sum(abs(d2))::bigint as delta2, sum(abs(d2)) < least(sum(abs(code)), sum(abs(d1))) as use_delta2 from e group by 1""")
def _(v: Views) -> DataFrame:
    d = encode.deltas(codes(v), "code", ["scan_idx"], ["pos"])
    out = d.groupBy("scan_idx").agg(F.sum(F.abs("code")).alias("full"), F.sum(F.abs("delta")).alias("delta"), F.sum(F.abs("delta2")).alias("delta2"))
    return out.withColumn("use_delta2", F.col("delta2") < F.least("full", "delta"))


@query("o_t8_stable_sort", "points", sql=f", {CODES} select win, scan_idx, pos, row_number() over (partition by win order by mz_q, scan_idx, pos) - 1 as place from codes where code > 0")
def _(v: Views) -> DataFrame:
    w = Window.partitionBy("win").orderBy("mz_q", "scan_idx", "pos")
    return codes(v).where("code > 0").select("win", "scan_idx", "pos", (F.row_number().over(w) - 1).cast("long").alias("place"))


@query("o_t10_batches", sql="select s_suppkey, (case when d < ceil(n / 4.0) then d else u // 3 end)::bigint as batch from (select s_suppkey, count(*) over () as n, row_number() over (order by s_acctbal desc, s_suppkey) - 1 as d, row_number() over (order by s_acctbal, s_suppkey desc) - 1 as u from supplier)")
def _(v: Views) -> DataFrame:
    return sections.balanced_batches(v.table("supplier"), "s_acctbal", "s_suppkey", 4).select("s_suppkey", "batch")


# ---------------------------------------------------------------- codec sections


@query("o_c4_mz_delta", "points", sql=f", {CODES} select scan_idx, pos, mz_q - lag(mz_q, 1, 0) over (partition by scan_idx order by pos) as step from codes")
def _(v: Views) -> DataFrame:
    return encode.deltas(codes(v), "mz_q", ["scan_idx"], ["pos"]).select("scan_idx", "pos", F.col("delta").alias("step"))


@query("o_c5_lossless", "points", sql="select scan_idx, pos, round(intensity, 9) as intensity from points")
def _(v: Views) -> DataFrame:
    back = encode.unpack_doubles(encode.pack_doubles(F.col("intensity")))
    return v.scans.select("scan_idx", F.posexplode(back).alias("pos", "x")).select("scan_idx", "pos", F.round("x", 9).alias("intensity"))


@query("o_c10_overflow", "points", sql=f", {CODES} select scan_idx, pos, (case when mz_q * 7 <= 2147483647 then mz_q * 7 else 0 end)::int as main, case when mz_q * 7 > 2147483647 then mz_q * 7 end as overflow, mz_q * 7 as back from codes")
def _(v: Views) -> DataFrame:
    s = sections.split_overflow(codes(v).withColumn("x", F.col("mz_q") * 7), "x")
    return s.select("scan_idx", "pos", "main", "overflow", sections.join_overflow(s).alias("back"))


@query("o_c12_bit_pack", "points", sql=f", {CODES}, s as (select scan_idx, count(*) as n, greatest(length(bin(max(code % 40))), 1) as w from codes group by 1) select scan_idx, (case when w <= 2 then w when w <= 4 then 4 when w <= 8 then 8 else w end)::int as width, ceil(n * case when w <= 2 then w when w <= 4 then 4 when w <= 8 then 8 else w end / 8.0)::bigint as bytes from s")
def _(v: Views) -> DataFrame:
    s = codes(v).groupBy("scan_idx").agg(sections.pack_width(F.max(F.col("code") % 40)).alias("width"), F.count(F.lit(1)).alias("n"))
    return s.select("scan_idx", F.col("width").cast("int").alias("width"), F.ceil(F.col("n") * F.col("width") / 8.0).cast("long").alias("bytes"))


@query(
    "o_c14_strategies",
    "points",
    sql=f""", {CODES}, d as (select scan_idx, pos, code, code - lag(code, 1, 0) over (partition by scan_idx order by pos) as d, (code = 0)::int as z, row_number() over (partition by scan_idx order by pos) - row_number() over (partition by scan_idx, (code = 0)::int order by pos) as run from codes),
u as (select *, case when z = 1 and count(*) over (partition by scan_idx, z, run) >= 4 then 2.0::double / count(*) over (partition by scan_idx, z, run) else 1 end as w from d),
w as (select scan_idx, count(*) as n, max(case when code >= 0 then 2 * code else -2 * code - 1 end) as p, max(case when d >= 0 then 2 * d else -2 * d - 1 end) as q, max(code + 1) as r, round_even(sum(w), 0) as m from u group by 1),
b as (select scan_idx, (8 + ceil(32 * n / 8.0))::bigint as plain, (8 + ceil((case when p = 0 then 0 else length(bin(p)) end) * n / 8.0))::bigint as packed, (8 + ceil((case when q = 0 then 0 else length(bin(q)) end) * n / 8.0))::bigint as delta, (8 + ceil(length(bin(r)) * m / 8.0))::bigint as zero_runs from w)
select *, case least(plain, packed, delta, zero_runs) when plain then 'plain' when packed then 'packed' when delta then 'delta' else 'zero_runs' end as strategy, least(plain, packed, delta, zero_runs) as bytes from b""",
)
def _(v: Views) -> DataFrame:
    return sections.stream_strategies(codes(v), "code", ["scan_idx"], "pos")


@query("o_c15_chunks", sql="select doc_id // 128 as chunk, count(*) as n from documents group by 1")
def _(v: Views) -> DataFrame:
    return sections.chunks(v.table("documents"), "doc_id", 128).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


@query("o_c19_grid_library", "points", sql=f"{ISLAND_ARRAYS} select scan_idx, start, win || '-' || start as track, pos_in_track, min(pos_in_track) over (partition by win, start, mz_q) as library from isl")
def _(v: Views) -> DataFrame:
    out = sections.grid_library(island_arrays(v), "track", "mz_q", "pos_in_track")
    return out.select("scan_idx", "start", "track", "pos_in_track", "library")


def grids(v: Views) -> DataFrame:
    return v.scans.select("scan_idx", "win", F.transform("mz", lambda x: num.quantise(x)).alias("mz_q"))


@query("o_c20_grid_sidecar", sql="select vec_id as scan_idx, 400000000::bigint as first, 63 as steps, false as signed, row_number() over (partition by label order by vec_id) > 1 as same_as_previous, 400000000::bigint + 10000 * 63 as last from embeddings")
def _(v: Views) -> DataFrame:
    s = sections.grid_sidecar(grids(v), "mz_q", "scan_idx", ["win"])
    back = sections.from_steps(F.col("first"), F.col("steps"))
    return s.select("scan_idx", "first", F.size("steps").alias("steps"), "signed", "same_as_previous", F.element_at(back, -1).alias("last"))


@query("o_c21_complement_sidecar", "points", "islands", sql=", s as (select * from points p where not exists (select 1 from islands i where i.scan_idx = p.scan_idx and p.pos >= i.array_start and p.pos < i.array_start + i.n_points)) select scan_idx, count(*) as points, round(min(mz), 6) as low, round(max(mz), 6) as high from s group by 1")
def _(v: Views) -> DataFrame:
    sizes = v.scans.select("scan_idx", F.size("mz").cast("long").alias("n"))
    gaps = islands.complement(islands.islands_positive(v.points), sizes)
    at = gaps.select("scan_idx", F.explode(F.sequence(F.col("gap_start").cast("int"), (F.col("gap_start") + F.col("gap_points") - 1).cast("int"))).alias("pos"))
    return v.points.join(at, ["scan_idx", "pos"]).groupBy("scan_idx").agg(F.count(F.lit(1)).alias("points"), F.round(F.min("mz"), 6).alias("low"), F.round(F.max("mz"), 6).alias("high"))


@query("o_c22_orphan_layout", "points", "islands", sql=", o as (select p.scan_idx, p.pos from points p join islands i on i.scan_idx = p.scan_idx and p.pos >= i.array_start and p.pos < i.array_start + i.n_points where i.n_points < 3), g as (select scan_idx, count(*) as n from (select *, pos - row_number() over (partition by scan_idx order by pos) as run from o) group by scan_idx, run) select scan_idx, (sum(n) * 8)::bigint as point_bytes, (count(*) * 8 + sum(n) * 4)::bigint as run_bytes, case when count(*) * 8 + sum(n) * 4 < sum(n) * 8 then 'runs' else 'points' end as layout from g group by 1")
def _(v: Views) -> DataFrame:
    o = islands.orphans(v.points, islands.islands_positive(v.points, least=3))
    return sections.orphan_layouts(o, ["scan_idx"]).select("scan_idx", "point_bytes", "run_bytes", "layout")


@query("o_c24_cross_scan", "points", sql=f", {CODES} select scan_idx, count(distinct run) as islands, count(*) as points, sum(code)::bigint as total from (select scan_idx, code, pos - row_number() over (partition by scan_idx order by pos) as run from codes where code > 0) group by scan_idx")
def _(v: Views) -> DataFrame:
    """Encode islands against the one before in their track, decode by running sums along the track."""
    a = island_arrays(v).select("scan_idx", "start", "track", "pos_in_track", "codes")
    w = Window.partitionBy("track").orderBy("pos_in_track")
    coded = a.withColumn("delta", F.coalesce(F.zip_with("codes", F.slice(F.lag("codes").over(w), F.lit(1), F.size("codes")), lambda x, y: x - F.coalesce(y, F.lit(0))), F.col("codes")))
    flat = coded.select("track", "pos_in_track", "scan_idx", "start", F.posexplode("delta").alias("k", "d"), F.col("codes"))
    # a place that the island before lacks starts a new sum
    fresh = F.coalesce((F.lag("pos_in_track").over(Window.partitionBy("track", "k").orderBy("pos_in_track")) != F.col("pos_in_track") - 1).cast("int"), F.lit(1))
    marked = flat.withColumn("run", F.sum(fresh).over(Window.partitionBy("track", "k").orderBy("pos_in_track")))
    back = marked.withColumn("c", F.sum("d").over(Window.partitionBy("track", "k", "run").orderBy("pos_in_track")))
    return back.groupBy("scan_idx").agg(F.count_distinct("start").alias("islands"), F.count(F.lit(1)).alias("points"), F.sum("c").alias("total"))


@query("o_c25_reference_decode", sql="select vec_id as scan_idx, len(embedding) as n, list_sum(list_transform(embedding, lambda x: round_even(greatest(0::double, x::double) * 1000, 0)))::bigint as total from embeddings")
def _(v: Views) -> DataFrame:
    w = Window.partitionBy("win").orderBy("scan_idx")
    a = v.scans.select("win", "scan_idx", F.transform("intensity", lambda x: F.rint(x * 1000).cast("long")).alias("c"))
    rows = a.withColumn("island_idx", (F.row_number().over(w) - 1).cast("long")).withColumn("p", F.lag("c").over(w))
    coded = rows.select("win", "scan_idx", "island_idx", "c", F.when(F.col("p").isNotNull(), F.col("island_idx") - 1).alias("ref_idx"), F.coalesce(F.zip_with("c", "p", lambda x, y: x - y), F.col("c")).alias("delta"))
    back = encode.decode_references(coded.select(F.col("win").alias("file_id"), "island_idx", "ref_idx", "delta"))
    both = rows.select(F.col("win").alias("file_id"), "island_idx", "scan_idx", "c").join(back, ["file_id", "island_idx"])
    total = F.aggregate("codes", F.lit(0).cast("long"), lambda a, x: a + x)
    return both.select("scan_idx", F.size("codes").cast("long").alias("n"), total.alias("total"))


@query("o_c27_short_long", "points", "islands", sql=", t as (select win, array_start, count(*) as n from islands group by 1, 2) select case when n <= 3 then 'short' else 'long' end as class, sum(n)::bigint as islands from t group by 1")
def _(v: Views) -> DataFrame:
    i = islands.islands_positive(v.points, ["win", "scan_idx"]).withColumn("track", F.concat_ws("-", F.col("win").cast("string"), F.col("array_start").cast("string")))
    return sections.short_long(i, "track").groupBy("class").agg(F.count(F.lit(1)).alias("islands"))


@query("o_c28_dense_rows", "points", sql=f""", {CODES}, e as (select win, mz_q, count(*) as length, sum(code) as total, count(distinct scan_idx) as s from codes where code > 0 group by 1, 2), t as (select win, mz_q from (select *, row_number() over (partition by win order by length desc, total desc, mz_q) as k from e where s = length and length >= 3) where k <= 32)
select c.win, c.mz_q, count(*) as cells, count(*) filter (where code > 0) as present from codes c join t on c.win = t.win and c.mz_q = t.mz_q group by 1, 2""")
def _(v: Views) -> DataFrame:
    c = codes(v)
    top = encode.top_entries(encode.dictionary(c.where("code > 0").withColumn("intensity", F.col("code")), ["win"]), ["win"], 32).select("win", "mz_q")
    scans = v.scans.select("win", "scan_idx")
    grid = scans.join(top, "win").join(c.where("code > 0").select("win", "scan_idx", "mz_q", "code"), ["win", "scan_idx", "mz_q"], "left")
    return grid.groupBy("win", "mz_q").agg(F.count(F.lit(1)).alias("cells"), F.count("code").alias("present"))


@query("o_c33_dictionary_decode", "points", sql=f", {CODES} select scan_idx, win, count(*) as n, sum(code)::bigint as total from codes where code > 0 group by 1, 2")
def _(v: Views) -> DataFrame:
    f = encode.follow_deltas(codes(v).where("code > 0"), ["win"], "code")
    w = Window.partitionBy("win", "mz_q").orderBy("scan_idx", "pos")
    steps = f.select("win", "mz_q", F.row_number().over(w).alias("ord"), F.coalesce("scan_gap", "scan_idx").alias("scan_step"), F.coalesce("code_delta", "code").alias("code_step"))
    back = sections.decode_dictionary(steps, ["win"])
    return back.select("scan_idx", "win", F.size("code").cast("long").alias("n"), F.aggregate("code", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("o_c37_section_baselines")
def _(v: Views) -> DataFrame:
    return sections.section_baselines(v.scans, ["win"], "scan_idx", "intensity")


@query("o_c39_content_key", sql="select count(*) as keys, count(distinct r_name) as names from region")
def _(v: Views) -> DataFrame:
    return sections.keyed_by_content(v.table("region"), ["r_regionkey", "r_name"]).agg(F.count_distinct("content_key").alias("keys"), F.count_distinct("r_name").alias("names"))


# ---------------------------------------------------------------- statistics


EXACT = f"""{PAIRED.replace(", p as", ", own as", 1).replace("from p where", "from own where")}, d as (select floor((sample - 1) / 30.0)::bigint as part, d from q where d <> 0),
r as (select part, d, (2 * rank() over w + count(*) over (partition by part, abs(d)) - 1)::bigint as r2, row_number() over (partition by part order by abs(d), d) as k from d window w as (partition by part order by abs(d))),
g as (select part, count(*) as n, least(coalesce(sum(r2) filter (where d > 0), 0), coalesce(sum(r2) filter (where d < 0), 0)) as w2 from r group by part),
dp as (select part, 0::bigint as k, 0::bigint as s, 1::double as ways from g union all
  select part, k, s, sum(ways) from (select dp.part, r.k, dp.s + x * r.r2 as s, dp.ways from dp join r on r.part = dp.part and r.k = dp.k + 1, (values (0), (1)) v(x)) group by part, k, s),
low as (select g.part, g.n, sum(dp.ways) filter (where dp.s <= g.w2) as ways from g join dp on dp.part = g.part and dp.k = g.n group by g.part, g.n)
select distinct floor((q.sample - 1) / 30.0)::bigint as part, coalesce(low.n, 0) as n, round(least(1, 2 * low.ways / pow(2, low.n)), 6) as p_value from q left join low on low.part = floor((q.sample - 1) / 30.0)::bigint"""


@query("o_m4_exact_wilcoxon", "bench", sql=EXACT)
def _(v: Views) -> DataFrame:
    """Exact p of the samples' pairs, in tables of 30 consecutive samples (the reference's has 30 files); no pair is left out."""
    q = paired(v).select(F.floor((F.col("sample") - 1) / 30).cast("long").alias("part"), F.round(F.col("a") - F.col("b"), 6).alias("d"))
    ranked = q.where("d <> 0").withColumn("r", stats.average_rank(F.abs("d"), ["part"]))
    got = ranked.groupBy("part").agg(F.collect_list("r").alias("ranks"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("up"), F.sum("r").alias("all"))
    p = F.udf(lambda ranks, w: stats.exact_signed_rank_p(ranks, w), "double")
    tested = got.select("part", F.size("ranks").cast("long").alias("n"), F.round(p("ranks", F.least("up", F.col("all") - F.col("up"))), 6).alias("p_value"))
    return q.select("part").distinct().join(tested, "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("n"), "p_value")


@query("o_m5_rank_biserial", "bench", sql=", p as (select sample, avg(raw / compressed) filter (where section = '1-URGENT') as a, avg(raw / compressed) filter (where section = '5-LOW') as b from bench group by sample), z as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0 as r from (select round(a - b, 6) as d from p where a is not null and b is not null) where d <> 0) select round((sum(r) filter (where d > 0) - sum(r) filter (where d < 0)) / sum(r), 6) as rank_biserial from z")
def _(v: Views) -> DataFrame:
    return stats.signed_ranks(paired(v), [], F.round(F.col("a") - F.col("b"), 6)).select(r("rank_biserial"))


@query("o_m7_match_quality", "ia", "ib", sql="select round(s / b, 6) as precision, round(s / a, 6) as recall, round(2 * s / (a + b), 6) as f1 from (select (select count(*) from ia) as a, (select count(*) from ib) as b, (select count(*) from ia join ib using (id)) as s)")
def _(v: Views) -> DataFrame:
    m = recovery.membership(v.ids("original"), v.ids("rebuilt"), ["id"])
    q = m.select(*matching.match_quality(F.col("shared") + F.col("lost"), F.col("shared") + F.col("gained"), F.col("shared")))
    return q.select(r("precision"), r("recall"), r("f1"))


@query("o_m11_weak_verdict", "points", "recon", sql="select win, max(abs(p.mz - q.mz)) <= 5e-7 + 1e-10 and max(abs(p.intensity - q.intensity)) <= 0.05 + 1e-10 as passed from (select * from points) p join (select scan_idx, pos, mz, intensity from recon) q using (scan_idx, pos) group by win")
def _(v: Views) -> DataFrame:
    pairs_ = compare.align(v.scans, v.recon, ["win"], "scan_idx")
    out = compare.rollup(pairs_, compare.spectrum_errors(pairs_), ["win"])
    return compare.verdict(out, F.lit(False), F.lit(True), full=False).select("win", "passed")
