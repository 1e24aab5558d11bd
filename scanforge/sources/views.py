"""The driver's tables seen as scan data and as result tables.

Everything is a lazy projection of Parquet columns, so filters and column choices still reach the scans."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRID = 64


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def scans(self) -> DataFrame:
        """scan_idx, win, rt, mz and intensity arrays."""
        at = F.sequence(F.lit(0), F.size("embedding") - 1)
        return self.table("embeddings").select(
            F.col("vec_id").alias("scan_idx"),
            F.col("label").alias("win"),
            (F.col("vec_id") * F.lit(0.01)).alias("rt"),
            F.transform(at, lambda i: F.lit(400.0) + F.lit(0.01) * i).alias("mz"),
            F.transform("embedding", lambda x: F.greatest(F.lit(0.0), x.cast("double"))).alias("intensity"),
        )

    @cached_property
    def recon(self) -> DataFrame:
        return self.scans.withColumn("mz", F.transform("mz", lambda x: F.rint(x * 1e6) / 1e6)).withColumn("intensity", F.transform("intensity", lambda x: F.rint(x * 1000) / 1000))

    @staticmethod
    def explode(scans: DataFrame) -> DataFrame:
        z = F.posexplode(F.arrays_zip("mz", "intensity")).alias("pos", "z")
        return scans.select("scan_idx", "win", "rt", z).select("scan_idx", "win", "rt", "pos", F.col("z.mz").alias("mz"), F.col("z.intensity").alias("intensity"))

    @cached_property
    def points(self) -> DataFrame:
        return self.explode(self.scans)

    @cached_property
    def recon_points(self) -> DataFrame:
        return self.explode(self.recon)

    @cached_property
    def centroid(self) -> DataFrame:
        """Irregular m/z: one scan a day of events, intensity from the user."""
        return self.table("events").where("value > 0").select(F.unix_date(F.to_date("ts")).cast("long").alias("scan_idx"), F.col("event_id").alias("idx"), F.col("value").alias("mz"), (F.col("user_id") + 1).cast("double").alias("intensity"))

    def quantities(self, side: str) -> DataFrame:
        """Summed amounts by order; every line counts on one of the two sides."""
        test = f"(l_orderkey + l_linenumber) % 2 = {int(side != 'original')}"
        cents = F.sum(F.rint(F.col("l_extendedprice") * 100).cast("long"))
        return self.table("lineitem").where(test).groupBy(F.col("l_orderkey").alias("id")).agg((cents / 100.0).alias("quantity"))

    def ids(self, side: str) -> DataFrame:
        test = "l_returnflag = 'R'" if side == "original" else "l_linestatus = 'F'"
        return self.table("lineitem").where(test).select(F.col("l_orderkey").alias("id")).distinct()

    @cached_property
    def bench(self) -> DataFrame:
        """method, sample, file, raw and compressed sizes."""
        o = self.table("orders").join(self.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("method")), "o_custkey")
        return o.select("method", F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("file"), F.col("o_orderpriority").alias("section"), F.col("o_totalprice").alias("raw"), (F.col("o_totalprice") / (1 + F.col("o_orderkey") % 7)).alias("compressed"))

    @cached_property
    def status(self) -> DataFrame:
        n = F.get_json_object("props", "$.k").cast("int")
        return self.table("events").select("event_id", "user_id", "event_type", "ts", "value", n.alias("k"))


#: The same views for DuckDB, as common table expressions.
SQL = {
    "points": "points as (select vec_id as scan_idx, label as win, vec_id * 0.01::double as rt, (i - 1)::int as pos, 400::double + 0.01::double * (i - 1) as mz, greatest(0::double, embedding[i]::double) as intensity from embeddings, generate_series(1, 64) t(i))",
    "recon": "recon as (select scan_idx, win, rt, pos, round_even(mz * 1e6::double, 0) / 1e6::double as mz, round_even(intensity * 1000, 0) / 1000 as intensity from points)",
    "centroid": "centroid as (select (ts::date - date '1970-01-01')::bigint as scan_idx, event_id as idx, value as mz, (user_id + 1)::double as intensity from events where value > 0)",
    "qa": "qa as (select l_orderkey as id, sum(round_even(l_extendedprice * 100, 0)::bigint)::double / 100.0::double as quantity from lineitem where (l_orderkey + l_linenumber) % 2 = 0 group by 1)",
    "qb": "qb as (select l_orderkey as id, sum(round_even(l_extendedprice * 100, 0)::bigint)::double / 100.0::double as quantity from lineitem where (l_orderkey + l_linenumber) % 2 = 1 group by 1)",
    "pairs": "pairs as (select id, coalesce(qa.quantity, 0) as qa, coalesce(qb.quantity, 0) as qb, case when coalesce(qa.quantity, 0) > 0 and coalesce(qb.quantity, 0) > 0 then 'shared' when coalesce(qa.quantity, 0) > 0 then 'original_only' when coalesce(qb.quantity, 0) > 0 then 'rebuilt_only' else 'zero' end as set_class, case when qa.quantity > 0 and qb.quantity > 0 then log2(qb.quantity / qa.quantity) end as fc from qa full join qb using (id))",
    "ia": "ia as (select distinct l_orderkey as id from lineitem where l_returnflag = 'R')",
    "ib": "ib as (select distinct l_orderkey as id from lineitem where l_linestatus = 'F')",
    "bench": "bench as (select c_mktsegment as method, o_custkey as sample, o_orderkey as file, o_orderpriority as section, o_totalprice as raw, o_totalprice / (1 + o_orderkey % 7) as compressed from orders join customer on c_custkey = o_custkey)",
    "status": "status as (select event_id, user_id, event_type, ts, value, json_extract_string(props, '$.k')::int as k from events)",
    "islands": "islands as (select scan_idx, win, min(pos) as array_start, count(*) as n_points, sum(mz * intensity) / sum(intensity) as center_mz, min(mz) as mz_start, max(intensity) as max_intensity, sum(intensity) as sum_intensity from (select *, pos - row_number() over (partition by scan_idx order by pos) as run from points where intensity > 0) group by scan_idx, win, run)",
}


def with_views(*names: str) -> str:
    return "with recursive " + ",\n".join(SQL[n] for n in names)
