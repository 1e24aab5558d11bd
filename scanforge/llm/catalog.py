"""The queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table

VOCABULARY = "word_bpe_49k.json"
SHARDS = 40
OLD_SHARDS = 32


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents; those of shards that lose or gain rows are read from the files that were rewritten."""
    from .reshard import reshard, rewrite_affected

    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), "source", "text")
    old = F.pmod(F.xxhash64("source"), F.lit(OLD_SHARDS))
    placed = reshard(docs, F.when(F.col("source").isNotNull(), old), F.col("size"), [F.col("doc_id")], SHARDS)
    path = new_path(spark, "shards")
    affected = rewrite_affected(placed, path)
    columns = ["doc_id", "size", "text_crc32", "shard", "slot", "old_shard"]
    out = placed.where(~F.col("shard").isin(affected)).select(*columns)
    if affected:
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema)
        out = out.unionByName(spark.read.schema(kinds).parquet(path).select(*columns))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import say, scan

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    return found.select(
        "doc_id",
        count(lambda s: s["kind"] == 0).alias("n_assign"),
        count(lambda s: s["kind"] == 1).alias("n_access"),
        count(lambda s: s["kind"] == 2).alias("n_hex"),
        F.sha2(say(base).cast("binary"), 256).alias("base_sha256"),
        say(F.col("spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_example"),
        count(lambda s: s["kind"] == 3).alias("n_owned"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["owners"])), F.lit(0)).alias("most_owners"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["repositories"])), F.lit(0)).alias("most_repositories"),
    )


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import removal_report

    return removal_report(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"))


def op5_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivots import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests

    return digests(table(spark, sf_dir, "documents"), vocabulary())


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, token_pieces

    return pack(token_pieces(table(spark, sf_dir, "documents"), vocabulary()))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, held_out, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups

    found = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_omh(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .omh import fingerprints

    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_reshard": op1_reshard, "op2_secrets": op2_secrets, "op3_suffix": op3_suffix, "op4_warc": op4_warc, "op5_pivots": op5_pivots, "op6_bpe": op6_bpe, "op7_pack": op7_pack, "op8_toxicity": op8_toxicity, "op9_simhash": op9_simhash, "op10_omh": op10_omh}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4, "op5_pivots": OP5}


#: Equal payloads of 100 bytes or more: the smallest page_id is the response.
OP4 = """
with own as (
  select page_id, encode(coalesce(html, '')) as raw from pages),
sized as (
  select page_id, octet_length(raw)::bigint as payload_bytes, sha256(raw) as payload_digest from own),
firsts as (
  select payload_digest, min(page_id) as first_id from sized where payload_bytes >= 100 group by 1)
select s.page_id, s.payload_bytes, s.payload_digest,
  case when f.first_id is null or f.first_id = s.page_id then 'response' else 'revisit' end as record_type,
  case when f.first_id <> s.page_id then f.first_id end as refers_to
from sized s left join firsts f on s.payload_digest = f.payload_digest
"""

#: Links by brute force within labels, components by reachability.
OP5 = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (
  select distinct a, b from link
  union
  select r.a, l.b from reach r join link l on r.b = l.a),
degree as (select a, count(*) as n from link group by a),
low as (select a, min(b) as b from reach group by a)
select e.vec_id, coalesce(d.n, 0)::bigint as n_links, least(e.vec_id, coalesce(w.b, e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce(w.b, e.vec_id)) as kept
from embeddings e left join degree d on d.a = e.vec_id left join low w on w.a = e.vec_id
"""
