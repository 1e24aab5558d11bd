"""A corpus pipeline over ``documents``: five stages, each a training-data operator whose decisions take effect.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of ``documents``:

* toxicity: documents scored 0.5 or more go;
* simhash_near_dedup: of each group of copies and near copies the smallest doc_id stays;
* suffix_array_dedup: passages of 400 bytes that stand anywhere else go, and documents of which nothing remains;
* secret_scans: live-looking secrets are replaced by a mark;
* best_fit_packing: the remaining texts as token pieces, packed into sequences of 4096.

Defined results: rows without a doc_id pass every stage, as they have no name by which to be a copy; null and empty texts
are texts without words, of which one row stays; an empty table gives an empty result; with no labels of both kinds no
document is rejected; extra columns of any name pass unchanged.

No stage can be written in SQL that DuckDB runs (trained scores, fingerprints, suffix order), so ``ORACLE_SQL`` is None.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanforge.llm import common
from scanforge.llm.catalog import vocabulary

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from scanforge.llm.toxicity import fit, score

    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs.withColumn("copy", F.col("text")), model, "copy").where("score < 0.5").select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from scanforge.llm.simhash import drop_copies

    return drop_copies(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from scanforge.llm.suffix_dedup import kept_texts

    kept = kept_texts(docs.withColumn("empty", F.coalesce(F.length("text"), F.lit(0)) == 0))
    return kept.where(F.col("empty") | (F.length("text") > 0)).select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from scanforge.llm.secrets import redact, scan

    found = scan(docs, keep_text=True)
    return found.withColumn("text", redact(F.col("text"), F.col("spans"))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from scanforge.llm.packing import pack, token_pieces

    return pack(token_pieces(docs, vocabulary()))


OWN = ["doc_id", "text", "source"]


#: How to remove the shared-folder tables of the stage that last began over a folder.
_release: dict[str, Callable[[], None]] = {}


def fresh(stage):
    """Run a stage on the columns it knows, all others packed into one, so extra columns of any name pass unchanged.

    A text that a stage shortens gets its new n_chars.  The tables that the stage before left in the shared folder for
    the same ``sf_dir`` are removed first: its result is written, so nothing reads them any more.  Tables of other
    queries stay."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _release.pop(sf_dir, lambda: None)()
        with common.scope(spark) as release:
            _release[sf_dir] = release
            out = stage(spark, common.packed(docs, OWN), sf_dir)
        if "rest" not in out.columns:
            return out
        out = common.unpacked(out, docs.columns, OWN)
        if "n_chars" not in docs.columns:
            return out
        n = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
        return out.withColumn("n_chars", n)

    return run_stage


STAGES = [(f.__name__, fresh(f)) for f in (toxicity, simhash_near_dedup, suffix_array_dedup, secret_scans, best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; every earlier one is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    path = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        last, path = path, f"{common.shared_dir(spark).rstrip('/')}/pipeline-{common.uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        common.drop_path(spark, last)
    raise ValueError("no stages")
