"""The pipeline's stages on a small corpus with planted cases."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_stages(spark, tmp_path):
    bad = ["vilka", "grumot", "stinkle"]
    r = random.Random(2)
    docs, labels = [], []
    for i in range(240):
        own = prose(50, i).split()
        if i % 4 == 0:
            for _ in range(4):
                own[r.randrange(len(own))] = r.choice(bad)
        docs.append((i, " ".join(own), "en", f"s{i % 5}", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    shared = prose(100, 5000)
    near = prose(200, 6000).split()
    edited = near[:50] + ["edit"] + near[51:]
    docs += [(1001, prose(40, 1) + " " + shared, "en", "s1", 0), (1002, prose(40, 2) + " " + shared, "en", "s1", 0), (1003, " ".join(near), "en", "s1", 0), (1004, " ".join(edited), "en", "s2", 0), (1005, "my password = hunter2hunter2 " + prose(30, 3), "en", "s3", 0)]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as score", "1 as spans", "2 as k1").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        out.write.parquet(f"{folder}/{k}")
        last, now = now, spark.read.parquet(f"{folder}/{k}")
        kept[name] = now.toPandas()
        if name != "best_fit_packing":
            assert now.columns == last.columns
    clean = kept["toxicity"].doc_id
    assert sum(i % 4 == 0 for i in clean if i < 240) <= 9 and sum(i % 4 != 0 for i in clean if i < 240) >= 170
    near_kept = set(kept["simhash_near_dedup"].doc_id)
    assert {1001, 1002, 1003} & set(clean) <= near_kept and 1004 not in near_kept
    texts = dict(zip(kept["suffix_array_dedup"].doc_id, kept["suffix_array_dedup"].text))
    assert shared[50:250] not in texts.get(1001, "") and shared[50:250] not in texts.get(1002, "")
    after = dict(zip(kept["secret_scans"].doc_id, kept["secret_scans"].text))
    assert 1005 not in after or ("hunter2" not in after[1005] and "[SECRET]" in after[1005])
    packed = kept["best_fit_packing"]
    assert set(packed.doc_id) == set(kept["secret_scans"].doc_id)
    assert packed.groupby("sequence_id").length.sum().max() <= 4096


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def through(spark, folder, docs, labels):
    """Every stage's rows for small tables."""
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    now, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, folder).write.parquet(f"{folder}/{k}")
        now = spark.read.parquet(f"{folder}/{k}")
        out.append(now.collect())
    return out


def test_no_documents(spark, tmp_path):
    assert [len(x) for x in through(spark, f"file://{tmp_path}", [], [])] == [0] * 5


def test_nulls_empties_and_only_copies(spark, tmp_path):
    text = prose(30, 3)
    docs = [(i, text, "en", "s", len(text)) for i in range(40)] + [(100, None, None, None, None), (101, None, "en", "s", None), (102, "", "en", "s", 0), (None, prose(9, 4), "en", "s", 1), (None, None, None, None, None)]
    out = through(spark, f"file://{tmp_path}", docs, [(1, 1, 0)])
    assert len(out[0]) == len(docs)
    # one of the copies, one of the texts without words, and rows without a doc_id, which have no name to go by
    assert sorted(str(r["doc_id"]) for r in out[1]) == ["0", "100", "None", "None"]
    assert {(r["doc_id"], r["text"]) for r in out[3] if r["doc_id"] is not None} == {(0, text), (100, None)}
    assert {r["doc_id"] for r in out[4]} == {0, 100, None} and max(r["sequence_id"] for r in out[4]) == min(r["sequence_id"] for r in out[4])
