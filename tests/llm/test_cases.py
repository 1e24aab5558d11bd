"""Cases every operator must bear: very long texts, nulls, empties, ties, repeated rows, clashing names; slow forms of the methods."""

import gzip
import hashlib
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanforge.llm import bpe, common, omh, packing, pivots, reshard, secrets, simhash, suffix_dedup, toxicity, warc

from test_ops import SCHEMA, base_spans, brute_removal, prose, slow_fingerprint, slow_omh

CLASH = ["k1", "k2", "h", "x", "spots", "rest", "t", "fp", "key", "_row", "value", "digest", "score", "rank", "spans", "cuts", "m", "ids", "slot", "old_shard"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, repeated rows, a very long text, and columns named like those inside the operators."""
    long = prose(120_000, 77)
    texts = [long, long[:1000] + " cut " + long[1000:], None, "", " ", "a", "a", "b" * 5000, prose(300, 5), prose(300, 5)]
    rows = [(i, t, "en", None if i == 3 else "s", 0) for i, t in enumerate(texts)]
    rows += [rows[8], (None, None, None, None, None), (None, "no id", "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    return common.pin(df.select("*", *(F.lit("clash").alias(c) for c in CLASH)).coalesce(3))


@pytest.fixture(scope="module")
def odd_rows(odd):
    return odd.collect()


def kept_names(df):
    return {c for c in df.columns if c in CLASH}


def test_reshard_of_odd_rows(odd, odd_rows):
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 16
    got = reshard.reshard(odd, F.pmod("doc_id", F.lit(7)), size, [F.col("doc_id")], 3).collect()
    shards = Counter(r["shard"] for r in got)
    assert len(got) == len(odd_rows) and max(shards.values()) - min(shards.values()) <= 1
    for j, n in shards.items():
        assert sorted(r["slot"] for r in got if r["shard"] == j) == list(range(n))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reshard_moves_the_fewest_bytes_of_all_plans(spark, seed):
    r = random.Random(seed)
    n_old, n_new = r.choice([(3, 2), (2, 4), (4, 3)])
    rows = [(i, r.choice([0, 0, 0, *range(n_old)]), r.choice([5, 5, *range(1, 60)])) for i in range(40)]
    df = spark.createDataFrame(rows, "i long, o int, n long")
    got = reshard.reshard(df, F.col("o"), F.col("n"), [F.col("i")], n_new).collect()
    moved = sum(x["n"] for x in got if x["old_shard"] != x["shard"])
    q, extra = divmod(len(rows), n_new)
    sizes = [sorted(n for _, o, n in rows if o == k) for k in range(max(n_old, n_new))]
    best = None
    for mask in range(1 << n_new):
        if bin(mask).count("1") == extra:
            room = [q + (mask >> j & 1) for j in range(n_new)]
            cost = sum(sum(s[: max(0, len(s) - (room[o] if o < n_new else 0))]) for o, s in enumerate(sizes))
            best = cost if best is None else min(best, cost)
    assert moved == best


def test_secrets_in_odd_rows(odd, odd_rows):
    got = secrets.scan(odd, keep_text=True).collect()
    assert len(got) == len(odd_rows) and all(r["h"] == "clash" for r in got)
    assert all([(s["start"], s["kind"], s["stop"]) for s in r["spans"] if s["kind"] < 3] == base_spans(r["text"] or "") for r in got)


def test_many_secrets_in_a_long_text(spark):
    text = " ".join(f"token={i:012d}" for i in range(4000))
    got = secrets.scan(spark.createDataFrame([(1, text, "o")], "doc_id long, text string, source string"), keep_text=True)
    r = got.select("text", "spans", secrets.redact(F.col("text"), F.col("spans")).alias("clean")).first()
    assert [(s["start"], s["kind"], s["stop"]) for s in r["spans"]] == base_spans(text) and r["clean"] == " ".join(["[SECRET]"] * 4000)


def test_suffix_dedup_of_odd_rows(odd, odd_rows):
    want = Counter((r["doc_id"], *w) for r, w in zip(odd_rows, slow_long_removal([r["text"] for r in odd_rows])))
    report = suffix_dedup.removal_report(odd).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in report) == want
    assert Counter((r["doc_id"], r["n_repeated_words"]) for r in report) == Counter(zip((r["doc_id"] for r in odd_rows), slow_repeated_words([r["text"] for r in odd_rows])))
    kept = suffix_dedup.kept_texts(odd)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows)


def slow_long_removal(texts):
    """``brute_removal`` with hashes in place of strings, for long texts."""
    raw = [(t or "").encode() for t in texts]
    n = Counter(hash(t[i : i + 400]) for t in raw for i in range(len(t) - 399))
    out = []
    for t in raw:
        mask = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - 399):
            if n[hash(t[i : i + 400])] > 1:
                mask[i] += 1
                mask[i + 400] -= 1
        gone = np.cumsum(mask)[:-1] > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def slow_repeated_words(texts):
    """Words in runs of 50 that another row has too."""
    words = [(t or "").encode().split() for t in texts]
    holders = {}
    for i, w in enumerate(words):
        for a in range(len(w) - 49):
            holders.setdefault(tuple(w[a : a + 50]), set()).add(i)
    out = []
    for w in words:
        hit = [False] * len(w)
        for a in range(len(w) - 49):
            if len(holders[tuple(w[a : a + 50])]) > 1:
                hit[a : a + 50] = [True] * 50
        out.append(sum(hit))
    return out


def test_words_of_repeated_passages(spark):
    passage, other = prose(55, 900), prose(50, 901)
    texts = [prose(30 + i, i) + " " + passage + "\n" + prose(20, 50 + i) for i in range(4)] + [prose(9, 61) + " " + other, other, " ".join(passage.split()[3:52]), prose(60, 70) + " x " + prose(60, 70)]
    texts += [prose(40, 80) + " " + " ".join(passage.split()[2:]) + " end", prose(200, 81), prose(200, 81), None, "", "é " * 80]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeated_words"] for r in suffix_dedup.removal_report(df).collect()}
    assert got == dict(enumerate(slow_repeated_words(texts)))


def test_the_two_slow_forms_agree():
    texts = [prose(150, 1) + prose(100, 2), prose(100, 2), None, "a" * 900]
    assert slow_long_removal(texts) == brute_removal(texts)


def test_foreign_archives(spark, tmp_path):
    def record(i, payload):
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID:<id{i}>\r\nWARC-Target-URI: u{i}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        return head + payload + b"\r\n\r\n"

    payloads = [b"", b"one\r\n\r\ntwo", bytes(range(256)) * 800, "é".encode() * 70_000]
    own = [record(i, p) for i, p in enumerate(payloads)]
    (tmp_path / "plain.warc").write_bytes(b"".join(own))
    (tmp_path / "together.warc.gz").write_bytes(gzip.compress(b"".join(own)))
    with open(tmp_path / "named.warc.gz", "wb") as f:
        for r in own:
            with gzip.GzipFile("a name", "wb", 6, f) as z:
                z.write(r)
    extra = b"\x1f\x8b\x08\x1e" + bytes(4) + b"\x00\xff" + b"\x05\x00ab\x01\x00z" + b"name\x00" + b"comment\x00" + b"\x00\x00"
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    (tmp_path / "fields.warc.gz").write_bytes(extra + z.compress(own[1]) + z.flush() + zlib.crc32(own[1]).to_bytes(4, "little") + len(own[1]).to_bytes(4, "little"))
    got = warc.read_archive(spark, f"file://{tmp_path}").collect()
    assert Counter((r["record_id"], bytes(r["payload"])) for r in got) == Counter({(f"<id{i}>", p): 3 + (i == 1) for i, p in enumerate(payloads)})
    heads = warc.read_archive(spark, f"file://{tmp_path}", payload=False).where("record_id = '<id2>'").collect()
    assert [(r["payload_length"], r["payload"]) for r in heads] == [(len(payloads[2]), None)] * 3
    (tmp_path / "broken.warc.gz").write_bytes(gzip.compress(own[2])[:-40])
    with pytest.raises(Exception, match="ends early"):
        warc.read_archive(spark, f"file://{tmp_path}").collect()


def test_vectors_of_two_lengths_and_clashing_names(spark):
    rows = [(i, 1, [1.0, 0.001 * i] + [0.0] * (2 if i % 2 else 6)) for i in range(6)] + [(9, 1, None), (10, None, [1.0, 0.0]), (11, 1, [float("nan"), 1.0]), (12, 1, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("k", F.lit(1)).withColumn("e", F.lit(1)).withColumn("id", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pivots.near_vectors(df).collect()}
    assert got == {i: (2, i % 2, i < 2) for i in range(6)} | {i: (0, i, True) for i in (9, 10, 11, 12)}


@pytest.fixture(scope="module")
def vocab():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_long_words_and_texts_have_the_library_ids(vocab, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    monkeypatch.setattr(bpe, "PIECE", 50_000)
    library = tokenizers.Tokenizer.from_file(vocab)
    library.no_truncation()
    library.no_padding()
    r = random.Random(2)
    words = ["x" + "a" * 1023 + "y", "y" + "a" * 1023 + "x"]
    for n in (1023, 1024, 1025, 2048, 5000):
        letters = [r.choice("abé'1") for _ in range(n)]
        for _ in range(3):
            r.shuffle(letters)
            words.append("".join(letters))
    enc = bpe.Encoder(bpe.read_spec(vocab))
    for text in (" ".join(words), prose(60_000, 4) + "\n" + "z" * 120_000 + "\t" + prose(30_000, 6)):
        ids = enc.encode(text)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert enc.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_memory_of_encoding_does_not_grow_with_texts(vocab):
    enc = bpe.Encoder(bpe.read_spec(vocab))
    many = [prose(300, i) for i in range(1000)]
    whole = [" ".join(many)]
    enc.block(many[:1])  # tables that are made once
    tracemalloc.start()
    try:
        for texts in (many, whole):
            tracemalloc.reset_peak()
            held = tracemalloc.get_traced_memory()[0]
            for some in bpe.blocks(texts):
                enc.block(some)
            # two workers of an executor share what its heap leaves
            assert tracemalloc.get_traced_memory()[1] - held < 64 << 20
    finally:
        tracemalloc.stop()


def test_tokens_and_packing_of_odd_rows(odd, odd_rows, vocab):
    got = bpe.digests(odd, vocab).collect()
    enc = bpe.Encoder(bpe.read_spec(vocab))
    want = Counter((r["doc_id"], len(i), hashlib.sha256(i.astype("<u4").tobytes()).hexdigest()) for r in odd_rows for i in [enc.encode(r["text"] or "")])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in got) == want
    packed = packing.pack(packing.token_pieces(odd, vocab)).collect()
    assert sum(r["length"] for r in packed) == sum(r["n_tokens"] + 1 for r in got)
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def slow_two_fit(pieces, capacity):
    """Best-two-fit bin by bin over the pieces themselves."""
    left, out = sorted(pieces, reverse=True), []
    while left:
        own = [left.pop(0)]
        gap = capacity - own[0]
        while (x := next((x for x in left if x <= gap), None)) is not None:
            left.remove(x)
            own.append(x)
            gap -= x
        while gap > 0 and len(own) > 1:
            small = min(own)
            room = gap + small
            sums = [(a + b, -a, b) for i, a in enumerate(left) for b in left[i + 1 :] if small < a + b <= room]
            if not sums:
                break
            total, a, b = max(sums)
            own.remove(small)
            for x in (-a, b):
                left.remove(x)
                own.append(x)
            left = sorted([*left, small], reverse=True)
            gap += small - total
        out.append(sorted(own, reverse=True))
    return sorted(out)


def test_plan_equals_two_fit_bin_by_bin():
    r = random.Random(6)
    for _ in range(40):
        pieces = [r.choice([r.randint(1, 100), r.randint(30, 60), 100]) for _ in range(r.randint(0, 60))]
        plan = packing.plan_bins(Counter(pieces), 100)
        assert sorted(lengths for times, lengths in plan for _ in range(times)) == slow_two_fit(pieces, 100)


def slow_logit(p, x, at):
    """The network's logit of one window, word by word."""
    h = toxicity.HIDDEN
    own = [x[i] for i in at if i >= 0]
    sides = []
    for d, words in ((0, own), (1, own[::-1])):
        state, states = np.zeros(h), []
        for w in words:
            g, u = w @ p["in"][d] + p["in_b"][d][0], state @ p["rec"][d]
            z, r = (1 / (1 + np.exp(-(g[a : a + h] + u[a : a + h]))) for a in (0, h))
            state = z * state + (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :])
            states.append(state)
        sides.append(states if d == 0 else states[::-1])
    both = [np.concatenate(s) for s in zip(*sides)]
    e = np.array([np.tanh(b @ p["att"]) @ p["att_v"] for b in both])
    a = np.exp(e - e.max())
    return sum(w * b for w, b in zip(a / a.sum(), both)) @ p["out"] + p["out_b"][0]


def test_scores_equal_the_slow_network_over_all_windows():
    r = np.random.default_rng(4)
    p = toxicity.start(3)
    for k in ("word", "gram"):
        p[k] = (r.standard_normal(p[k].shape) * 0.5).astype(np.float32)
    texts = [prose(n, n) for n in (1, 5, 32, 33, 57, 200)]
    best, _ = toxicity.highest(p, texts)
    for text, got in zip(texts, best):
        feats = toxicity.Features([text])
        at, _ = feats.windows()
        assert {i for row in at.tolist() for i in row if i >= 0} == set(feats.which.tolist())
        assert abs(max(slow_logit(p, feats.inputs(p).astype(np.float64), row) for row in at.tolist()) - got) < 1e-3


def test_toxicity_of_odd_rows(spark, odd, odd_rows):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(9)] + [(1, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(odd, toxicity.fit(odd, labels)).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got) and "text" not in got[0]
    text = "".join(chr(97 + i % 26) for i in range(10_000))
    spread = spark.createDataFrame([(text,), ("short",), (None,)], "t string").select(toxicity.spread(F.col("t"), 3000).alias("s")).collect()
    assert spread[0]["s"].split(" ") == [text[:1000], text[4500:5500], text[9000:]] and spread[1]["s"] == "short" and spread[2]["s"] is None


def test_simhash_of_odd_rows(odd, odd_rows):
    got = Counter((r["doc_id"], r["fp"] & (1 << 64) - 1) for r in simhash.near_groups(odd).collect())
    assert got == Counter((r["doc_id"], slow_fingerprint(r["text"])) for r in odd_rows)
    kept = simhash.drop_copies(odd)
    assert kept.columns == odd.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {0, 5, 8} <= ids and not {1, 6, 9} & ids


def test_order_minhash_of_odd_rows(odd, odd_rows):
    got = {(r["doc_id"], r["fingerprint"]) for r in omh.fingerprints(odd).collect()}
    assert {(r["doc_id"], slow_omh(r["text"] or "")) for r in odd_rows} == got


def test_scopes_release_only_their_own(spark):
    held = common.pin(spark.range(3).toDF("x"))
    with common.scope(spark) as release:
        inner = common.pin(spark.range(5).toDF("x"))
        name = common.held_table(spark.range(4).toDF("x"), "t", 2, ["x"])
    assert inner.count() == 5 and spark.table(name.partition("@")[0]).count() == 4
    release()
    assert held.count() == 3
    with pytest.raises(Exception, match="not exist|NOT_EXIST|No such file|does not exist"):
        inner.count()
    assert not spark.catalog.tableExists(name.partition("@")[0])
