"""The training-data operators against brute force on small fixtures, with nulls, empties, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scanforge.llm import bpe, common, induced, omh, packing, pivots, reshard, secrets, simhash, suffix_dedup, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(7)
WORDS = ["".join(R.choice("abcdeéfgh") for _ in range(R.randint(1, 7))) for _ in range(120)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def fixture():
    base = prose(300, 1)
    edited = base.split()
    edited[150] = "changed"
    shared = prose(120, 2)
    texts = [base, base, " ".join(edited), prose(60, 3) + " " + shared + " " + prose(40, 4), prose(80, 5) + " " + shared, None, "", "one", "two words", "\n\t ", prose(40, 6) * 3, "a" * 1500, 'password = "hunter2hunter2" x', "token=short AKIA" + "B" * 16, "f" * 40 + " " + "0a" * 20]
    rows = [(i * 3, t, "en", "src0" if i % 3 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[2], (None, "no id here", None, "src1", 10), (3, "another text for a repeated id", "de", "src2", 5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture(), SCHEMA).withColumn("extra", F.lit(1))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------ op 1


def test_flow_moves_the_fewest_bytes():
    r = random.Random(3)
    for _ in range(30):
        sizes = {o: sorted(r.randint(1, 50) for _ in range(r.randint(0, 6))) for o in range(3)}
        n = sum(map(len, sizes.values()))
        blocks = {o: [(1, s) for s in v] for o, v in sizes.items()}
        plan = reshard.solve_transfers(blocks, [n // 3] * 3, n % 3)
        moved = sum(sum(sizes[o][: sum(k for (a, b), k in plan.items() if a == o != b)]) for o in sizes)
        best = None
        for keep in np.ndindex(*(len(v) + 1 for v in sizes.values())):
            if all(k <= n // 3 + 1 for k in keep):
                caps = sum(k == n // 3 + 1 for k in keep)
                if caps <= n % 3:
                    cost = sum(sum(v[: len(v) - k]) for v, k in zip(sizes.values(), keep))
                    best = cost if best is None else min(best, cost)
        assert moved == best


def test_reshard_law(spark, docs, empty, tmp_path):
    got = reshard.reshard(docs, F.length("source"), F.length(F.coalesce("text", F.lit(""))) + 16, [F.col("doc_id")], 5)
    rows = got.collect()
    assert len(rows) == docs.count() and "extra" in got.columns
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert reshard.reshard(empty, F.lit(0), F.lit(16), [F.col("doc_id")], 5).count() == 0
    again = reshard.reshard(docs.withColumn("shard", F.lit("mine")).withColumn("_size", F.lit("x")), F.lit(0), F.lit(1), [F.col("doc_id")], 2)
    assert again.schema["shard"].dataType.simpleString() == "int" and {r["_size"] for r in again.collect()} == {"x"}
    touched = reshard.rewrite_affected(got, f"file://{tmp_path}/shards")
    assert set(touched) == {x for r in rows if r["old_shard"] != r["shard"] for x in (r["old_shard"], r["shard"])}


def test_rewrite_keeps_other_shards(spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    rows = [(i, old, new, i) for i, (old, new) in enumerate([(0, 0), (0, 0), (1, 1), (1, 2), (2, 2), (3, 1)])]
    placed = spark.createDataFrame(rows, "doc_id long, old_shard int, shard int, slot long")
    placed.withColumn("shard", F.col("old_shard")).write.partitionBy("shard").parquet(path)
    kept = sorted(f.name for f in (tmp_path / "shards" / "shard=0").glob("*.parquet"))
    assert reshard.rewrite_affected(placed, path) == [1, 2, 3]
    assert sorted((r["doc_id"], r["shard"]) for r in spark.read.parquet(path).collect()) == [(i, new) for i, _, new, _ in rows]
    assert sorted(f.name for f in (tmp_path / "shards" / "shard=0").glob("*.parquet")) == kept


# ------------------------------------------------------------------ op 2


def base_spans(t):
    pattern = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in pattern.finditer(t) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def slow_secrets(rows):
    """Per row (owner, repository, text) the spans kind:start:stop, and whether each is live, by plain counting."""
    found = []
    for o, r, t in rows:
        base = [(a, k, b, t[a:b]) for a, k, b in base_spans(t)]
        base = [(a, k, b, re.search(r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$", v)[1] if k == 0 else v) for a, k, b, v in base]
        loose = [(m.start(), 3, m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9_-]{20,}", t) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and len(set(m[0])) >= 10]
        found.append(base + [x for x in loose if not any(b[0] < x[2] and x[0] < b[2] for b in base)])
    owners, places = defaultdict(set), defaultdict(set)
    for (o, r, _), own in zip(rows, found):
        for x in own:
            owners[x[3]].add(o)
            places[x[3]].add((o, r))
    live = lambda v: not (len(owners[v]) >= 3 or len(owners[v]) > 1 and len(places[v]) >= 6)
    return [sorted((a, k, b, len(owners[v]), len(places[v]), live(v)) for a, k, b, v in own if k < 3 or live(v)) for own in found]


def test_secret_spans_and_ownership(spark, docs, empty):
    texts = ["é😀 secret: 'abcdefgh1' API_KEY=x", "token=token: abcdefghij", "x " + "Zz9_" * 8 + "abcdefghkl", "Q7w8E9r0T1y2U3i4O5p6 then password: Q7w8E9r0T1y2U3i4O5p6", None]
    more = [(900 + i, t, "en", f"own{i}", 0) for i, t in enumerate(texts)] + [(950 + i, "key AKIAEXAMPLEEXAMPLE1 here", "en", f"o{i}", 0) for i in range(4)]
    more += [(960 + i, "one LoosE_value_0123456789 " + "0123456789abcdef" * 2, "en", f"p{i % 2}", 0) for i in range(7)]
    more += [(980 + i, "own Another-value_9876543210", "en", "p9", 0) for i in range(8)]
    df = docs.drop("extra").unionByName(spark.createDataFrame(more, SCHEMA))
    df = df.withColumn("_row", F.lit("x")).withColumn("value", F.lit(1)).withColumn("start", F.lit(2))
    got = secrets.scan(df, keep_text=True).withColumn("clean", secrets.redact(F.coalesce("text", F.lit("")), F.col("spans"))).collect()
    assert len(got) == df.count() and got[0]["_row"] == "x" and got[0]["start"] == 2
    want = slow_secrets([(r["source"], r["doc_id"], r["text"] or "") for r in got])
    for r, w in zip(got, want):
        t = r["text"] or ""
        assert [(s["start"], s["kind"], s["stop"], s["owners"], s["repositories"], s["live"]) for s in r["spans"]] == w
        assert [x[:3] for x in w if x[1] < 3] == base_spans(t)
        clean, at = "", 0
        for a, _, b, _, _, live in w:
            if live:
                clean, at = (clean + t[at:a] + "[SECRET]" if a >= at else clean), max(at, b)
        assert r["clean"] == clean + t[at:]
    assert all(not s["live"] for r in got if (r["doc_id"] or 0) in range(950, 980) for s in r["spans"])
    assert all(s["live"] for r in got if (r["doc_id"] or 0) >= 980 for s in r["spans"]) and any(s["kind"] == 3 for r in got if r["doc_id"] in (902, 980) for s in r["spans"])
    assert secrets.scan(empty).count() == 0


def test_redaction_merges_overlaps(spark):
    df = spark.createDataFrame([("0123456789", [(1, 0, 4, True, 0), (2, 2, 6, True, 4), (7, 1, 8, False, 6), (8, 1, 9, True, 6)])], "t string, s array<struct<start:int,kind:int,stop:int,live:boolean,reach:int>>")
    assert df.select(secrets.redact(F.col("t"), F.col("s")).alias("x")).first()["x"] == "0[SECRET]67[SECRET]9"


# ------------------------------------------------------------------ op 3


def shared_prefix(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("few, slice_, buffer", [(1, 3, 5), (4, 1 << 16, 40), (1 << 18, 1 << 16, 1 << 20)])
def test_induced_sorting_orders_all_suffixes(monkeypatch, few, slice_, buffer):
    monkeypatch.setattr(induced, "FEW", few)
    monkeypatch.setattr(induced, "SLICE", slice_)
    r = random.Random(4)
    for turn in range(25):
        strings = [[r.randint(1, 1 + turn % 4) for _ in range(r.randint(0, 30))] for _ in range(r.randint(1, 5))]
        strings += strings[:1] * (turn % 2)
        text = np.array([x for s in strings for x in [*s, 0]], np.int16)
        scratch = induced.Scratch(buffer)
        found = [(int(a), int(b)) for items, lcp, _ in induced.suffixes(text, 6, scratch) for a, b in zip(items, lcp)]
        scratch.close()
        assert scratch.spilled or len(text) <= 2 * buffer
        ends = np.flatnonzero(text == 0)
        got = [text[a : ends[np.searchsorted(ends, a)]].tolist() for a, _ in found]
        assert sorted(a for a, _ in found) == list(range(len(text))) and got == sorted(got)
        assert [b for _, b in found] == [0] + [shared_prefix(x, y) for x, y in zip(got, got[1:])]


def test_induced_sorting_of_a_shard_larger_than_its_memory():
    import resource

    r = np.random.default_rng(1)
    base = [r.integers(97, 105, 200).astype(np.int16) for _ in range(400)]
    strings = [np.r_[x[: r.integers(20, 180)], r.integers(97, 105, 100).astype(np.int16)] for x in base for _ in range(6)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got, spilled = induced.repeated_starts(strings, 40, 258, buffer=20_000)
    assert spilled > 20 * 20_000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000
    n = Counter(bytes(s[i : i + 40].astype(np.uint8)) for s in strings for i in range(len(s) - 39))
    want = {(k, i) for k, s in enumerate(strings) for i in range(len(s) - 39) if n[bytes(s[i : i + 40].astype(np.uint8))] > 1}
    assert {(k, i) for k, a, b in got for i in range(a, b + 1)} == want


def test_anchors_cover_and_agree():
    text = (prose(400, 9) + "z" * 900 + prose(100, 9)).encode()
    h, at, low, high = suffix_dedup.anchors(text)
    assert low[0] == 0 and high[-1] == len(text) - 400 and (low[1:] == high[:-1] + 1).all()
    assert all(a >= y and a + suffix_dedup.GRAM <= x + 400 for a, x, y in zip(at, low, high))
    offset = {}
    for i, (a, x, y) in enumerate(zip(at, low, high)):
        for p in range(x, y + 1):
            assert offset.setdefault(text[p : p + 400], (int(a) - p, int(h[i]))) == (int(a) - p, int(h[i]))


def brute_removal(texts):
    raw = [(t or "").encode() for t in texts]
    n = Counter(t[i : i + 400] for t in raw for i in range(len(t) - 399))
    out = []
    for t in raw:
        mask = bytearray(len(t))
        for i in range(len(t) - 399):
            if n[t[i : i + 400]] > 1:
                mask[i : i + 400] = b"\1" * 400
        kept = bytes(x for x, m in zip(t, mask) if not m)
        out.append((len(t), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_suffix_dedup(spark, docs, empty, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    common_ = prose(150, 21)
    more = [(1000 + i, prose(20 + 7 * i, 30 + i) + common_ + prose(30 + i, 50 + i), "en", "s", 0) for i in range(6)]
    df = docs.drop("extra").unionByName(spark.createDataFrame(more, SCHEMA))
    rows = df.collect()
    want = Counter((r["doc_id"], *w) for r, w in zip(rows, brute_removal([r["text"] for r in rows])))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.removal_report(df).collect())
    assert got == want
    if crowd == 1:
        kept = {r["doc_id"]: r["text"] for r in suffix_dedup.kept_texts(df.withColumn("k1", F.lit("x")).withColumn("kept", F.lit(0)).where("doc_id >= 1000 or doc_id in (15, 18)")).collect()}
        assert kept[15] is None and kept[18] == "" and all(common_[100:300] not in kept[i] for i in range(1000, 1006))
        assert suffix_dedup.removal_report(empty).count() == 0


# ------------------------------------------------------------------ op 4


def test_warc(spark, tmp_path):
    big = "<p>é" + "x" * 200
    rows = [(5, "http://a", big), (2, "http://b\nc", big), (7, None, "short"), (8, "u", "short"), (9, "u", None), (None, "u", big), (11, "u", "y" * 70000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    path = f"file://{tmp_path}/warc"
    got = {r["page_id"]: r for r in warc.archive_pages(pages, path).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == hashlib.sha256(raw).hexdigest()
    assert (got[5]["record_type"], got[5]["refers_to"], got[2]["record_type"], got[None]["refers_to"]) == ("revisit", 2, "response", 2)
    assert got[7]["record_type"] == got[8]["record_type"] == "response"
    archive = warc.read_archive(spark, path)
    assert archive.where("target_uri = 'http://b c'").count() == 1
    heads = warc.read_archive(spark, path, payload=False).where("record_type in ('response')").collect()
    assert len(heads) == 5 and all(r["payload"] is None for r in heads)
    assert warc.archive_pages(pages.where("false"), f"file://{tmp_path}/none").count() == 0
    import gzip

    files = [f for f in (tmp_path / "warc").iterdir() if f.name.endswith(".gz")]
    assert b"".join(gzip.decompress(f.read_bytes()) for f in files).count(b"WARC/1.1") == 7


# ------------------------------------------------------------------ op 5


def test_pivot_index(spark):
    r = np.random.default_rng(0)
    centres = r.standard_normal((30, 16))
    x = np.concatenate([centres, centres + r.standard_normal((30, 16)) * 0.08, centres[:5], centres[:5] * 2])
    label = [int(i) % 3 for i in range(30)] * 2 + [0, 1, 2, 0, 1] * 2
    rows = [(100 + i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, label))]
    odd = [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] * 16, 0), (904, centres[0].tolist(), None), (905, [1.0, None], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit(0))
    got = {r["vec_id"]: r for r in pivots.near_vectors(df, cell=7).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.98) & (np.array(label)[:, None] == np.array(label))
    np.fill_diagonal(near, False)
    found = sum(got[100 + i]["n_links"] for i in range(len(x)))
    assert found <= near.sum() and found >= 0.9 * near.sum()
    for i in range(len(x)):
        assert got[100 + i]["n_links"] <= near[i].sum()
    for i in range(900, 906):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert pivots.near_vectors(df.where("false")).count() == 0


def test_pivot_index_finds_a_dense_group(spark):
    r = np.random.default_rng(1)
    centre = r.standard_normal(64)
    x = np.concatenate([centre + r.standard_normal((150, 64)) * 0.09, r.standard_normal((250, 64))])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {q["vec_id"]: q["n_links"] for q in pivots.near_vectors(df, cell=90).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.98).sum(1) - 1
    assert near.sum() > 10_000 and sum(got.values()) >= 0.9 * near.sum()
    assert all(got[i] <= near[i] for i in got)


# ------------------------------------------------------------------ ops 6 and 7


@pytest.fixture(scope="module")
def vocab():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_bpe_equals_library(vocab):
    from tokenizers import Tokenizer

    lib, enc = Tokenizer.from_file(vocab), bpe.Encoder(bpe.read_spec(vocab))
    texts = [t or "" for _, t, *_ in fixture()] + ["Σίσυφος ΟΔΟΣ", "a\x1cb c\x1f", "x y z\x85w", "İ K", "é ́a", "it's we'll DON'T 'S 's's ''s x'llama", "<|endoftext|>a<|startoftext|> b<|endoftext|>", "日本語 ☃☃ 😀", "ⅣⅤ²³½", "１２ ａｂ ﬁ ß", "​x﻿", "नमस्ते อะไร", "3's4'", "aaaa " * 50]
    for t, ids in zip(texts, enc.block(texts)):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert enc.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_bpe_queries(docs, empty, vocab):
    got = bpe.encode_documents(docs, vocab)
    assert got.count() == docs.count() and "extra" in got.columns
    assert {r["n_tokens"] for r in got.where("doc_id in (15, 18)").collect()} == {0}
    assert bpe.digests(docs, vocab).count() == docs.count() and bpe.digests(empty, vocab).count() == 0


def test_packing(docs, empty, vocab):
    pieces = packing.token_pieces(docs, vocab, 64, with_ids=True)
    packed = packing.pack(pieces, 64)
    rows = packed.collect()
    bins = defaultdict(list)
    for r in rows:
        assert r["length"] <= 64 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for low, n in sorted(own):
            assert low == at
            at += n
        assert at <= 64
    least = -(-sum(r["length"] for r in rows) // 64)
    assert len(rows) == pieces.count() and len(bins) <= least + 2
    assert packing.sequences(packed).count() == len(bins)
    assert packing.pack(packing.token_pieces(empty, vocab)).count() == 0


def test_two_fit_replaces_the_smallest():
    plan = packing.plan_bins({60: 1, 30: 1, 20: 1, 19: 1}, 100)
    assert plan[0] == (1, [60, 20, 19]) or sum(plan[0][1]) >= 99
    for seed in range(20):
        r = random.Random(seed)
        hist = {r.randint(1, 100): r.randint(1, 9) for _ in range(20)}
        used = Counter()
        for times, lengths in packing.plan_bins(hist, 100):
            assert sum(lengths) <= 100
            for x in lengths:
                used[x] += times
        assert used == Counter(hist)


# ------------------------------------------------------------------ op 8


def test_toxicity(spark, empty):
    r = random.Random(1)
    bad = ["vilka", "vilkon", "grumot", "grumas", "stinkle"]
    rows, labels = [], []
    for i in range(360):
        own = [r.choice(WORDS) for _ in range(r.randint(20, 90))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(3):
                own[r.randrange(len(own))] = r.choice(bad)
        rows.append((i, " ".join(own), "en", "s", 0))
        labels.append((i, 0, int(toxic)))
    rows += [(1000, None, None, None, None), (1001, "", "", "", 0), (1002, "... !!", "", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, lab)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = {r["doc_id"] for r in docs.where(toxicity.held_out(F.col("doc_id"))).collect()}
    right = [(got[i] >= 0.5) == bool(t) for i, _, t in labels if i in held]
    assert len(right) > 30 and np.mean(right) >= 0.9
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]
    assert toxicity.fit(docs, lab.where("toxic = 0")) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_gradient():
    p = {k: v.astype(np.float64) for k, v in toxicity.start().items()}
    r = np.random.default_rng(0)
    feats = toxicity.Features(["ab cd ef gh", "xy zw " * 30])
    p["word"][feats.word] = r.standard_normal((len(feats.word), toxicity.EMBED)) * 0.3
    at, _ = feats.windows()
    x = feats.inputs(p)
    y = np.arange(len(at)) % 2

    def loss():
        q = toxicity.forward(p, toxicity.gates_of(p, feats.inputs(p)).astype(np.float64), at)
        return -(y * np.log(toxicity.sigmoid(q)) + (1 - y) * np.log(1 - toxicity.sigmoid(q))).sum()

    logit, held = toxicity.forward(p, toxicity.gates_of(p, x), at, True)
    g = toxicity.backward(p, feats, x, at, held, toxicity.sigmoid(logit) - y)
    for name, place in (("out", (1,)), ("att", (2, 1)), ("rec", (1, 3, 20)), ("in", (0, 4, 9)), ("att_v", (3,))):
        step = 1e-2
        p[name][place] += step
        up = loss()
        p[name][place] -= 2 * step
        down = loss()
        p[name][place] += step
        assert g[name][place] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-3)


# ------------------------------------------------------------------ op 9


def slow_fingerprint(t):
    own = [w for w in re.split(rb"[\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) if w]
    runs = [b" ".join(own[i : i + 3]) for i in range(len(own) - 2)] if len(own) >= 3 else [b" ".join(own)] if own else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_golay_code():
    table, _ = simhash.golay()
    assert (table[:, 0] >= 0).all() and sorted(Counter((table >= 0).sum(1).tolist()).items()) == [(1, 277), (6, 1771)]
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 23, 500)
    near = simhash.codewords(x)
    for b in range(23):
        other = simhash.codewords(x ^ 1 << b)
        assert all(set(a[a >= 0]) & set(c[c >= 0]) for a, c in zip(near, other))


def test_keys_meet_at_two_bits():
    r = np.random.default_rng(2)
    for _ in range(300):
        a = int(r.integers(0, 1 << 63))
        b = a ^ (1 << int(r.integers(64))) ^ (1 << int(r.integers(64)))
        who, key = simhash.keys(np.array([a, b], np.uint64))
        assert set(key[who == 0]) & set(key[who == 1])


def test_simhash_groups(spark, docs, empty):
    texts = [prose(200, 70)] + [prose(199, 70) + " " + w for w in ("a", "b", "c", "d")] + [prose(50, 80 + i) for i in range(20)]
    df = docs.drop("extra").unionByName(spark.createDataFrame([(2000 + i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA))
    rows = df.collect()
    fp = [slow_fingerprint(r["text"]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2 or (rows[i]["doc_id"] is not None and rows[i]["doc_id"] == rows[j]["doc_id"]):
                parent[find(i)] = find(j)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            low[find(i)].append(r["doc_id"])
    want = Counter((r["doc_id"], fp[i], min(low[find(i)], default=None)) for i, r in enumerate(rows))
    got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_groups(df).collect())
    assert got == want
    assert simhash.near_groups(empty).count() == 0


def test_drop_copies(spark, empty):
    base = prose(400, 90).split()
    near = list(base)
    near[100] = "other"
    far = base[:200] + prose(200, 91).split()
    rows = [(4, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (9, " ".join(far)), (7, None), (8, ""), (None, "x")]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
    assert sorted((r["doc_id"] for r in simhash.drop_copies(df).collect()), key=str) == sorted([2, 7, 9, None], key=str)
    assert simhash.drop_copies(empty).count() == 0


# ------------------------------------------------------------------ op 10


def test_order_minhash(spark, docs, empty):
    df = docs.drop("extra").unionByName(spark.createDataFrame([(700 + i, prose(n, 200 + i), None, None, 0) for i, n in enumerate((1, 2, 3, 4, 30, 400))], SCHEMA))
    got = omh.fingerprints(df).collect()
    rows = sorted({((r["doc_id"] is not None, r["doc_id"] or 0), r["doc_id"], r["text"] or "") for r in df.collect()}, key=lambda x: x[0])
    assert len(got) == len({(r[1], r[2]) for r in rows})
    ids = [r[1] for r in rows]
    for i, (_, d, t) in enumerate(rows):
        if ids.count(d) > 1 or ids.count(ids[(i + 1) % len(rows)]) > 1:
            continue
        r = next(g for g in got if g["doc_id"] == d)
        after = rows[(i + 1) % len(rows)][2]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        told = [slow_omh(x) for x in (t, edited, after)]
        assert [r["fingerprint"], r["edited_fingerprint"]] == told[:2]
        cells = [[x[k : k + 8] for k in range(0, 256, 8)] for x in told]
        likeness = lambda x, y: sum(a == b != "-" * 8 for a, b in zip(x, y)) / 32 if set(x) | set(y) != {"-" * 8} else 1.0
        assert (r["near_edited"], r["near_next"]) == (likeness(*cells[:2]), likeness(cells[0], cells[2]))
    by = {g["doc_id"]: g for g in got}
    assert by[15]["fingerprint"] == by[18]["fingerprint"] == "-" * 256
    assert by[705]["near_edited"] > 0.2 > by[705]["near_next"]
    assert omh.fingerprints(empty).count() == 0


def slow_kmers(text):
    """(k-mer, occurrence, place) of each k-mer."""
    own = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    runs = [tuple(own[i : i + 3]) for i in range(len(own) - 2)] if len(own) >= 3 else [tuple(own)] if own else []
    seen = Counter()
    out = []
    for at, x in enumerate(runs):
        seen[x] += 1
        out.append((x, seen[x], at))
    return out


def xx(*values, seed=42):
    """Hash of columns: strings by their UTF-8, numbers as eight bytes, each seeded with the hash before."""
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v % (1 << 64)).to_bytes(8, "little"), seed)
    return seed


def slow_omh(text):
    """An Order MinHash fingerprint, k-mer by k-mer."""
    bins = {}
    for x, n, at in slow_kmers(text):
        v = xx(xx(*x), n)
        signed = v - (1 << 64) * (v >> 63)
        bins[v % 64] = min(bins.get(v % 64, (1 << 64, 0)), (signed >> 31, at))
    out = ""
    for j in range(1, 33):
        picked = []
        for hashed, at in bins.values():
            # the function's number is a 32-bit one
            mixed = xxhash.xxh64_intdigest(j.to_bytes(4, "little"), xx(hashed))
            picked.append(((mixed - (1 << 64) * (mixed >> 63)) >> 31, at))
        least = [h for at, h in sorted((at, h) for h, at in sorted(picked)[:2])]
        out += f"{xx(*least) & 0xFFFFFFFF:08x}" if least else "-" * 8
    return out


def test_edited_text_has_its_own_fingerprint(spark):
    """The edited text's fingerprint, made from shared k-mers, equals that of the same text given as a document."""
    a, b = prose(90, 300) + "  " + prose(30, 300), prose(70, 301)
    cut = len(a) // 4
    edited = a[: len(a) - cut] + b[:cut]
    df = spark.createDataFrame([(1, a), (2, b), (3, edited)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in omh.fingerprints(df).collect()}
    assert got[1]["edited_fingerprint"] == got[3]["fingerprint"]
    x, y = slow_kmers(a), slow_kmers(edited)
    same = len({p[:2] for p in x} & {p[:2] for p in y}) / len({p[:2] for p in x} | {p[:2] for p in y})
    assert got[1]["near_edited"] <= same + 0.2


# ------------------------------------------------------------------ shared helpers


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_ranks_are_gapless(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"), "id")
    rows = common.ranked(df, ["g"], [F.col("v"), F.col("id")]).collect()
    for g in range(3):
        own = sorted((r["v"], r["id"], r["rank"]) for r in rows if r["g"] == g)
        assert [x[2] for x in own] == list(range(len(own)))


def test_near_copies_with_cut_and_added_passages(spark):
    r = random.Random(11)
    texts = []
    for k in range(60):
        own = prose(r.randint(60, 400), 900 + k).split()
        n = len(own)
        cut = r.choice((0.1, 0.15, 0.18, 0.22))
        texts += [own, own[int(cut * n) :], own + prose(int(cut * n), 2000 + k).split()]
    texts = [" ".join(x) for x in texts] + ["", " "]
    sets = [set(simhash.shingles(simhash.words(t), 5)) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    want = {i: root(i) for i in range(len(texts)) if sum(root(j) == root(i) for j in range(len(texts))) > 1}
    got = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == want
