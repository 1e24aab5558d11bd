import itertools
import math
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanforge.functions import numeric, stats
from scanforge.operators import codec, compare, encode, islands, matching, ranks, tables
from scanforge.plans import catalog, sections  # noqa: F401
from scanforge.sources.shared import ensure_checkpoint_dir
from scanforge.sources.views import Views


def points(spark, scans):
    rows = [(s, p, 100.0 + 0.1 * p, float(i)) for s, values in scans.items() for p, i in enumerate(values)]
    return spark.createDataFrame(rows, "scan_idx long, pos int, mz double, intensity double")


def spans(df):
    return sorted((r["scan_idx"], r["array_start"], r["n_points"]) for r in df.collect())


def test_islands_at_edges_and_gaps(spark):
    p = points(spark, {0: [1, 1, 0, 2], 1: [0, 0, 0], 2: [5], 3: [1, 0, 0, 1]})
    assert spans(islands.islands_positive(p)) == [(0, 0, 2), (0, 3, 1), (2, 0, 1), (3, 0, 1), (3, 3, 1)]


def test_strategy_threshold(spark):
    p = points(spark, {0: [1, 1, 1, 1, 0], 1: [1, 1, 1, 0], 2: [1, 0]})
    assert {r["scan_idx"]: r["strategy"] for r in islands.zero_share(p).collect()} == {0: "B", 1: "A", 2: "A"}


def test_valley_opens_right_segment(spark):
    p = points(spark, {0: [10, 900, 800, 700, 0.5, 600, 900, 10]})
    assert spans(islands.islands_valley(p)) == [(0, 0, 4), (0, 4, 4)]
    shallow = points(spark, {0: [10, 900, 800, 700, 90, 600, 900, 10]})
    assert spans(islands.islands_valley(shallow)) == [(0, 0, 8)]


def test_complement_and_merge(spark):
    p = points(spark, {0: [0, 1, 1, 0, 0, 1]})
    sizes = spark.createDataFrame([(0, 6)], "scan_idx long, n long")
    gaps = islands.complement(islands.islands_positive(p), sizes).collect()
    assert sorted((g["gap_start"], g["gap_points"]) for g in gaps) == [(0, 1), (3, 2)]
    over = spark.createDataFrame([(0, 0, 3), (0, 2, 3)], "scan_idx long, array_start long, n_points long")
    with pytest.raises(Exception, match="overlap"):
        islands.merge_adjacent(over).collect()


def test_neighbours_left_insert_and_strict(spark):
    rows = [(0, 1, 100.0), (0, 2, 100.01), (1, 3, 100.0), (1, 4, 100.01)]
    items = spark.createDataFrame(rows, "scan_idx long, idx long, mz double")
    got = {(r["prev"], r["curr"]) for r in matching.neighbours(items, 1e6).collect()}
    assert got == {(1, 3), (2, 4), (1, 4)}
    assert {(r["prev"], r["curr"]) for r in matching.neighbours(items, 1e-9).collect()} == {(1, 3), (2, 4)}


def test_greedy_equals_mutual_best(spark):
    ensure_checkpoint_dir(spark)
    r = random.Random(5)
    rows = sorted({(r.randrange(3), r.randrange(8), r.randrange(8), float(r.randrange(4))) for _ in range(90)})
    rows = list({x[:3]: x for x in rows}.values())
    c = spark.createDataFrame(rows, "pair long, prev long, curr long, ppm double")
    order = ["ppm", "prev", "curr"]
    a = {tuple(x) for x in matching.greedy(c, ["pair"], "prev", "curr", order).collect()}
    b = {tuple(x) for x in matching.mutual_best(c, ["pair"], "prev", "curr", order).collect()}
    assert a == b


def test_tracks_break_at_empty_scan(spark):
    ensure_checkpoint_dir(spark)
    items = spark.createDataFrame([(0, 10, 100.0), (1, 11, 100.0), (3, 12, 100.0), (4, 13, 100.0), (5, 14, 100.0)], "scan_idx long, idx long, mz double")
    near = matching.neighbours(items, 5.0)
    found = matching.tracks(items, matching.greedy(near, ["pair"], "prev", "curr", ["ppm", "prev", "curr"]))
    assert {(r["idx"], r["track_start"], r["pos_in_track"]) for r in found.collect()} == {(10, 10, 0), (11, 10, 1), (12, 12, 0), (13, 12, 1), (14, 12, 2)}


def test_band_join_is_complete(spark):
    r = random.Random(2)
    p = spark.createDataFrame([(i, 400 + r.random() * 2) for i in range(400)], "id long, mz double")
    t = spark.createDataFrame([(i, 400 + r.random() * 2) for i in range(40)], "rank long, target_mz double")
    tol = 500.0
    got = {(x["id"], x["rank"]) for x in matching.band_join(p, t, tol).collect()}
    want = {(a["id"], b["rank"]) for a in p.collect() for b in t.collect() if b["target_mz"] * (1 - tol * 1e-6) <= a["mz"] <= b["target_mz"] * (1 + tol * 1e-6)}
    assert got == want


def test_match_features_uses_each_once(spark):
    o = spark.createDataFrame([(1, 500.0, 10.0, 5.0), (2, 500.0001, 10.0, 9.0)], "feature_idx long, mz double, rt double, intensity double")
    n = spark.createDataFrame([(7, 500.0001, 10.0, 1.0)], "feature_idx long, mz double, rt double, intensity double")
    got = matching.match_features(o, n, []).collect()
    assert [(x["o_idx"], x["r_idx"]) for x in got] == [(2, 7)]


def test_log_code_overflow(spark):
    df = spark.createDataFrame([(1.5,), (2147483647.0,), (3e9,)], "x double").select(numeric.log_code(F.col("x"), F.lit(1)).alias("c"))
    codes = [r["c"] for r in df.collect()]
    assert codes[0] == 2 and codes[1] == 2147483647 and codes[2] == -round(math.log2(3e9) * 1e5)


def test_zigzag_inverse_and_widths(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, -1, 5, -7, 1 << 40, -(1 << 40))], "x long")
    back = df.select("x", numeric.unzigzag(numeric.zigzag(F.col("x"))).alias("y"), numeric.bit_width(F.abs("x")).alias("w")).collect()
    assert all(r["x"] == r["y"] for r in back)
    assert [r["w"] for r in back] == [abs(r["x"]).bit_length() for r in back]


def test_zero_runs(spark):
    values = [0, 0, 0, 0, 3, 0, 0, 0, 7]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "s long, pos long, v long")
    got = [tuple(r["codes"]) for r in encode.zero_runs(df, "v", ["s"], "pos").orderBy("pos").collect()]
    assert got == [(0, 4), (4,), (1,), (1,), (1,), (8,)]


def test_reference_decode(spark):
    rows = [("f", 0, None, [5, 6, 7]), ("f", 1, 0, [1, 1]), ("f", 2, 1, [0, 0, 9])]
    df = spark.createDataFrame(rows, "file_id string, island_idx long, ref_idx long, delta array<long>")
    got = {r["island_idx"]: list(r["codes"]) for r in encode.decode_references(df).collect()}
    assert got == {0: [5, 6, 7], 1: [6, 7], 2: [6, 7, 9]}


def test_anchors_beyond_32_bits(spark):
    df = spark.createDataFrame([(0, 2817383290), (0, 7112350586), (0, 10000000000)], "w long, mz_q long")
    r = encode.offset_anchors(df, ["w"]).first()
    assert (r["anchor"], r["max_delta"], r["beyond_u32"]) == (2817383290, 4294967296, True)


@pytest.mark.parametrize("change, counter", [("short", "length_mismatch"), ("zero", "nonzero_mismatch"), ("drop", "missing_rebuilt")])
def test_rollup_counters(spark, change, counter):
    base = [(0, i, [1.0, 2.0, 3.0], [1.0, 0.0, 4.0]) for i in range(3)]
    other = list(base)
    if change == "short":
        other[2] = (0, 2, [1.0, 2.0], [1.0, 0.0])
    elif change == "zero":
        other[2] = (0, 2, [1.0, 2.0, 3.0], [1.0, 0.01, 4.0])
    else:
        other.pop()
    schema = "f long, i long, mz array<double>, intensity array<double>"
    pairs = compare.align(spark.createDataFrame(base, schema), spark.createDataFrame(other, schema), ["f"], "i")
    out = compare.rollup(pairs, compare.spectrum_errors(pairs), ["f"])
    row = out.first()
    assert row["spectrum_count"] == 3 and row[counter] == 1
    assert not compare.verdict(out, F.lit(False), F.lit(True)).first()["passed"]


def test_rank_tests():
    assert stats.exact_signed_rank_p([1, 2, 3, 4, 5], 0) == pytest.approx(2 / 32)
    assert stats.incomplete_beta(2.0, 0.5, 0.3) == pytest.approx(0.0378, abs=2e-3)


@pytest.mark.parametrize("d", [[3, -1, 2, 2, -2, 5, 4], [1, 1, 1, -1], [-2.5], [1, 2, 3, 4, 5, -6, 7, -8, 9, 10]])
def test_exact_signed_rank_is_brute_force(d):
    size = [abs(x) for x in d]
    ranks = [sum(y < x for y in size) + (size.count(x) + 1) / 2 for x in size]
    w = min(sum(r for r, x in zip(ranks, d) if x > 0), sum(r for r, x in zip(ranks, d) if x < 0))
    signs = itertools.product((0, 1), repeat=len(d))
    tail = sum(min(s, sum(ranks) - s) <= w for s in (sum(r for r, k in zip(ranks, z) if k) for z in signs))
    assert stats.exact_signed_rank_p(ranks, w) == pytest.approx(min(1, tail / 2 ** len(d)))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_exact_wilcoxon_takes_every_pair(spark):
    run = lambda name: catalog.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    exact = run("o_m4_exact_wilcoxon")
    assert exact.n.sum() == run("o_m3_wilcoxon_w").n[0] and exact.n.max() <= 30


def test_latest_and_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert {tuple(r) for r in tables.upsert(old, new, ["id"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_codecs_round_trip(spark):
    df = spark.createDataFrame([(bytearray(b"abc" * 50),), (bytearray(b""),)], "b binary")
    for name in encode.codecs():
        got = df.select("b", encode.decompress(encode.compress(F.col("b"), name), name).alias("c")).collect()
        assert all(bytes(r["b"]) == bytes(r["c"]) for r in got)
    assert set(encode.codec_benchmark(df, "b").toPandas()["codec"]) == set(encode.codecs())


def test_array_percentile_matches_numpy(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 10.0],), ([],)], "x array<double>").select(compare.array_percentile(F.col("x"), 0.95).alias("p"))
    assert [r["p"] for r in df.collect()] == [pytest.approx(8.95), 0.0]


def test_empty_tables(spark):
    p = points(spark, {0: [1]}).where("false")
    assert islands.islands_positive(p).count() == 0 and islands.islands_valley(p).count() == 0
    assert matching.neighbours(spark.createDataFrame([], "scan_idx long, idx long, mz double"), 5.0).count() == 0
    assert isinstance(islands.zero_share(p).toPandas(), pd.DataFrame)


def slow_assignment(items, tol):
    """(pair, prev, curr) by trying candidates in ascending order, scan pair by scan pair."""
    by = {}
    for scan, idx, mz in items:
        by.setdefault(scan, []).append((mz, idx))
    out = []
    for scan, own in by.items():
        before = sorted(by.get(scan - 1, []))
        found = []
        for mz, idx in own:
            low = [p for p in before if p[0] < mz][-1:]
            high = [p for p in before if p[0] >= mz][:1]
            found += [(abs(mz - p[0]) / p[0] * 1e6, p[1], idx) for p in low + high if abs(mz - p[0]) / p[0] * 1e6 < tol]
        a, b = set(), set()
        for _, x, y in sorted(found):
            if x not in a and y not in b:
                a.add(x)
                b.add(y)
                out.append((scan, x, y))
    return sorted(out)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_assignment_and_tracks_of_the_queries(spark):
    """The queries' results against one-by-one assignment and chain following."""
    v = Views(spark, "/root/testdata/sf0.001")
    items = [(r["scan_idx"], r["idx"], r["mz"]) for r in v.centroid.collect()]
    want = slow_assignment(items, catalog.TOL)
    got = sorted((r["pair"], r["prev"], r["curr"]) for r in catalog.QUERIES["o_j16_greedy_match"](spark, v.folder).collect())
    assert got == want
    up = {c: p for _, p, c in want}
    length = {}
    for _, i, _ in items:
        start = i
        while start in up:
            start = up[start]
        length[start] = length.get(start, 0) + 1
    assert {r["track_start"]: r["length"] for r in catalog.QUERIES["o_w6_tracks"](spark, v.folder).collect()} == length


@pytest.mark.parametrize("rounds", [1, 8])
def test_mutual_best_equals_one_by_one(spark, rounds):
    import random

    r = random.Random(3)
    items = [(s, s * 1000 + i, round(100 + r.random() * 0.05, 6)) for s in range(4) for i in range(40)]
    df = spark.createDataFrame(items, "scan_idx long, idx long, mz double")
    near = matching.neighbours(df, 50.0)
    got = matching.mutual_best(near, ["pair"], "prev", "curr", [F.col(c) for c in ("ppm", "prev", "curr")], rounds)
    assert sorted((x["pair"], x["prev"], x["curr"]) for x in got.collect()) == slow_assignment(items, 50.0)


def test_numbers_and_running_sums_over_ranges(spark):
    import random

    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", None]), i, r.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i long, n long").repartition(5)
    got = {(x["g"], x["i"]): (x["place"], x["n_before"]) for x in ranks.numbered(df, [F.col("i")], ["g"], total="n").collect()}
    for g in ("a", None):
        own = sorted((i, n) for k, i, n in rows if k == g)
        for k, (i, _) in enumerate(own):
            assert got[(g, i)] == (k, sum(n for _, n in own[:k]))


def test_codec_streams(spark):
    df = spark.createDataFrame([([5, 7, 1 << 40], [2, 0, 1]), ([], []), ([-3], [1])], "x array<bigint>, n array<int>")
    both = df.select("x", codec.unpack_longs(codec.pack_longs(F.col("x"), True), True).alias("y"), codec.cut(F.col("x"), F.col("n")).alias("c")).collect()
    assert all(r["x"] == r["y"] for r in both) and both[0]["c"] == [[5, 7], [], [1 << 40]] and both[1]["c"] == []
    sizes = spark.createDataFrame([(7, [8, 9], [0.0, 0.0], [1.0, 1.0]), (7, [], [], []), (7, [8], [0.5], [])], "a long, b array<bigint>, s array<double>, r array<double>")
    got = [r["n"] for r in sizes.select(codec.member_bytes(F.col("a"), F.col("b"), F.col("s"), F.col("r")).alias("n")).collect()]
    assert got[1] < got[0] and got[2] > 1


def test_wide_candidates_look_at_five_neighbours(spark):
    prev = [(0, i, 100 + 0.001 * i) for i in range(6)]
    df = spark.createDataFrame(prev + [(1, 10, 100.0025)], "scan_idx long, idx long, m double")
    items = df.select("scan_idx", "idx", F.col("m").alias("center_mz"), (F.col("m") - 0.01).alias("mz_low"), (F.col("m") + 0.01).alias("mz_high"), F.lit(5.0).alias("max_intensity"), F.lit(3).alias("n_points"))
    got = {r["prev"]: r["score"] for r in matching.wide_candidates(items, 100.0).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and max(got, key=got.get) in (2, 3)
