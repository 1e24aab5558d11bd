"""Tolerance matching between consecutive scans, one-to-one assignment, tracks, two-dimensional feature matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import ensure_checkpoint_dir


#: Weights of nearness, overlap, intensity and point count in the score of a candidate.
WEIGHTS = (0.5, 0.2, 0.2, 0.1)


def neighbours(items: DataFrame, tol_ppm: float, scan: str = "scan_idx", mz: str = "mz", idx: str = "idx", by: list[str] | None = None) -> DataFrame:
    """Candidates between each item and the nearest items of the scan before, on either side in sorted order.

    Both scans of a pair are laid in one order: the nearest lower previous item is the last one seen on the way up, the
    nearest at or above the last one seen on the way down (an equal m/z belongs to the right).  Both windows grow by a
    row at a time, so a pair costs as much as it has items; one exchange, no range join."""
    by = by or []
    prev = items.select(*by, (F.col(scan) + 1).alias("pair"), F.col(mz).alias("m"), F.col(idx).alias("i"), F.lit(1).alias("side"))
    curr = items.select(*by, F.col(scan).alias("pair"), F.col(mz).alias("m"), F.col(idx).alias("i"), F.lit(0).alias("side"))
    w = Window.partitionBy(*by, "pair").orderBy("m", "side", "i")
    own = F.when(F.col("side") == 1, F.struct(F.col("m").alias("m"), F.col("i").alias("i")))
    below = F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    down = Window.partitionBy(*by, "pair").orderBy(F.desc("m"), F.desc("side"), F.desc("i"))
    above = F.last(own, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    near = prev.unionByName(curr).withColumn("near", F.array(below, above)).where("side = 0")
    each = near.select(*by, "pair", F.col("i").alias("curr"), F.col("m").alias("curr_mz"), F.explode("near").alias("p")).where("p is not null")
    ppm = F.abs(F.col("curr_mz") - F.col("p.m")) / F.col("p.m") * 1e6
    return each.select(*by, "pair", F.col("p.i").alias("prev"), "curr", F.col("p.m").alias("prev_mz"), "curr_mz", ppm.alias("ppm")).where(F.col("ppm") < tol_ppm)


def greedy(candidates: DataFrame, key: list[str], left: str, right: str, order: list[str]) -> DataFrame:
    """One-to-one pairs taken in ascending ``order`` within each group of ``key``, which one task holds."""
    schema = candidates.schema

    def take(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        a, b = set(), set()
        keep = []
        for x, y in zip(group[left], group[right]):
            good = x not in a and y not in b
            keep.append(good)
            if good:
                a.add(x)
                b.add(y)
        return group[keep]

    return candidates.groupBy(*key).applyInPandas(take, schema)


def mutual_best(candidates: DataFrame, key: list[str], left: str, right: str, order: list[Column], rounds: int = 8) -> DataFrame:
    """The same pairs as taking them in ``order`` one by one, relationally: pairs that are first for both their sides, again
    and again.  Each round writes what remains, so neither the plan nor the lineage grows, and windows are over one
    item's candidates.

    A chain of candidates that each yield to the next takes a round a pair; chains that outlast ``rounds`` are finished
    one by one, each connected group of candidates on its own."""
    ensure_checkpoint_dir(candidates.sparkSession)
    open_, done = candidates, []
    for _ in range(rounds):
        l, r = Window.partitionBy(*key, left).orderBy(*order), Window.partitionBy(*key, right).orderBy(*order)
        marked = open_.withColumn("_l", F.row_number().over(l)).withColumn("_r", F.row_number().over(r)).checkpoint()
        best = marked.where("_l = 1 and _r = 1")
        if best.isEmpty():
            break
        done.append(best.drop("_l", "_r"))
        open_ = marked.drop("_l", "_r").join(best.select(*key, left), [*key, left], "left_anti").join(best.select(*key, right), [*key, right], "left_anti")
    else:
        done.append(one_by_one(open_.checkpoint(), key, left, right, order))
    out = done[0] if done else open_
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def one_by_one(candidates: DataFrame, key: list[str], left: str, right: str, order: list[Column]) -> DataFrame:
    """The pairs in ``order`` within each connected group of candidates; groups are labelled by passing the least label
    on, and a group is as large as the chain it holds."""
    label = F.xxhash64(*key, left)
    now = candidates.withColumn("_group", label).withColumn("_at", F.row_number().over(Window.partitionBy(*key, left).orderBy(*order)))
    while True:
        a = F.min("_group").over(Window.partitionBy(*key, left))
        b = F.min("_group").over(Window.partitionBy(*key, right))
        nxt = now.withColumn("_new", F.least(a, b)).checkpoint()
        settled = nxt.where("_new <> _group").isEmpty()
        now = nxt.withColumn("_group", F.col("_new")).drop("_new")
        if settled:
            break
    ranked = now.withColumn("_at", F.row_number().over(Window.partitionBy(*key, "_group").orderBy(*order)))
    return greedy(ranked, [*key, "_group"], left, right, ["_at"]).drop("_group", "_at")


def tracks(items: DataFrame, matches: DataFrame, scan: str = "scan_idx", idx: str = "idx") -> DataFrame:
    """Items with ``track_start`` (the first item of their chain) and position in it.

    Matches join consecutive scans and are one-to-one, so chains are simple paths: labels are found by pointer jumping,
    in a number of rounds logarithmic in the longest chain, each over slim rows."""
    edges = matches.select(F.col("curr").alias("node"), F.col("prev").alias("up"))
    state = items.select(F.col(idx).alias("node")).join(edges, "node", "left").select("node", F.coalesce("up", "node").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("steps")).checkpoint()
    for _ in range(40):
        far = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("more"))
        nxt = state.join(far, "up").select("node", F.col("up2").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("up2") != F.col("up")).alias("moved")).checkpoint()
        moved = nxt.where("moved").limit(1).count()
        state = nxt.drop("moved")
        if not moved:
            break
    return items.join(state.select(F.col("node").alias(idx), F.col("up").alias("track_start"), F.col("steps").alias("pos_in_track")), idx)


def band_join(points: DataFrame, targets: DataFrame, tol_ppm: float, mz: str = "mz", target: str = "target_mz") -> DataFrame:
    """Points within a relative tolerance of targets, both ends inclusive, as an equi-join on logarithmic buckets.

    A target posts itself to the buckets its band touches (at most three), so neither side is compared with all."""
    width = float(np.log1p(2 * tol_ppm * 1e-6))
    bucket = lambda x: F.floor(F.log(x) / F.lit(width)).cast("long")
    low, high = F.col(target) * (1 - tol_ppm * 1e-6), F.col(target) * (1 + tol_ppm * 1e-6)
    posted = targets.withColumn("_b", F.explode(F.sequence(bucket(low), bucket(high))))
    return points.withColumn("_b", bucket(F.col(mz))).join(posted, "_b").where(F.col(mz).between(low, high)).drop("_b")


def match_features(original: DataFrame, rebuilt: DataFrame, key: list[str], tol_ppm: float = 10.0, tol_rt: float = 10.0) -> DataFrame:
    """Greedy 2-D matching by descending intensity of the originals, each rebuilt feature used once.

    Candidates come from the bucketed band join; the choice among them is relational (:func:`mutual_best`)."""
    o = original.select(*key, F.col("feature_idx").alias("o_idx"), F.col("mz").alias("o_mz"), F.col("rt").alias("o_rt"), F.col("intensity").alias("o_int"))
    r = rebuilt.select(*(F.col(k).alias(f"r_{k}") for k in key), F.col("feature_idx").alias("r_idx"), F.col("mz").alias("r_mz"), F.col("rt").alias("r_rt"))
    near = band_join(r, o, tol_ppm, "r_mz", "o_mz")
    for k in key:
        near = near.where(F.col(k) == F.col(f"r_{k}"))
    near = near.where(F.abs(F.col("o_rt") - F.col("r_rt")) <= tol_rt)
    ppm = F.abs(F.col("r_mz") - F.col("o_mz")) / F.col("o_mz") * 1e6
    near = near.withColumn("score", F.pow(ppm / tol_ppm, F.lit(2)) + F.pow((F.col("r_rt") - F.col("o_rt")) / tol_rt, F.lit(2))).select(*key, "o_idx", "r_idx", "o_mz", "o_int", "r_mz", "score")

    order = [F.desc("o_int"), *(F.asc(c) for c in ("o_mz", "o_idx", "score", "r_mz", "r_idx"))]
    return mutual_best(near, key, "o_idx", "r_idx", order)


def wide_candidates(islands: DataFrame, tol_ppm: float, least: float = 0.3, by: list[str] | None = None) -> DataFrame:
    """Scored candidates among the five nearest islands of the scan before (two below, the one at or above, two more).

    ``islands`` has scan_idx, idx, center_mz, mz_low, mz_high, max_intensity, n_points.  The score weighs nearness of
    the centres, overlap of the ranges, likeness of intensities in doublings and equality of point counts by ``WEIGHTS``.
    Assign one to one with :func:`mutual_best` in descending score."""
    by = by or []
    fields = ["idx", "center_mz", "mz_low", "mz_high", "max_intensity", "n_points"]
    item = F.struct(*(F.col(c) for c in fields))
    prev = islands.select(*by, (F.col("scan_idx") + 1).alias("pair"), F.col("center_mz").alias("m"), F.lit(1).alias("side"), item.alias("x"))
    curr = islands.select(*by, F.col("scan_idx").alias("pair"), F.col("center_mz").alias("m"), F.lit(0).alias("side"), item.alias("x"))
    # previous islands number themselves; a current one looks up the numbers around its place
    place = F.sum("side").over(Window.partitionBy(*by, "pair").orderBy("m", "side", "x.idx").rowsBetween(Window.unboundedPreceding, 0))
    laid = prev.unionByName(curr).withColumn("p", place)
    a = laid.where("side = 0").select(*by, "pair", F.col("x").alias("c"), F.explode(F.sequence(F.col("p") - 1, F.col("p") + 3)).alias("p"))
    b = laid.where("side = 1").select(*by, "pair", "p", F.col("x").alias("q"))
    ppm = F.abs(F.col("c.center_mz") - F.col("q.center_mz")) / F.col("q.center_mz") * 1e6
    met = a.join(b, [*by, "pair", "p"]).withColumn("ppm", ppm).where(F.col("ppm") < tol_ppm)
    low, high = F.greatest("c.mz_low", "q.mz_low"), F.least("c.mz_high", "q.mz_high")
    span = F.greatest("c.mz_high", "q.mz_high") - F.least("c.mz_low", "q.mz_low")
    overlap = F.when(high > low, (high - low) / span).otherwise(0.0)
    both = (F.col("c.max_intensity") > 0) & (F.col("q.max_intensity") > 0)
    doublings = F.abs(F.log2(F.col("c.max_intensity") / F.col("q.max_intensity")))
    alike = F.when(both, F.greatest(F.lit(0.0), 1 - doublings / 5)).otherwise(0.5)
    same = F.when(F.col("c.n_points") == F.col("q.n_points"), 1.0).otherwise(0.5)
    score = sum(w * part for w, part in zip(WEIGHTS, (1 - F.col("ppm") / tol_ppm, overlap, alike, same)))
    return met.select(*by, "pair", F.col("q.idx").alias("prev"), F.col("c.idx").alias("curr"), "ppm", score.alias("score")).where(F.col("score") >= least)


def match_quality(n_original: Column, n_rebuilt: Column, n_matched: Column) -> list[Column]:
    p = F.when(n_rebuilt > 0, n_matched / n_rebuilt)
    r = F.when(n_original > 0, n_matched / n_original)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).alias("f1")]
