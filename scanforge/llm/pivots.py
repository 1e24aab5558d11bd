"""Op 5 - embedding near-dedup by a pivot-permutation index.

A bounded sample of vectors serves as reference points (pivots), thinned so that no two lie close together: a dense
group of vectors then has one pivot that all its members put first, and not a crowd of them in chance order.  Each
vector is described by its ``depth`` nearest pivots in order, and posted into the inverted list of each of the first
``probes`` of them.  Vectors that share a list are candidates if their descriptions share at least ``shared`` pivots, and
candidates are verified by cosine in double precision.  Every vector is indexed; only the pivots are sampled (bound:
``pivots`` a label and length).

Vectors equal in direction bit for bit are collapsed before they are indexed and count with their multiplicity, so a
very common vector is one row.  Pivots travel once to each portion of ``PORTION`` vectors of a label.  Lists are scanned
in numpy blocks: shared-pivot counts of a block pair are one sparse product.  A pair is counted in the first list that
both its vectors are posted in and nowhere else; what leaves a task is a row for each linked vector, with the number of
its links and the task's component it belongs to, never the pairs.  Lists longer than ``cell`` are cut into cells, and
each pair of cells of a list is a task of its own, so a hot list spreads over many tasks.

Links are compared only within equal labels that are not null, and between vectors of one length (others have no
cosine).  Defined results: a vector that is null, empty, zero or holds null or non-finite components links with nothing,
so does one with a null label; rows that repeat a vec_id are vectors of their own for the links and share one component
name; an empty table gives an empty result.  Only vec_id, label and embedding are read, so no name clashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, pin

PIVOTS, APART, DEPTH, PROBES, SHARED, CELL = 256, 0.8, 16, 4, 4, 2000
#: Vectors that are described together, with one copy of their label's pivots.
PORTION = 10_000


def usable(embedding) -> F.Column:
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def unit(rows: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def thinned(pivots: np.ndarray, apart: float = APART) -> np.ndarray:
    """Pivots of which no two have a cosine of ``apart`` or more, earlier ones first."""
    kept: list[int] = []
    for i in range(len(pivots)):
        if not kept or (pivots[kept] @ pivots[i]).max() < apart:
            kept.append(i)
    return pivots[kept]


def nearest(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` nearest pivots of each vector, nearest first."""
    near = x @ pivots.T
    depth = min(depth, near.shape[1])
    some = np.argpartition(-near, depth - 1, axis=1)[:, :depth]
    order = np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1)


def links_of(a: np.ndarray, pa_: np.ndarray, b: np.ndarray, pb: np.ndarray, least: float, shared: int, pivots: int, probes: int, here: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in two cells of list ``here``, the first common list, whose descriptions share ``shared`` pivots and whose
    cosine reaches ``least``; in portions."""

    def marks(p: np.ndarray) -> np.ndarray:
        m = np.zeros((len(p), pivots), np.float32)
        np.put_along_axis(m, p, 1.0, 1)
        return m

    need = min(shared, pa_.shape[1])
    mb = marks(pb).T
    for top in range(0, len(pa_), 256):
        i, j = np.nonzero(marks(pa_[top : top + 256]) @ mb >= need)
        for low in range(0, len(i), 200_000):
            x, y = i[low : low + 200_000] + top, j[low : low + 200_000]
            good = np.einsum("nd,nd->n", a[x], b[y]) >= least
            x, y = x[good], y[good]
            first = np.full(len(x), pivots)
            for u in range(min(probes, pa_.shape[1])):
                for v in range(min(probes, pb.shape[1])):
                    first = np.where(pa_[x, u] == pb[y, v], np.minimum(first, pa_[x, u]), first)
            yield x[first == here], y[first == here]


def joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``root`` (the smallest member of each one's group) after the groups of x and y were joined."""
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low < high
        if not apart.any():
            return root
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]


def near_vectors(table: DataFrame, least: float = 0.98, pivots: int = PIVOTS, depth: int = DEPTH, probes: int = PROBES, shared: int = SHARED, cell: int = CELL) -> DataFrame:
    """Per row: vec_id, n_links, component_id (smallest vec_id reachable) and kept (vec_id = component_id)."""
    spark = table.sparkSession
    rows = table.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    size = F.size("e")
    live = rows.where(usable(F.col("e")) & F.col("label").isNotNull()).withColumn("k", F.xxhash64("e", size))
    # one row for each distinct vector of a label, named by its smallest id
    held = pin(live.groupBy("label", "k", "e").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("d", size), "vectors")
    spread, group = F.xxhash64("k", F.lit(5)), ["label", "d"]
    # the pivots: the vectors of a label with the smallest hashes, their number bounded
    chosen = held.groupBy(*group, F.pmod(spread, F.lit(pivots)).alias("slot")).agg(F.min_by("e", F.struct(spread, "id")).alias("e"))
    by_label = chosen.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "e"))), lambda s: s["e"]).alias("pivots"))
    portions = pin(held.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / PORTION).cast("int").alias("portions")), "portions")
    copies = pin(by_label.join(portions, group).select(*group, F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), "pivots"), "pivots")
    dealt = held.join(portions.hint("merge"), group).withColumn("portion", F.pmod(F.xxhash64("k", F.lit(6)), F.col("portions")).cast("int"))

    def describe(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c: [] for c in (*group, "id", "k", "n", "e", "p", "list")})
        points = thinned(unit(pd.Series(list(own["pivots"].iloc[0]))))
        near = nearest(unit(rows["e"]), points, depth)
        lists = [list(p) for p in near]
        some = [rows[[*group, "id", "k", "n", "e"]].assign(p=lists, list=near[:, i]) for i in range(min(probes, near.shape[1]))]
        return pd.concat(some, ignore_index=True)

    label = table.schema["label"].dataType.simpleString()
    at = [*group, "portion"]
    posted = dealt.groupBy(*at).cogroup(copies.groupBy(*at)).applyInPandas(describe, f"label {label}, d int, id long, k long, n long, e array<double>, p array<int>, list int")
    posted = pin(posted, "lists")
    lengths = pin(posted.groupBy(*group, "list").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("cells")), "lengths")
    dealt = posted.join(lengths.hint("merge"), [*group, "list"]).withColumn("c", F.pmod(F.xxhash64("k", F.lit(9)), F.col("cells")).cast("int"))
    # cell c meets the cells from 0 to cells - 1: the pair (low, high) is one task
    pairs = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).withColumn("low", F.least("c", "o")).withColumn("high", F.greatest("c", "o"))

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        low, high, here = (part[c].iloc[0] for c in ("low", "high", "list"))
        part = part.reset_index(drop=True)
        own = [np.flatnonzero(part["c"] == x) for x in (low, high)]
        vectors, p = unit(part["e"]), np.stack(part["p"])
        k, n = part["k"].to_numpy(), part["n"].to_numpy()
        links, root = np.zeros(len(part), np.int64), np.arange(len(part))
        for i, j in links_of(vectors[own[0]], p[own[0]], vectors[own[1]], p[own[1]], least, shared, pivots, probes, here):
            i, j = own[0][i], own[1][j]
            one = k[i] < k[j] if low == high else k[i] != k[j]
            i, j = i[one], j[one]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            root = joined(root, i, j)
        linked = links > 0
        ids = part["id"].to_numpy()
        return pd.DataFrame({"id": ids[linked], "k": k[linked], "m": links[linked], "root": ids[root[linked]]})

    found = pin(pairs.groupBy(*group, "list", "low", "high").applyInPandas(scan, "id long, k long, m long, root long"), "links")
    degree = found.groupBy("id", "k").agg(F.sum("m").alias("m"))
    tree = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = held.join(degree, ["id", "k"], "left").join(tree, F.col("id") == F.col("node"), "left")
    named = named.select("label", "k", "e", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.withColumn("k", F.when(usable(F.col("e")), F.xxhash64("e", size))).alias("r").join(named.alias("s").hint("merge"), (F.col("r.label") == F.col("s.label")) & (F.col("r.k") == F.col("s.k")) & (F.col("r.e") == F.col("s.e")), "left")
    component = F.coalesce(F.col("component_id"), F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
