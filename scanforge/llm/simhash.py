"""Op 9 - SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last padded).  The perfect (23,12) Golay code
decodes a segment to the codewords within distance 4: one codeword if the nearest lies within 2, six if it lies at 3.
Two segments that differ in at most one bit always share such a codeword: the nearest one of the first is within 4 of
the second.  With two errors over three segments one segment is whole, and one of its two neighbours has at most one
error, so the keys (whole segment, codeword index of the following segment) of the three cyclic pairs miss no link.

Equal fingerprints are collapsed before keys are made, so a group of exact copies is one row, whatever its size; links
are found by an equi-join on keys with the bit count in the join condition, and components by star contraction.  Slim
tables (ids and fingerprints) are written to the shared folder; texts are read once and never shuffled.

Defined results: null and empty texts have no words and fingerprint zero; a null doc_id takes part through its
fingerprint but is never a component's name; rows that repeat a doc_id are one document for the links; an empty table
gives an empty result.  Only doc_id and the text are read, so no name clashes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, components, lean, pin, unpin

SEED = 42
#: Fixed value: generator polynomial of the binary (23,12) Golay code.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 23), (23, 23), (46, 18))
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lowered; cut at space and U+0009 to U+000D."""
    return (text or "").encode("utf-8").lower().split()


def shingles(own: list[bytes], size: int) -> list[bytes]:
    """All runs of ``size`` words, repeats included, or the whole sequence if it is shorter."""
    if len(own) <= size:
        return [b" ".join(own)] if own else []
    joined = b" ".join(own)
    stop = np.cumsum([len(w) + 1 for w in own])
    low = np.r_[0, stop[: len(own) - size]].tolist()
    return [joined[a:b] for a, b in zip(low, (stop[size - 1 :] - 1).tolist())]


def hashes(own: list[bytes], size: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles(own, size)], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    if not len(h):
        return 0
    at = h.view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(8) * 256
    ones = (np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ BITS).ravel()
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


@functools.cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error patterns of weight up to 4 in that coset, padded with -1; and the syndrome of each byte position."""
    unit = []
    for i in range(23):
        x = 1 << i
        for b in range(22, 10, -1):
            if x >> b & 1:
                x ^= GENERATOR << (b - 11)
        unit.append(x)
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            s = 0
            for i in places:
                s ^= unit[i]
            found[s].append(sum(1 << i for i in places))
    table = np.full((2048, 6), -1, np.int64)
    for s, patterns in enumerate(found):
        table[s, : len(patterns)] = patterns[:6]
    return table, np.array(unit, np.int64)


def codewords(x: np.ndarray) -> np.ndarray:
    """Indices (12 information bits) of the codewords within distance 4 of 23-bit words; -1 where there are fewer than six."""
    table, unit = golay()
    s = np.zeros(len(x), np.int64)
    for i in range(23):
        s ^= np.where(x >> i & 1, unit[i], 0)
    errors = table[s]
    return np.where(errors >= 0, (x[:, None] ^ errors) >> 11, -1)


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of unsigned 64-bit fingerprints: which fingerprint, and the key."""
    seg = [(fp >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    who, key = [], []
    for i in range(3):
        near = codewords(seg[(i + 1) % 3])
        at, col = np.nonzero(near >= 0)
        who.append(at)
        key.append(np.int64(i) << 40 | seg[i][at] << 12 | near[at, col])
    return np.concatenate(who), np.concatenate(key)


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3) -> DataFrame:
    """``docs`` without its text plus ``fp`` (the fingerprint as a signed 64-bit number)."""
    keep = [f for f in docs.schema.fields if f.name not in (text, "fp")]
    out = T.StructType([*keep, T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(hashes(words(t.as_py()), size)) for t in batch.column(text)], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(fps.view(np.int64))], names=out.names)

    return docs.mapInArrow(lean(run), out)


def fingerprint_links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """All pairs a < b of the distinct values of column ``fp`` that differ in 1 to ``bits`` (at most 2) bits."""
    if not 0 < bits <= 2:
        raise ValueError("the keys are complete up to 2 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0))
            who, key = keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[who])], names=["key", "fp"])

    keyed = fps.select("fp").mapInArrow(run, "key long, fp long")
    a, b = keyed.select("key", F.col("fp").alias("a")), keyed.select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    return a.join(b.hint("merge"), (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def near_groups(docs: DataFrame, text: str = "text", size: int = 3, bits: int = 2) -> DataFrame:
    """Per row of ``docs``: doc_id, fp and component_id, the smallest doc_id reachable over links."""
    marked = pin(fingerprints(docs.select("doc_id", text), text, size), "fingerprints")
    classes = pin(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    links = fingerprint_links(classes, bits)
    named = links.join(classes.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(classes.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select("x", "y").where("x is not null and y is not null")
    # copies of a doc_id with other texts are one document
    again = marked.join(classes, "fp").groupBy("doc_id").agg(F.min("first").alias("x"), F.max("first").alias("y")).where("x < y")
    tree = components(named.unionByName(again.select("x", "y")), "x", "y")
    of = classes.join(tree, F.col("first") == F.col("node"), "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    return marked.join(of.hint("merge"), "fp").select("doc_id", "fp", "component_id")


#: Of each of PRINTS fingerprints NEAR bits may differ in a pair that is compared ahead of the others.
PRINTS, NEAR = 6, 13
#: Bits by which sets that differ in too many members are told apart without being compared.
PARITY = 512


def word_prints(own: list[bytes]) -> list[int]:
    """PRINTS fingerprints over the distinct words; an edit touches fewer of them than of longer shingles."""
    distinct = list(set(own))
    h = np.array([[xxhash.xxh3_64_intdigest(w, seed) for w in distinct] for seed in range(PRINTS)], np.uint64)
    return [fingerprint(x) for x in h] if distinct else [0] * PRINTS


def shingle_set(own: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct hashes; texts without words have one shingle in common."""
    return np.unique(hashes(own, size).view(np.int64)) if own else np.zeros(1, np.int64)


def parity(s: np.ndarray) -> np.ndarray:
    """PARITY bits of a set, each the parity of its members that fall there: two sets differ in as many members at least
    as these differ in bits."""
    odd = np.bincount(s & (PARITY - 1), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def least_common(n: int, least: float) -> int:
    """So many shingles a set of ``n`` has in common with any that is ``least`` alike."""
    return math.ceil(least * n - 1e-6)


def relabelled(of: DataFrame, links: DataFrame) -> DataFrame:
    """The groups ``of`` (id, tree) after ``links`` (a, b) joined some; only names of groups are contracted."""
    ends = links.join(of.select(F.col("id").alias("a"), F.col("tree").alias("x")).hint("merge"), "a").join(of.select(F.col("id").alias("b"), F.col("tree").alias("y")).hint("merge"), "b")
    tree = components(ends.select("x", "y").where("x <> y").distinct(), "x", "y")
    out = pin(of.join(tree, F.col("tree") == F.col("node"), "left").select("id", F.coalesce("component", "tree").alias("tree")), "groups")
    unpin(of)
    return out


def near_copies(docs: DataFrame, text: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id and component_id for documents whose text others repeat or nearly repeat (without those that stand alone).

    Near means a Jaccard similarity of ``least`` or more between the sets of ``size``-word shingles; no such pair is left
    apart:

    * Sets that have c in common have the first k of these among their first n - c + k in any order.  By the order of
      the hashes, most texts have too few shingles there that stand in another text's, and are settled.
    * Among the rest, each text is compared with the first one under each of its Golay keys.
    * Two texts of different groups are compared if they share one of the first n - c + 1 shingles, rare ones first, and
      if the shingles that stand in any second text suffice for ``least``: first each text with one of another group
      under each shingle, which joins most of a large group with as many comparisons as it has postings, then all
      that are still apart and whose parities do not already differ in more bits than ``least`` leaves members to differ.

    Rows without a doc_id are left out; rows that repeat one go with it; empty texts are copies of each other."""
    whole = F.coalesce(F.col(text), F.lit(""))
    own = docs.where("doc_id is not null").select("doc_id", F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit(7), whole).alias("k2"), whole.alias("t"))
    marked = pin(own.select("doc_id", "k1", "k2"), "marked")
    first = pin(marked.groupBy("k1", "k2").agg(F.min("doc_id").alias("first")), "first")

    def spare(n: int) -> int:
        return 1 + int(least * n) // 8

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "t", 1 << 20):
            sets = [shingle_set(words(t.as_py()), size) for t in batch.column("t")]
            sizes = [len(x) for x in sets]
            heads = [x[: n - least_common(n, least) + spare(n)] for x, n in zip(sets, sizes)]
            count = [len(x) for x in heads]
            k1, need = np.repeat(np.asarray(batch.column("k1")), count), np.repeat(np.array([spare(least_common(n, least)) for n in sizes], np.int64), count)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *heads])), pa.array(k1), pa.array(need)], names=["h", "k1", "need"])

    heads = pin(own.select("k1", "t").mapInArrow(lean(low), "h long, k1 long, need long").dropDuplicates(["h", "k1"]), "heads")
    common_ = pin(heads.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "common")
    alive = heads.join(common_.hint("merge"), "h").groupBy("k1").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need")).where("n >= need")
    named = pin(first.join(alive, "k1").select(F.col("first").alias("doc_id"), "k1", "k2"), "named")
    for held in (heads, common_):
        unpin(held)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "t", 1 << 20):
            texts = [words(t.as_py()) for t in batch.column("t")]
            f = np.array([word_prints(x) for x in texts], np.uint64).reshape(-1, PRINTS).view(np.int64)
            sets_ = [shingle_set(x, size) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k1"), pa.array(list(f), pa.list_(pa.int64())), pa.array(sets_, pa.list_(pa.int64())), pa.array([parity(x) for x in sets_], pa.list_(pa.int64()))], names=["id", "k1", "f", "s", "b"])

    found = own.join(named.hint("merge"), ["doc_id", "k1", "k2"], "left_semi").select("doc_id", "k1", "t")
    sets = pin(found.mapInArrow(lean(gather), "id long, k1 long, f array<long>, s array<long>, b array<long>").dropDuplicates(["id", "k1"]), "sets")

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs that are alike enough."""
        sa, sb = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        good = both >= least * (F.size("sa") + F.size("sb") - both) - 1e-9
        return pin(pin(pairs, "pairs").join(sa.hint("merge"), "a").join(sb.hint("merge"), "b").where(good).select("a", "b").distinct(), "links")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, f = np.asarray(batch.column("id")), np.array(batch.column("f").to_pylist(), np.int64).view(np.uint64).reshape(-1, PRINTS)
            for j in range(PRINTS):
                who, k = keys(np.ascontiguousarray(f[:, j]))
                yield pa.RecordBatch.from_arrays([pa.array(k | np.int64(j) << 44), pa.array(ids[who]), pa.array(f[who, j].view(np.int64))], names=["key", "id", "f"])

    keyed = pin(sets.select("id", "f").mapInArrow(lean(key), "key long, id long, f long"), "keyed")
    hubs = pin(keyed.groupBy("key").agg(F.min(F.struct("id", "f")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub"), "hubs")
    near = (F.col("hub.id") < F.col("id")) & (F.bit_count(F.col("hub.f").bitwiseXOR(F.col("f"))) <= NEAR)
    ahead = links(keyed.join(hubs.hint("merge"), "key").where(near).select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct())
    # texts that repeat a doc_id have one name
    of = relabelled(pin(sets.select("id", F.col("id").alias("tree")).distinct(), "alone"), ahead)

    each = sets.select("id", "k1", F.size("s").alias("n"), F.explode("s").alias("h"))
    often = pin(each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "often")
    one = Window.partitionBy("id", "k1")
    posted = each.join(often.hint("merge"), "h").withColumns({"common": F.count(F.lit(1)).over(one), "pos": F.row_number().over(one.orderBy("df", "h"))})
    c = F.ceil(F.col("n") * least - 1e-6)
    posted = pin(posted.where((F.col("common") >= c) & (F.col("pos") <= F.col("common") - c + 1)).select("id", "k1", "h", "n", "common"), "posted")

    def enough(x: str, y: str) -> F.Column:
        return F.least(F.col(f"{x}.common"), F.col(f"{y}.common")) * (1 + least) >= (F.col(f"{x}.n") + F.col(f"{y}.n")) * least - 1e-6

    def grouped() -> DataFrame:
        return pin(posted.join(of.hint("merge"), "id").select("h", "tree", "id", "k1", "n", "common"), "grouped")

    rows = grouped()
    for pick in (F.min, F.max):
        hub = pin(rows.groupBy("h").agg(pick(F.struct("tree", "id", "n", "common")).alias("hub"), F.min("tree").alias("low"), F.max("tree").alias("high")).where("low <> high").select("h", "hub"), "hubs")
        apart = rows.alias("r").join(hub.hint("merge"), "h").where((F.col("hub.tree") != F.col("r.tree")) & enough("hub", "r"))
        more = links(apart.select(F.least("hub.id", "r.id").alias("a"), F.greatest("hub.id", "r.id").alias("b")).distinct())
        if not more.isEmpty():
            of = relabelled(of, more)
            unpin(rows)
            rows = grouped()
    mixed = pin(rows.groupBy("h").agg(F.min("tree").alias("low"), F.max("tree").alias("high")).where("low <> high").select("h"), "mixed")
    words_ = range(PARITY // 64)
    bits = sets.select("id", "k1", *(F.get("b", F.lit(i)).alias(f"b{i}") for i in words_))
    left = pin(rows.join(mixed.hint("merge"), "h").join(bits.hint("merge"), ["id", "k1"]), "left")
    differ = sum((F.bit_count(F.col(f"a.b{i}").bitwiseXOR(F.col(f"b.b{i}"))) for i in words_), F.lit(0))
    few = differ * (1 + least) <= (F.col("a.n") + F.col("b.n")) * (1 - least) + 1e-6
    apart = (F.col("a.h") == F.col("b.h")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.tree") != F.col("b.tree")) & enough("a", "b") & few
    rest = links(left.alias("a").join(left.alias("b").hint("merge"), apart).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct())
    if not rest.isEmpty():
        of = relabelled(of, rest)
    # copies go with the first of their text; a doc_id with several texts joins their groups
    copies = marked.join(first.hint("merge"), ["k1", "k2"]).where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    out = components(of.where("id <> tree").select(F.col("tree").alias("a"), F.col("id").alias("b")).unionByName(copies), "a", "b")
    return out.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def drop_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of copies and near copies: that with the smallest doc_id."""
    gone = pin(near_copies(docs, text).where("doc_id <> component_id").select("doc_id"), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
