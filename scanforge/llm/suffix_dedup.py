"""Op 3 - exact substring dedup with suffix arrays made by external induced sorting.

Every byte that lies in a ``LENGTH``-byte string which also starts anywhere else goes; strings are judged on the input
and never cross documents.  Counting prunes what cannot repeat and collapses what is equal; where different texts meet,
the suffix order decides:

1. Equal texts are collapsed to classes, kept as a bucketed table so that later joins bring rows to the texts and not
   texts to the rows.  A class with several members is removed whole where it has LENGTH bytes at all.
2. Each start p belongs to the anchor of its string: the smallest ``GRAM``-byte hash inside, rightmost among equals.
   Equal strings have the same anchor at the same offset, and runs of starts share one.  An anchor whose hash stands
   once in the corpus has no equal string, so its starts are settled.
3. The stretch of text that the starts of an anchor cover is its context.  Equal contexts are collapsed by count.  Where
   different contexts meet under an anchor, they are cut into blocks of ``BLOCK`` starts, placed by the anchor.  All
   strings of a block have its core of LENGTH - BLOCK + 1 bytes in common, whose hash is its key: a key that stands once
   is settled, equal blocks collapse.
4. Blocks that still differ under a key are sorted: what is left and right of the core is spelled out, the core itself
   is one symbol and the number of its key.  :mod:`induced` makes the suffix order and common prefixes of all blocks of a
   shard (a set of keys); a start repeats if a neighbour in that order shares a whole string with it.
5. Byte ranges return to their classes and are cut out.

A key with more than ``CROWD`` different blocks is cut in halves, each with a longer core and its own key, and so on
down to single starts, which are equal or not by count alone; so no task holds a group without bound, and the work for a
group grows with its blocks.  Texts are read whole, long ones in overlapping stretches of starts; tables between the
steps are written to the shared folder.  Identities are 126-bit hashes.

Defined results: a null text is empty; texts under LENGTH bytes lose nothing; a null or repeated doc_id changes
nothing, each row is a document; an empty table gives an empty result.  ``removal_report`` reads doc_id and the text
only; ``kept_texts`` packs all other columns, so no name clashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, drop_path, held_table, lean, packed, partitions, pin, unpacked, unpin
from .induced import repeated_starts
from .passages import WINDOW, repeated_words

LENGTH, GRAM, STRETCH = 400, 24, 1_000_000
BLOCK, CROWD, SHARD = 64, 20_000, 1 << 22
PLACE_BITS = 20
LOW63 = (1 << 63) - 1
_odd = np.random.default_rng(11).integers(1, 1 << 62, 4, np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of GRAM (24) bytes."""
    n = len(raw) - GRAM + 1
    word = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    h = word[:n] * _odd[0]
    h ^= h >> np.uint64(29)
    h += word[8 : 8 + n]
    h *= _odd[1]
    h ^= h >> np.uint64(32)
    h += word[16 : 16 + n]
    h *= _odd[2]
    h ^= h >> np.uint64(30)
    h *= _odd[3]
    h ^= h >> np.uint64(31)
    return h


def least_runs(h: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, first, last) of the runs of windows that have their smallest hash, rightmost among equals, in one place."""
    for base in range(0, len(h) - window + 1, STRETCH):
        own = h[base : base + STRETCH + window - 1]
        mask = np.uint64((1 << PLACE_BITS + 1) - 1)
        least = (own & ~mask) | (mask - np.arange(len(own), dtype=np.uint64))
        size, n = 1, len(own) - window + 1
        while size * 2 <= window:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[:n], least[window - size : window - size + n])
        change = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        at = (mask - (least[change] & mask)).astype(np.int64)
        yield at + base, change + base, np.r_[change[1:], n] - 1 + base


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, anchor, first start, last start) of each run of starts that share an anchor."""
    out = []
    for low in range(0, len(text) - LENGTH + 1, STRETCH):
        raw = np.frombuffer(text, np.uint8, min(STRETCH + LENGTH - 1, len(text) - low), low)
        h = gram_hashes(raw)
        for at, first, last in least_runs(h, LENGTH - GRAM + 1):
            out.append((h[at].view(np.int64), at + low, first + low, last + low))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def mapped(df: DataFrame, schema: str, each, text: str = "x") -> DataFrame:
    """Run ``each`` on slices of rows with some MB of ``text``, give its columns."""
    out = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.string() for f in out]
        for batch in byte_slices(batches, text):
            cols = each(*(batch.column(c) for c in batch.schema.names))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=out.names)

    return df.mapInArrow(lean(run), out)


def find_anchors(k1, k2, text):
    found = [anchors(t.as_buffer()) for t in text]
    many = [len(f[0]) for f in found]
    a, b = np.repeat(np.asarray(k1), many), np.repeat(np.asarray(k2), many)
    return a, b, *(np.concatenate([f[i] for f in found]) if found else [] for i in range(4))


def halves(found: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes as two columns of 63 bits."""
    return np.array([x & LOW63 for x in found], np.int64), np.array([x >> 65 for x in found], np.int64)


def places(text, spots) -> tuple[list[memoryview], np.ndarray, dict[str, np.ndarray]]:
    """The texts, and for each of their spots which text it is in and its fields."""
    rows = spots.flatten()
    many = np.asarray(pc.list_value_length(spots), np.int64)
    fields = {f.name: np.asarray(x) for f, x in zip(rows.type, rows.flatten())}
    return [memoryview(t.as_buffer()) for t in text], np.repeat(np.arange(len(many)), many), fields


def cut_contexts(k1, k2, text, spots):
    """Contexts of a class's repeated anchors: anchor, identity, offset of the anchor, first and last start."""
    raw, who, s = places(text, spots)
    found = [xxhash.xxh3_128_intdigest(raw[i][a : b + LENGTH]) for i, a, b in zip(who.tolist(), s["low"].tolist(), s["high"].tolist())]
    return np.asarray(k1)[who], np.asarray(k2)[who], s["h"], *halves(found), s["at"] - s["low"], s["low"], s["high"]


def cut_blocks(k1, k2, text, spots):
    """Blocks of BLOCK starts, placed by the anchor, of contexts that differ from others under their anchor.

    A block's key is the hash of the bytes that all strings of a whole block share: if no other block has it, none of
    its starts repeats.  Then come its identity, its place, and the context it is cut from."""
    raw, who, s = places(text, spots)
    first, last = s["off"] // BLOCK, (s["off"] - s["high"] + s["low"]) // BLOCK
    many = first - last + 1
    of = np.repeat(np.arange(len(many)), many)
    block = first[of] - (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many))
    core = (s["low"] + s["off"])[of] - block * BLOCK
    low, high = np.maximum(s["low"][of], core - BLOCK + 1), np.minimum(s["high"][of], core)
    keys, own = [], []
    for i, b, c, x, y in zip(who[of].tolist(), block.tolist(), core.tolist(), low.tolist(), high.tolist()):
        keys.append(xxhash.xxh3_128_intdigest(raw[i][c : c + LENGTH - BLOCK + 1], b))
        own.append(xxhash.xxh3_128_intdigest(raw[i][x : y + LENGTH]))
    q1, q2 = halves(keys)
    return np.asarray(k1)[who[of]], np.asarray(k2)[who[of]], q1 ^ s["h"][of], q2, *halves(own), core - low, low, high, s["c1"][of], s["c2"][of], low - s["low"][of]


def cut_ends(text, spots):
    """What stands left and right of the core of each block, after its identity and key."""
    raw, who, s = places(text, spots)
    core = s["low"] + s["off"]
    left = [bytes(raw[i][a:c]) for i, a, c in zip(who.tolist(), s["low"].tolist(), core.tolist())]
    right = [bytes(raw[i][c : b + LENGTH]) for i, c, b in zip(who.tolist(), (core + LENGTH - BLOCK + 1).tolist(), s["high"].tolist())]
    return s["c1"], s["c2"], s["q1"], s["q2"], left, right


def spelled(left: bytes, key: int, right: bytes) -> np.ndarray:
    """A block in symbols: bytes are 1 to 256, the core is 257 and the number of its key."""
    a, b = len(left), len(right)
    out = np.empty(a + 4 + b, np.int16)
    out[:a] = np.frombuffer(left, np.uint8)
    out[a] = 256
    out[a + 1 : a + 4] = key & 255, key >> 8 & 255, key >> 16
    out[a + 4 :] = np.frombuffer(right, np.uint8)
    out += 1
    return out


def sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition holds whole keys, in order: sort runs of keys of about SHARD symbols together."""

    def done(ids: list[tuple], blocks: list[np.ndarray], width: int) -> pa.RecordBatch:
        found, _ = repeated_starts(blocks, width + 3, 258)
        cols = [[ids[i][c] for i, _, _ in found] for c in range(2)] + [[f[1] for f in found], [f[2] for f in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["e1", "e2", "first", "last"])

    ids, blocks, size, number, now = [], [], 0, 0, None
    for batch in batches:
        for q1, q2, w, e1, e2, left, right in zip(*(batch.column(c).to_pylist() for c in ("q1", "q2", "w", "e1", "e2", "left", "right"))):
            if (q1, q2, w) != now:
                if ids and (size >= SHARD or w != now[2] or number == (1 << 23) - 1):
                    yield done(ids, blocks, now[2])
                    ids, blocks, size, number = [], [], 0, 0
                now, number = (q1, q2, w), number + 1
            ids.append((e1, e2))
            blocks.append(spelled(left, number, right))
            size += len(blocks[-1]) + 1
    if ids:
        yield done(ids, blocks, now[2])


def halved(rows: DataFrame, half: int) -> DataFrame:
    """Blocks of 2 * half starts cut in two, each with the core and key of its own strings."""

    def part(name: str, test: Column, inner: Column, left: Column, right: Column, shift: Column) -> DataFrame:
        key = [F.xxhash64(F.lit(name + str(i)), "q1", "q2", inner).alias(f"q{i}") for i in (1, 2)]
        new = rows.where(test).select("c1", "c2", *key, left.alias("left"), right.alias("right"), (F.col("shift") + shift).alias("shift"))
        ids = [F.xxhash64(F.lit(i), "q1", "q2", "left", F.lit(0), "right").alias(f"e{i}") for i in (1, 2)]
        return new.select("*", *ids, F.lit(half).cast("long").alias("w"))

    n, m = F.octet_length("left"), F.octet_length("right")
    at = lambda c, a, size: F.substring(c, a, size)
    near = part("left", n >= half, at("left", n - half + 1, F.lit(half)), at("left", F.lit(1), n - half), at("right", F.lit(1), F.least(m, F.lit(half - 1))), F.lit(0))
    kept = F.least(n, F.lit(half - 1))
    far = part("right", m >= half, at("right", F.lit(1), F.lit(half)), at("left", n - kept + 1, kept), at("right", F.lit(half + 1), m - half), n - kept)
    return near.unionByName(far)


def classes_of(docs: DataFrame, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("k1", F.xxhash64(whole)).withColumn("k2", F.xxhash64(F.lit(7), whole, F.length(whole)))


def whole_runs(distinct: DataFrame) -> DataFrame:
    """Stretches that stand more than once repeat from their first start to their last."""
    return distinct.where("n > 1").select("c1", "c2", F.lit(0).cast("long").alias("first"), (F.col("at.high") - F.col("at.low")).alias("last"))


class Repeats:
    """The classes of equal texts (a bucketed table) and the byte ranges to remove from each."""

    def __init__(self, docs: DataFrame, text: str = "text"):
        self.spark = docs.sparkSession
        self.keyed = classes_of(docs, text)
        whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
        self.parts = partitions(self.spark)
        one = self.keyed.groupBy("k1", "k2").agg(F.first(whole).alias("x"), F.count(F.lit(1)).alias("m"))
        self.name = held_table(one, "classes", self.parts, ["k1", "k2"])
        self.classes = self.spark.table(self.name.partition("@")[0])
        self.ranges = self.find()

    def cutting(self, spots: DataFrame, fields: list[str], schema: str, each, keyed: bool = True) -> DataFrame:
        """``each`` on the texts with the lists of their spots; the texts are neither dealt again nor read in vain."""
        key = ["k1", "k2"]
        lists = spots.groupBy(*key).agg(F.collect_list(F.struct(*fields)).alias("spots"))
        both = self.classes.select(*key, "x").join(lists.hint("merge"), key)
        return pin(mapped(both.select(*(key if keyed else []), "x", "spots"), schema, each), "cut")

    def find(self) -> DataFrame:
        key, mark = ["k1", "k2"], ["c1", "c2"]
        long = self.classes.where(F.length("x") >= LENGTH)
        spots = pin(mapped(long.select(*key, "x"), "k1 long, k2 long, h long, at long, low long, high long", find_anchors), "anchors")
        again = self.several(spots, ["h"])
        own = self.cutting(spots.join(again.hint("merge"), "h"), ["low", "high", "at", "h"], "k1 long, k2 long, h long, c1 long, c2 long, off long, low long, high long", cut_contexts)
        unpin(spots)
        unpin(again)
        distinct = self.distinct(own, ["h"])
        rivals = self.several(distinct, ["h"])
        contested = distinct.join(rivals.hint("merge"), "h").select("h", *mark, "off", "at.*")
        schema = "k1 long, k2 long, q1 long, q2 long, c1 long, c2 long, off long, low long, high long, in_c1 long, in_c2 long, shift long"
        blocks = self.cutting(contested, ["h", *mark, "off", "low", "high"], schema, cut_blocks)
        unpin(rivals)
        shared = self.several(blocks, ["q1", "q2"])
        alike = pin(blocks.join(shared.hint("merge"), ["q1", "q2"]), "alike")
        unpin(blocks)
        unpin(shared)
        few = self.distinct(alike, ["q1", "q2"])
        inner = self.settle(few)
        up = alike.join(inner.hint("merge"), mark).select(F.col("in_c1").alias("c1"), F.col("in_c2").alias("c2"), (F.col("first") + F.col("shift")).alias("first"), (F.col("last") + F.col("shift")).alias("last"))
        runs = pin(up.unionByName(whole_runs(distinct)), "runs")
        for held in (alike, few, inner):
            unpin(held)
        found = own.join(runs.hint("merge"), mark).select(*key, (F.col("low") + F.col("first")).alias("a"), (F.col("low") + F.col("last") + LENGTH).alias("b"))
        copies = self.classes.where(F.col("m") > 1).select(*key, F.lit(0).cast("long").alias("a"), F.length("x").cast("long").alias("b")).where(F.col("b") >= LENGTH)
        out = pin(found.unionByName(copies).groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("cuts")), "ranges")
        for held in (own, distinct, runs):
            unpin(held)
        return out

    @staticmethod
    def distinct(own: DataFrame, more: list[str]) -> DataFrame:
        """Distinct stretches with their counts and one place each."""
        one = F.min(F.struct("k1", "k2", "low", "high")).alias("at")
        return pin(own.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), one, F.min("off").alias("off"), *(F.min(c).alias(c) for c in more)), "distinct")

    @staticmethod
    def several(rows: DataFrame, key: list[str]) -> DataFrame:
        """Keys of more than one row, with their number; a table of its own, so that joins with it can split a hot key."""
        return pin(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rivals")).where("rivals > 1"), "several")

    def settle(self, few: DataFrame) -> DataFrame:
        """Runs of repeated starts (c1, c2, first, last) of the distinct blocks ``few``."""
        ids, key = ["e1", "e2"], ["q1", "q2"]
        rivals = self.several(few, key)
        still = few.join(rivals.select(*key).hint("merge"), key).select("c1", "c2", *key, "off", "at.*")
        ends = self.cutting(still, ["c1", "c2", *key, "off", "low", "high"], "c1 long, c2 long, q1 long, q2 long, left binary, right binary", cut_ends, keyed=False)
        now = ends.select("*", F.lit(0).cast("long").alias("shift"), F.col("c1").alias("e1"), F.col("c2").alias("e2"), F.lit(BLOCK).cast("long").alias("w"))
        width, runs, to_sort, made = BLOCK, [whole_runs(few)], [], [ends, rivals]
        while True:
            crowds = pin(rivals.where(F.col("rivals") > CROWD).select(*key), "crowds")
            made.append(crowds)
            any_ = width > 1 and not crowds.isEmpty()
            fit = rivals.where(F.col("rivals") <= CROWD).select(*key) if any_ else rivals.select(*key)
            to_sort.append(now.join(fit.hint("merge"), key))
            if not any_:
                break
            width //= 2
            now = pin(halved(now.join(crowds.hint("merge"), key), width), "halved")
            groups = pin(now.groupBy(*ids).agg(F.count(F.lit(1)).alias("n"), *(F.min(c).alias(c) for c in key)), "groups")
            starts = F.octet_length("left") + F.octet_length("right") - (width - 2)
            runs.append(now.join(groups.where("n > 1").select(*ids).hint("merge"), ids).select("c1", "c2", F.col("shift").alias("first"), (F.col("shift") + starts - 1).alias("last")))
            rivals = self.several(groups, key)
            made += [now, groups, rivals]
        blocks = to_sort[0]
        for more in to_sort[1:]:
            blocks = blocks.unionByName(more.select(*blocks.columns))
        own = pin(blocks, "to_sort") if len(to_sort) > 1 else blocks
        # blocks of a key that are equal after halving are sorted once
        one = own.dropDuplicates([*ids, *key]) if len(to_sort) > 1 else own
        shards = one.select(*key, "w", *ids, "left", "right").repartition(self.parts, F.xxhash64(*key)).sortWithinPartitions("w", *key, *ids)
        found = pin(shards.mapInArrow(lean(sort_shard), "e1 long, e2 long, first long, last long"), "sorted")
        back = found.select(F.col("e1").alias("c1"), F.col("e2").alias("c2"), "first", "last")
        if len(to_sort) > 1:
            back = found.join(own.select(*ids, "c1", "c2", "shift").hint("merge"), ids).select("c1", "c2", (F.col("first") + F.col("shift")).alias("first"), (F.col("last") + F.col("shift")).alias("last"))
        for more in runs:
            back = back.unionByName(more.select(*(F.col(c).cast("long").alias(c) for c in ("c1", "c2", "first", "last"))))
        out = pin(back, "inner")
        for held in [*made, found, *([own] if len(to_sort) > 1 else [])]:
            unpin(held)
        return out

    def cut(self, schema: str, each, words: bool = False) -> DataFrame:
        """``each(kept bytes, removed, spans)`` of every class, as columns after k1 and k2, then its words and members."""

        def run(k1, k2, x, cuts, m=None):
            rows = [each(*remove(memoryview(t.as_buffer()), c.as_py())) for t, c in zip(x, cuts)]
            return k1, k2, *zip(*rows), *([[word_count(t.as_buffer()) for t in x], m] if words else [])

        joined = self.classes.join(self.ranges.hint("merge"), ["k1", "k2"], "left").select("k1", "k2", "x", "cuts", *(["m"] if words else []))
        return mapped(joined, schema, run)

    def close(self) -> None:
        drop_path(self.spark, self.name)
        unpin(self.ranges)


def remove(raw: memoryview, cuts: list | None) -> tuple[bytes, int, int]:
    """The remaining bytes, how many go, and how many maximal runs they form."""
    kept, at, gone, spans = [], 0, 0, 0
    end = -1
    for c in cuts or ():
        a, b = c["a"], c["b"]
        if a > end:
            spans += 1
            kept.append(raw[at:a])
        gone += max(0, b - max(a, at))
        at = end = max(end, b)
    kept.append(raw[max(at, 0) :])
    return b"".join(kept), gone, spans


def word_count(raw: pa.Buffer) -> int:
    return len(raw.to_pybytes().split())


def removal_report(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and the digest of the kept bytes; n_repeated_words, the words that lie
    in runs of 50 or more that another row has too (passages under LENGTH bytes among them, which are not removed)."""
    found = Repeats(docs.select("doc_id", text), text)
    schema = "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_words long, m long"
    told = pin(found.cut(schema, lambda kept, gone, spans: (len(kept) + gone, gone, spans, hashlib.sha256(kept).hexdigest()), words=True), "removed")
    words = repeated_words(found.classes, found.cutting, mapped)
    found.close()
    both = told.join(words.hint("merge"), ["k1", "k2"], "left")
    n = F.when((F.col("m") > 1) & (F.col("n_words") >= WINDOW), F.col("n_words")).otherwise(F.coalesce("n_repeated_words", F.lit(0)))
    out = found.keyed.select("doc_id", "k1", "k2").join(both.withColumn("n_repeated_words", n).hint("merge"), ["k1", "k2"])
    return out.drop("k1", "k2", "m", "n_words")


def kept_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the kept bytes as text; a character that a cut splits is dropped with it.

    The result reads the table of classes, which goes with the scope it is made in (see ``common.scope``)."""
    found = Repeats(packed(docs, [text]), text)
    told = found.cut("k1 long, k2 long, kept string", lambda kept, gone, spans: (kept.decode("utf-8", "ignore"),))
    both = found.keyed.withColumn("is", F.col(text).isNotNull()).drop(text).join(told.hint("merge"), ["k1", "k2"])
    return unpacked(both.withColumn(text, F.when(F.col("is"), F.col("kept"))), docs.columns, [text])
