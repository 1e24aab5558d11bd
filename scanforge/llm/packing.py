"""Op 7 - best-two-fit packing of token sequences.

Packing depends on lengths alone, and there are at most ``capacity`` of them, so the plan is made on the histogram of
lengths and never on rows: a bin is filled greedily with the longest pieces that fit, then its smallest piece is
exchanged for two unpacked ones that fit the widened gap more tightly, as long as that helps.  The bin's pattern is used
as often as the counts allow, which uses up a length each time; the plan has a bounded number of patterns whatever the
number of documents.  Pieces find their place from their distributed rank within their length, by arithmetic on the
table of patterns.

Defined results: a null text is empty and becomes one piece of one token (the end mark); equal rows are packed each on
its own; an empty table gives an empty result; columns other than the id are not carried.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import blocks, encoder, read_spec
from .common import byte_slices, lean, pin, ranked

CAPACITY = 4096
END = 1


def token_pieces(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 and, if asked, the ids themselves."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocab_path))
    fields = [docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))]
    out = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for batch in byte_slices(batches, "text"):
            at, rows = 0, []
            for some in blocks(batch.column("text").to_pylist()):
                for ids in enc.block(some):
                    raw = np.append(ids, end).astype("<u4")
                    rows += [(at, i, low, raw[low : low + capacity]) for i, low in enumerate(range(0, len(raw), capacity))]
                    at += 1
            who = pa.array([r[0] for r in rows], pa.int64())
            cols = [batch.column("doc_id").take(who), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())]
            cols += [pa.array([len(r[3]) for r in rows], pa.int64()), pa.array([zlib.crc32(r[3].tobytes()) for r in rows], pa.int64())]
            if with_ids:
                cols.append(pa.array([r[3].astype(np.int32) for r in rows], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return docs.select("doc_id", "text").mapInArrow(lean(run), out)


def tighter_pair(open_: np.ndarray, left: np.ndarray, room: int, least: int) -> tuple[int, int] | None:
    """Two available lengths whose sum is over ``least`` and as near to ``room`` as can be."""
    big = np.flatnonzero(open_ < room)
    if not len(big):
        return None
    mate = np.minimum(np.searchsorted(open_, room - open_[big], side="right") - 1, big)
    single = (mate == big) & (left[big] < 2)
    mate = np.where(single, mate - 1, mate)
    total = np.where(mate >= 0, open_[big] + open_[np.maximum(mate, 0)], -1)
    best = int(total.argmax())
    if total[best] <= least:
        return None
    return int(open_[big[best]]), int(open_[mate[best]])


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths in descending order) for each pattern; together they use up the histogram."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    plan = []
    while True:
        open_ = np.flatnonzero(count)
        if not len(open_):
            return plan
        left = count[open_].copy()
        own: list[int] = []

        def take(length: int, n: int = 1) -> None:
            left[np.searchsorted(open_, length)] -= n
            own.extend([length] * n)

        take(int(open_[-1]))
        gap = capacity - own[0]
        while gap > 0:
            free = np.flatnonzero(left[: np.searchsorted(open_, gap, side="right")])
            if not len(free):
                break
            length = int(open_[free[-1]])
            n = int(min(gap // length, left[free[-1]]))
            take(length, n)
            gap -= n * length
        while gap > 0 and len(own) > 1:
            small = min(own)
            live = left > 0
            pair = tighter_pair(open_[live], left[live], gap + small, small)
            if pair is None:
                break
            own.remove(small)
            left[np.searchsorted(open_, small)] += 1
            take(pair[0])
            take(pair[1])
            gap += small - sum(pair)
        used = Counter(own)
        times = min(int(count[length]) // n for length, n in used.items())
        for length, n in used.items():
            count[length] -= n * times
        plan.append((times, sorted(own, reverse=True)))


def places(plan: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, times, first sequence, first offset), sorted by length and rank."""
    taken: Counter[int] = Counter()
    rows, sequence = [], 0
    for times, lengths in plan:
        offset = 0
        for length, n in Counter(lengths).items():
            rows.append((length, taken[length], times, sequence, offset))
            taken[length] += n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; each sequence holds at most ``capacity`` tokens, without gaps."""
    # dealing by range reads its input twice: tokens are counted once and written
    placed = ranked(pin(pieces, "pieces"), ["length"], [F.col("doc_id"), F.col("piece")], "_rank")
    histogram = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = pieces.sparkSession.sparkContext.broadcast(places(plan_bins(histogram, capacity)))
    keep = list(pieces.schema.fields)
    out = T.StructType([*keep, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = held.value
        key = at[:, 0] << 48 | at[:, 1]
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("_rank"))
            span = at[np.searchsorted(key, length << 48 | rank, side="right") - 1]
            nth = rank - span[:, 1]
            cols = [batch.column(f.name) for f in keep]
            cols += [pa.array(span[:, 3] + nth % span[:, 2]), pa.array(span[:, 4] + nth // span[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(cols, names=out.names)

    packed = placed.mapInArrow(run, out)
    packed._scanforge_path = placed._scanforge_path
    return packed


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token sequences themselves, from pieces that carry their ids."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(own, lambda x: x["ids"])).alias("ids"))
