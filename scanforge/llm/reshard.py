"""Op 1 - sharding: minimum-cost-flow resharding.

Old shards hold rows, new shards have capacities.  A row that stays costs nothing, a row that moves costs its bytes, so
the plan is a transport problem.  Each old shard is seen as blocks of rows in ascending size (the first rows to leave
are the smallest, which makes the cost of leaving convex); a flow network over blocks and shards is solved by successive
shortest paths, and its flow says how many rows pass from which old to which new shard.  Under law ``rows`` a shard keeps
q or q + 1 rows, so its only open question is one row, and the blocks are: rows that leave in any plan, that one row,
rows that stay in any plan.  The one row enters with its own size, so the plan moves the fewest bytes of all plans.  The
network's size depends on shards, never on rows; only the shards' counts reach the driver.

Rows get their place from their distributed rank within their old shard, by arithmetic on a table of at most
old + new intervals, so the plan costs one range shuffle of whatever columns are asked for.  :func:`rewrite_affected`
then writes only shards that lose or gain rows, in files of up to ``FILE_ROWS`` rows that are tasks of their own.

Law ``rows``: the counts of new shards differ by one at most.  Defined results: null texts count 16 bytes; equal rows
are all placed; a null shard key belongs to old shard 0; an empty table gives an empty result; input columns named like those
the operator adds (old_shard, shard, slot) are replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, ranked, unpacked, unpin

FILE_ROWS = 100_000


class Flow:
    """Minimum-cost flow by successive shortest paths with potentials; integer capacities, costs >= 0."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def add(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def solve(self, s: int, t: int) -> tuple[int, int]:
        n, sent, paid = len(self.out), 0, 0
        high = [0] * n
        while True:
            far, via = [None] * n, [-1] * n
            far[s], heap = 0, [(0, s)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for e in self.out[x]:
                    if self.room[e] > 0:
                        y = self.to[e]
                        nd = d + self.cost[e] + high[x] - high[y]
                        if far[y] is None or nd < far[y]:
                            far[y], via[y] = nd, e
                            heapq.heappush(heap, (nd, y))
            if far[t] is None:
                return sent, paid
            for x in range(n):
                high[x] += far[x] if far[x] is not None else far[t]
            y, least = t, None
            while y != s:
                e = via[y]
                least = self.room[e] if least is None else min(least, self.room[e])
                y = self.to[e ^ 1]
            y = t
            while y != s:
                e = via[y]
                self.room[e] -= least
                self.room[e ^ 1] += least
                y = self.to[e ^ 1]
            sent += least
            paid += least * (high[t] - high[s])

    def flow(self, e: int) -> int:
        return self.room[e ^ 1]


def solve_transfers(blocks: dict[int, list[tuple[int, int]]], capacities: list[int], spare: int = 0) -> dict[tuple[int, int], int]:
    """Rows to pass from old shard to new shard (same number: they stay), moving the fewest bytes.

    ``blocks``: per old shard (rows, bytes) in ascending row size.  Every new shard takes its capacity, and ``spare`` of
    them one row more."""
    old = sorted(blocks)
    flat = [(o, rows, size) for o in old for rows, size in blocks[o] if rows]
    s, hub, spare_at, t = 0, 1, 2, 3
    base = 4
    new_at = {j: base + j for j in range(len(capacities))}
    own_at = {o: base + len(capacities) + i for i, o in enumerate(old)}
    first = base + len(capacities) + len(old)
    net = Flow(first + len(flat))
    stay, leave = {}, {o: [] for o in old}
    for i, (o, rows, size) in enumerate(flat):
        net.add(s, first + i, rows, 0)
        net.add(first + i, own_at[o], rows, 0)
        leave[o].append(net.add(first + i, hub, rows, max(1, size // rows)))
    for o in old:
        if o in new_at:
            stay[o] = net.add(own_at[o], new_at[o], sum(r for r, _ in blocks[o]), 0)
    total = sum(r for _, r, _ in flat)
    take = {j: net.add(hub, new_at[j], total, 0) for j in new_at}
    for j, room in enumerate(capacities):
        net.add(new_at[j], t, room, 0)
        if spare:
            net.add(new_at[j], spare_at, 1, 0)
    if spare:
        net.add(spare_at, t, spare, 0)
    sent, _ = net.solve(s, t)
    if sent != total:
        raise ValueError(f"capacities hold {sent} of {total} rows")
    plan = {(o, o): net.flow(e) for o, e in stay.items() if net.flow(e)}
    supply = [[o, sum(net.flow(e) for e in leave[o])] for o in old]
    want = [[j, net.flow(e)] for j, e in take.items() if net.flow(e)]
    for giver in supply:
        while giver[1]:
            j = next(w for w in want if w[1])
            n = min(giver[1], j[1])
            plan[(giver[0], j[0])] = plan.get((giver[0], j[0]), 0) + n
            giver[1] -= n
            j[1] -= n
    return plan


def reshard(docs: DataFrame, old_shard: Column, size: Column, order: list[Column], new_shards: int) -> DataFrame:
    """``docs`` with ``old_shard``, ``shard`` and ``slot`` (gapless from 0 in each shard) under law ``rows``."""
    added = ["old_shard", "shard", "slot"]
    carried = [c for c in docs.columns if c not in added]
    names = [f"_order{i}" for i in range(len(order))]
    rest = F.struct(F.lit(True).alias("_"), *(F.col(f"`{c}`") for c in carried)).alias("rest")
    rows = docs.select(rest, F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"), size.cast("long").alias("_size"), *(c.alias(n) for c, n in zip(order, names)))
    placed = ranked(rows, ["old_shard"], [F.col("_size"), *map(F.col, names)], "_rank")
    # one row for each old shard and block
    totals = placed.groupBy("old_shard").agg(F.max("_rank").alias("_last"))
    counts = {r["old_shard"]: r["_last"] + 1 for r in totals.collect()}
    keep = sum(counts.values()) // new_shards
    first = F.when(F.col("old_shard") < new_shards, F.greatest(F.col("_last") - keep, F.lit(-1))).otherwise(F.col("_last") + 1)
    block = F.when(F.col("_rank") < F.col("first"), 0).when(F.col("_rank") == F.col("first"), 1).otherwise(2)
    found = placed.join(F.broadcast(totals.withColumn("first", first)), "old_shard").groupBy("old_shard", block.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("s")).collect()
    blocks: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(found, key=lambda r: (r["old_shard"], r["b"])):
        blocks.setdefault(r["old_shard"], []).append((r["n"], r["s"]))
    n = sum(r["n"] for r in found)
    if not n:
        unpin(placed)
        return unpacked(rows, carried, [], F.col("old_shard"), F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))
    plan = solve_transfers(blocks, [n // new_shards] * new_shards, n % new_shards)
    spans, filled = [], {j: plan.get((j, j), 0) for j in range(new_shards)}
    for o in blocks:
        low = 0
        for (a, j), k in sorted(plan.items()):
            if a == o and j != o:
                spans.append((o, low, low + k, j, filled[j] - low))
                filled[j] += k
                low += k
        if plan.get((o, o)):
            spans.append((o, low, low + plan[(o, o)], o, -low))
    held = docs.sparkSession.createDataFrame(spans, "o int, low long, high long, shard int, shift long")
    on = (F.col("old_shard") == F.col("o")) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high"))
    out = placed.join(F.broadcast(held), on).withColumn("slot", F.col("_rank") + F.col("shift"))
    out = unpacked(out, carried, [], *map(F.col, added))
    out._scanforge_path = placed._scanforge_path
    return out


def rewrite_affected(placed: DataFrame, path: str) -> list[int]:
    """Write, sorted by slot, the shards that lose or gain rows; return their numbers.  The others keep their files."""
    moves = placed.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("x")).distinct()
    affected = sorted(r["x"] for r in moves.collect())
    if not affected:
        return []
    live = placed.where(F.col("shard").isin(affected))
    # a shard is written by as many tasks as it has files, so a large one is no task of its own
    dealt = live.withColumn("_file", F.floor(F.col("slot") / FILE_ROWS)).repartition("shard", "_file").sortWithinPartitions("shard", "slot").drop("_file")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_ROWS).option("compression", "zstd").partitionBy("shard").parquet(path)
    filled = {r["shard"] for r in live.select("shard").distinct().collect()}
    for x in affected:
        if x not in filled:
            drop_path(placed.sparkSession, f"{path}/shard={x}")
    return affected
