"""Op 2 - secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Each whole text is searched for the base kinds (assigned values, access keys, long hex runs) and for looser candidates:
long mixed runs of letters and digits that no base span touches.  The hash of every candidate's value is counted over
the corpus by distinct owners and by distinct repositories.  A value that ``EXAMPLE_OWNERS`` owners hold, or more than
one owner in ``EXAMPLE_REPOSITORIES`` repositories, is a widely copied example; one that stays with its owner looks live,
in however many of the owner's repositories it stands.  Base spans always stay; loose candidates become spans (kind
``owned``) only if they look live.

Texts are read once and not shuffled: a slim table (row number, owner, matches) goes to the shared folder, and only
matches are dealt.  A match's place is a running sum over the matches before it, so the work is linear in the matches of
a text.  Counts are made in steps (value, owner, repository; value, owner; value) that aggregate before each shuffle, so
a value in a third of all rows is no hot task; its verdict is a table of its own, and the join with it can be split.

Defined results: a null text is empty; a null owner is an owner of its own, a null repository one of its own; rows are
kept apart by a row number, so repeated rows and null ids are each scanned; an empty table gives an empty result.  The
operator adds ``spans``, an array sorted by start and kind; an input column of that name is replaced, all others pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pin, unpacked

#: The base kinds in their order, their patterns, and the group that holds the value.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{12,})"
HEX = r"([0-9a-f]{32,})"
KINDS = ("assign", "access", "hex", "owned")
LOOSE = r"([A-Za-z0-9_-]{20,})"
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, LEAST_ASSIGNED, DISTINCT_CHARS = 3, 6, 8, 10
MARK = "[SECRET]"
MATCH = "array<struct<kind:int,pos:int,gap:int,size:int,value:bigint,good:boolean>>"


def matches(text: Column, kind: int, pattern: str, group: int, good) -> Column:
    """Leftmost non-overlapping matches: their number, the characters since the one before, size, hash of the value."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    both = F.zip_with(F.zip_with(hits, values, lambda h, v: F.struct(h.alias("h"), v.alias("v"))), F.slice(gaps, F.lit(1), F.size(hits)), lambda x, g: F.struct(x["h"].alias("h"), x["v"].alias("v"), g.alias("g")))
    out = F.transform(both, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), x["g"].alias("gap"), F.length(x["h"]).alias("size"), F.xxhash64(x["v"]).alias("value"), good(x["v"]).alias("good")))
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast(MATCH))


def every_match(text: Column) -> Column:
    """Matches of the base kinds and of loose candidates; those that are not good only count for the places."""
    always = lambda v: F.lit(True)
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= DISTINCT_CHARS)
    long = lambda v: F.length(v) >= LEAST_ASSIGNED
    return F.concat(matches(text, 0, ASSIGN, 2, long), matches(text, 1, ACCESS, 0, always), matches(text, 2, HEX, 0, always), matches(text, 3, LOOSE, 0, mixed))


def placed(found: DataFrame, key: list[str]) -> DataFrame:
    """Spans of exploded matches: base ones, and loose ones that no base span touches."""
    so_far = Window.partitionBy(*key, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int")
    spans = found.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("size")).where("good")
    base = F.col("kind") < 3
    up = Window.partitionBy(*key).orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*key).orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    before = F.coalesce(F.max(F.when(base, F.col("stop"))).over(up), F.lit(0)) > F.col("start")
    after = F.coalesce(F.min(F.when(base, F.col("start"))).over(down) < F.col("stop"), F.lit(False))
    return spans.withColumn("_touched", before | after).where(base | ~F.col("_touched")).drop("_touched", "gap", "size", "pos", "good")


def say(spans: Column) -> Column:
    """``kind:start:stop`` of sorted spans, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))))


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """``docs`` (without its text unless ``keep_text``) plus ``spans``: start, kind number, stop, owners, repositories, live, reach."""
    kept = [c for c in docs.columns if c != "spans" and (keep_text or c != text)]
    rest = F.struct(F.lit(True).alias("_"), *(F.col(f"`{c}`") for c in kept)).alias("rest")
    named = docs.select(rest, F.col(owner).alias("o"), F.col(repository).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    held = pin(named.withColumn("_found", every_match(F.col("t"))).drop("t").withColumn("_row", F.monotonically_increasing_id()), "candidates")
    flat = held.where(F.size("_found") > 0).select("_row", "o", "r", F.explode("_found").alias("s")).select("_row", "o", "r", "s.*")
    each = pin(placed(flat, ["_row"]), "spans")
    owned = each.groupBy("value", "o", "r").agg(F.lit(1).alias("x")).groupBy("value", "o").agg(F.count(F.lit(1)).alias("n"))
    verdict = pin(owned.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories")), "verdicts")
    copied = (F.col("owners") >= EXAMPLE_OWNERS) | ((F.col("owners") > 1) & (F.col("repositories") >= EXAMPLE_REPOSITORIES))
    judged = each.drop("o", "r").join(verdict.hint("merge"), "value").withColumn("live", ~copied).where((F.col("kind") < 3) | F.col("live"))
    # how far the live spans before reach, for redaction
    reach = Window.partitionBy("_row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    judged = judged.withColumn("reach", F.coalesce(F.max(F.when(F.col("live"), F.col("stop"))).over(reach), F.lit(0)))
    spans = judged.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "owners", "repositories", "live", "reach"))).alias("spans"))
    kind = spans.schema["spans"].dataType.simpleString()
    some = held.where(F.size("_found") > 0).join(spans, "_row", "left").select("rest", F.coalesce("spans", F.array().cast(kind)).alias("spans"))
    out = unpacked(held.where(F.size("_found") == 0).select("rest", F.array().cast(kind).alias("spans")).unionByName(some), kept, [], F.col("spans"))
    out._scanforge_path = held._scanforge_path
    return out


def redact(text: Column, spans: Column) -> Column:
    """The text with every run of live spans replaced by a mark; widely copied examples stay."""
    live = F.filter(spans, lambda s: s["live"])
    end = F.array_max(F.transform(live, lambda s: s["stop"]))
    part = lambda s: F.when(s["start"] >= s["reach"], F.concat(F.substring(text, s["reach"] + 1, s["start"] - s["reach"]), F.lit(MARK))).otherwise("")
    done = F.concat(F.concat_ws("", F.transform(live, part)), F.substring(text, end + 1, F.length(text)))
    return F.when(F.size(live) > 0, done).otherwise(text)
