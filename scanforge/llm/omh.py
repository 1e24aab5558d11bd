"""Op 10 - document fingerprints by Order MinHash, in DataFrame functions only.

A text's k-mers are runs of ``K`` words.  Each is numbered by its occurrence within the text, so repeats differ, and
hashed with its number.  Of the hashes in each of ``BINS`` bins the smallest stays, a sample that texts with common k-mers
share.  Under each of ``TUPLES`` further hash functions the two smallest k-mers of the sample are selected, put in the
order in which they stand in the text, and hashed together.  A tuple matches only if both texts hold its k-mers in the
same order, so the likeness of two fingerprints (equal tuples by tuples present in either) falls with edits and with
reordering.  A text of two k-mers has all its tuples.

The edited text shares its first three quarters with the text, so common k-mers are exploded once and marked as of
both.  Texts are shuffled once, by their key; k-mers are exploded, numbered by a window and aggregated within that
partitioning, without another exchange.  The order of documents comes from distributed ranks of a slim table.

A number holds a k-mer's hash (33 bits) and its place (31 bits, as many words as a text can have).

Defined results: a null text is empty; a text without words has no tuples, and two such texts have likeness 1; a text of
fewer than K words is one k-mer, whose tuples hold it alone; a null doc_id sorts first; rows that repeat both doc_id and
text are one document; an empty table gives an empty result.  Only doc_id and the text are read, so no name clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, pin, ranked

K, TUPLES, BINS = 3, 32, 64
BLANKS = r"[\x20\x09-\x0D]+"
PLACES = 31
#: Whose a k-mer is: of both texts, of the text alone, of the edited one alone; and the digest's digits.
BOTH, TEXT, EDITED, DIGEST = range(4)


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda x: x != "")


def kmers(own: Column, whole: Column) -> Column:
    """Hashes of the runs of K words; if ``whole``, of the sequence itself when it is shorter."""
    runs = F.transform(F.sequence(F.lit(1), F.size(own) - (K - 1)), lambda i: F.xxhash64(F.slice(own, i, K)))
    return F.when(F.size(own) >= K, runs).when(whole & (F.size(own) > 0), F.array(F.xxhash64(own))).otherwise(F.array().cast("array<bigint>"))


def name(x: Column) -> Column:
    return F.shiftright(x, PLACES)


def place(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << PLACES) - 1))


def numbered_hash(v: Column, at: Column) -> Column:
    """The upper bits of a hash with a place in the lower ones."""
    return v.bitwiseAND(F.lit(-(1 << PLACES))).bitwiseOR(at)


def tuples(sample: Column) -> Column:
    """32 bits for each of TUPLES hash functions, from the two smallest of the sample in text order; null without k-mers."""
    both = lambda x, y: F.xxhash64(name(x), name(y)).bitwiseAND(F.lit(0xFFFFFFFF))

    def hashed(s: Column) -> Column:
        x, y = F.get(s, F.lit(0)), F.get(s, F.lit(1))
        return F.when(F.size(s) == 1, F.xxhash64(name(x)).bitwiseAND(F.lit(0xFFFFFFFF))).when(place(y) < place(x), both(y, x)).otherwise(both(x, y))

    def all_of(s: Column) -> Column:
        mixed = lambda j: F.zip_with(s["n"], s["p"], lambda n, p: numbered_hash(F.xxhash64(n, j), p))
        least = F.transform(F.sequence(F.lit(1), F.lit(TUPLES)), lambda j: F.slice(F.sort_array(mixed(j)), 1, 2))
        return F.transform(least, lambda two: F.when(F.size(two) > 0, hashed(two)))

    # each step is bound to a variable, or it would be made again for every hash function
    parts = F.transform(F.array(sample), lambda s: F.struct(F.transform(s, name).alias("n"), F.transform(s, place).alias("p")))
    return F.get(F.transform(parts, all_of), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), x.eqNullSafe(y).cast("int")))
    known = F.filter(pairs, lambda x: x.isNotNull())
    hits = F.aggregate(known, F.lit(0), lambda n, x: n + x)
    return F.when(F.size(known) == 0, 1.0).otherwise(hits / F.greatest(F.size(known), F.lit(1)))


def say(tuples: Column) -> Column:
    """Eight hexadecimal digits a tuple, eight dashes for one without k-mers."""
    digits = lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")
    return F.concat_ws("", F.transform(tuples, lambda x: F.when(x.isNull(), "-" * 8).otherwise(digits(x))))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: its own fingerprint, its edited text's, and how like it is to that and to the next document's."""
    spark = docs.sparkSession
    key = ["k", "h"]
    whole = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("t"))
    base = whole.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.xxhash64("t").alias("h"), "t")
    slim = ranked(base.select("doc_id", *key, F.length("t").alias("n")).distinct(), [], [F.col("k"), F.col("h")], "rank")
    count = F.lit(max(slim.count(), 1))
    ahead = slim.select(F.col("k").alias("nk"), F.col("h").alias("nh"), F.pmod(F.col("rank") - 1, count).alias("rank"))
    plan = slim.join(ahead.hint("merge"), "rank").select(*key, "nk", "nh", F.floor(F.col("n") / 4).cast("int").alias("need"))
    # the texts, dealt once: both joins below read this exchange
    once = base.select(*key, "t").repartition(partitions(spark), *key).dropDuplicates(key)
    heads = once.select(F.col("k").alias("nk"), F.col("h").alias("nh"), "t").join(plan.hint("merge"), ["nk", "nh"]).select(*key, F.expr("substring(t, 1, need)").alias("q"), "need")
    own = once.join(heads.hint("merge"), key).withColumn("p", F.expr("substring(t, 1, length(t) - need)"))

    # words of the common part but for its last, which the edit may lengthen
    digest = F.sha2(F.concat("p", "q").cast("binary"), 256)
    parts = own.select(*key, words(F.col("t")).alias("w"), F.split(F.regexp_replace("p", f"^{BLANKS}", ""), BLANKS).alias("wp"), "q", digest.alias("s"))
    parts = parts.withColumn("c", F.size("wp") - 1).withColumn("low", F.greatest(F.lit(1), F.col("c") - (K - 2)))
    tail = words(F.concat(F.concat_ws(" ", F.slice("wp", F.col("low"), K)), "q"))
    parts = parts.select(*key, "w", "c", "s", tail.alias("e"), F.greatest(F.lit(0), F.col("c") - (K - 1)).alias("same"))
    row = lambda of, x, at: F.struct(of.alias("of"), x.alias("x"), at.alias("at"))
    mine = F.transform(kmers(F.col("w"), F.lit(True)), lambda x, i: row(F.when(i < F.col("same"), BOTH).otherwise(TEXT), x, i))
    edit = F.transform(kmers(F.col("e"), F.col("c") < K - 1), lambda x, i: row(F.lit(EDITED), x, F.col("same") + i))
    # the digest travels as eight numbers among the k-mers, so no wide column is sorted with them
    told = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: row(F.lit(DIGEST), F.conv(F.substring("s", i * 8 + 1, F.lit(8)), 16, 10).cast("long"), i))
    each = parts.select(*key, F.explode(F.concat(mine, edit, told)).alias("m")).select(*key, "m.*")
    so_far = Window.partitionBy(*key, "x").orderBy("at", "of").rowsBetween(Window.unboundedPreceding, 0)
    of = lambda *kinds: F.sum(F.when(F.col("of").isin(*kinds), 1).otherwise(0)).over(so_far)
    numbered = each.withColumn("v", F.xxhash64("x", F.when(F.col("of") == EDITED, of(BOTH, EDITED)).otherwise(of(BOTH, TEXT))))
    value = numbered_hash(F.col("v"), F.col("at").cast("long"))
    digits = F.col("of") == DIGEST
    bin_ = F.when(digits, BINS + F.col("at")).otherwise(F.pmod("v", F.lit(BINS))).cast("int")
    picked = numbered.select(*key, "of", bin_.alias("j"), F.when(digits, F.col("x")).otherwise(value).alias("y"))
    least = lambda other: F.min(F.when(F.col("of") != other, F.col("y")))
    chosen = picked.groupBy(*key, "j").agg(least(EDITED).alias("a"), least(TEXT).alias("b"))
    listed = chosen.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("j", "a", "b"))).alias("m"))
    sample = lambda side: F.filter(F.transform(F.filter("m", lambda x: x["j"] < BINS), lambda x: x[side]), lambda y: y.isNotNull())
    sampled = listed.select(*key, sample("a").alias("a"), sample("b").alias("b"), F.transform(F.filter("m", lambda x: x["j"] >= BINS), lambda x: x["a"]).alias("s"))
    prints = sampled.select(*key, tuples(F.col("a")).alias("a"), tuples(F.col("b")).alias("b"), "s")
    full = pin(prints.join(slim.hint("merge"), key), "prints")
    after = full.select(F.pmod(F.col("rank") - 1, count).alias("rank"), F.col("a").alias("z"))
    out = full.join(after.hint("merge"), "rank").select("doc_id", F.col("n").cast("long").alias("n_chars"), say(F.col("s")).alias("edited_sha256"), say(F.col("a")).alias("fingerprint"), say(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("z")).alias("near_next"))
    out._scanforge_path = full._scanforge_path
    return out
