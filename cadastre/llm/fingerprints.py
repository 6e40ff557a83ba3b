"""Operator 3: threshold-scaled document fingerprints. Native.

A sketch keeps every shingle hash below a fixed fraction of the hash range, and
the FLOOR least hashes where those are fewer.  Two sketches are compared below
the lower of their limits, where both are complete: the estimate is unbiased
for texts of any sizes, and sketches of parts merge into one of the whole,
complete up to the lower of their limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastre.llm.tables import keyed, unkeyed

WIDTH = 5
#: Hashes are 63-bit; those below 1/8 of the range are kept.
FRACTION = 8
LIMIT = (1 << 63) // FRACTION
FLOOR = 64
_ALL = (1 << 63) - 1


def sketch(text: Column) -> Column:
    """struct<h array<long> sorted, upto long>: kept hashes, and the limit up to which they are complete.

    Shingles are 5 words [^\\x20\\x09-\\x0D]+; fewer words are one shingle.  Null and empty texts have none.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    last = lambda w: F.greatest(F.size(w) - WIDTH + 1, F.lit(1))
    hashes = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), last(w)), lambda i: F.xxhash64(F.slice(w, i, WIDTH)).bitwiseAND(F.lit(_ALL)))).otherwise(F.array().cast("array<bigint>")))
    kept = lambda h: F.array_distinct(F.filter(h, lambda x: x < LIMIT))
    least = lambda h: F.slice(F.array_sort(F.array_distinct(h)), 1, FLOOR)

    def both(h: Column) -> Column:
        return F.transform(F.array(kept(h)), lambda low: F.when(F.size(low) >= FLOOR, F.struct(F.sort_array(low).alias("h"), F.lit(LIMIT).alias("upto"))).otherwise(few(h)))

    def few(h: Column) -> Column:
        return F.element_at(F.transform(F.array(least(h)), lambda x: F.struct(x.alias("h"), F.when(F.size(x) < FLOOR, F.lit(_ALL)).otherwise(F.element_at(x, -1)).alias("upto"))), 1)

    return F.element_at(F.element_at(F.transform(hashes, both), 1), 1)


def fingerprint(s: Column) -> Column:
    """The sketch as text: its limit and its hashes, in hexadecimal."""
    return F.concat_ws(":", F.hex(s["upto"]), F.array_join(F.transform(s["h"], F.hex), ","))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity from two sketches, 0 to 1; two texts without words are alike."""
    upto = F.least(a["upto"], b["upto"])
    x, y = F.filter(a["h"], lambda v: v <= upto), F.filter(b["h"], lambda v: v <= upto)
    common, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(either == 0, F.lit(1.0)).otherwise(common / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated part of a's shingles that b has too; 1 if a has none."""
    upto = F.least(a["upto"], b["upto"])
    x, y = F.filter(a["h"], lambda v: v <= upto), F.filter(b["h"], lambda v: v <= upto)
    return F.when(F.size(x) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    upto = F.least(a["upto"], b["upto"])
    return F.struct(F.array_sort(F.filter(F.array_union(a["h"], b["h"]), lambda v: v <= upto)).alias("h"), upto.alias("upto"))


def _bucket(bounds: list[int]) -> Column:
    """Range of (k, x) by the bounds of k; a key that is a bound several times is split as often by x."""
    if not bounds:
        return F.lit(0)
    listed = F.array(*map(F.lit, bounds))
    share = F.col("x") / F.lit(2.0**64) + 0.5
    return F.size(F.filter(listed, lambda b: b < F.col("k"))) + F.floor(F.least(share, F.lit(1 - 1e-9)) * F.greatest(F.size(F.filter(listed, lambda b: b == F.col("k"))), F.lit(1))).cast("int")


def with_next(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows (k, x, text) with ``next``: the text of the row after it by (k, x); after the last comes the first.

    Rows go to ranges of the order, and each range looks up the first row of
    the next one that has rows: one key for each range passes the driver.
    """
    bounds = rows.agg(F.percentile_approx("k", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] if buckets > 1 else []
    ranged = rows.withColumn("bucket", _bucket(sorted(bounds or [])))
    firsts = sorted((r.bucket, r.m.k, r.m.x) for r in ranged.groupBy("bucket").agg(F.min(F.struct("k", "x")).alias("m")).collect())
    heads = rows.sparkSession.createDataFrame([(b, *firsts[(i + 1) % len(firsts)][1:]) for i, (b, *_) in enumerate(firsts)], "bucket int, k long, x long")
    after = rows.join(F.broadcast(heads), ["k", "x"]).dropDuplicates(["bucket"]).select("bucket", F.col("text").alias("after"))
    own = ranged.withColumn("next", F.lead("text").over(Window.partitionBy("bucket").orderBy("k", "x")))
    return own.join(after, "bucket").withColumn("next", F.coalesce("next", "after")).drop("bucket", "after")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    The edited text replaces the last quarter of the code points by the first
    as many of the next document.  A null text is empty; a null key comes
    first; rows with one key follow each other by the hash of their text, and
    repeated rows one after the other.  A table of one row is its own next.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = keyed(docs, key, text).select("k", F.xxhash64("text").alias("x"), "text")
    rows = with_next(rows, buckets or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next"), F.lit(1), quarter))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("k", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *[sketch(F.col(c)).alias(s) for c, s in (("text", "s"), ("edited", "e"), ("next", "t"))])
    s, e, t = F.col("s"), F.col("e"), F.col("t")
    return rows.select(unkeyed().alias(key), "n_chars", "edited_sha256", fingerprint(s).alias("fingerprint"), fingerprint(e).alias("edited_fingerprint"), likeness(s, e).alias("near_edited"), likeness(s, t).alias("near_next"))
