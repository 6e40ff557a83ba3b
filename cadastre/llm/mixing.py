"""Operator 5: mixing sources to target weights by hash thresholds. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastre.llm.tables import spare, written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source or document is taken more often than this.
REPEATS = 3
#: Bits of the key hash, and of each histogram.
BITS, STEP = 60, 15


def size_of(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null and empty texts have none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def hash_of(key: Column) -> Column:
    """The first 60 bits of the key's md5: reruns and other engines agree."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target): the total shared by weight, each source at most ``repeats`` times its size.

    One row per source: sources are ordered by code point, null last; the level
    that fills the total is found along the sources by size for weight.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (order + 1).cast("int")).cast("long"))
    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum(repeats * F.col("source_size")).over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    place = F.row_number().over(by_fill)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    each = each.withColumn("place", place).withColumn("level", (F.sum("source_size").over(everything) - full) / open_weight)
    fits = F.when(F.col("level") * F.col("weight") <= repeats * F.col("source_size"), F.struct("place", "level"))
    each = each.withColumn("level", F.min(fits).over(everything)["level"])
    return each.select("source", "source_size", F.least((repeats * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _boundary(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, bound, below, within) for each goal: the hash at which the sources' words reach ``rest``.

    below: words under the hash; within: words at it.  Each step sums one
    histogram of the boundary bucket that the step before found.
    """
    found = goals.select("source", "rest", F.lit(0).cast("long").alias("bound"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("within"))
    for level in range(BITS // STEP):
        shift = BITS - STEP * (level + 1)
        bucket = F.shiftright("h", shift)
        if level:
            rows_now = rows.join(found.select(F.col("source").alias("s"), F.col("bound").alias("b")), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + STEP) == F.col("b")))
        else:
            rows_now = rows
        bars = rows_now.groupBy("source", bucket.alias("bar")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bar"))
        bars = bars.withColumn("upto", upto)
        old = found.select(F.col("source").alias("s"), "rest", F.col("below").alias("under"))
        crossed = bars.join(old, F.col("source").eqNullSafe(F.col("s"))).where(F.col("under") + F.col("upto") > F.col("rest"))
        crossed = crossed.groupBy("source", "rest", "under").agg(F.min(F.struct("bar", "upto", "words")).alias("x"))
        found = written(crossed.select("source", "rest", F.col("x.bar").alias("bound"), (F.col("under") + F.col("x.upto") - F.col("x.words")).alias("below"), F.col("x.words").alias("within")), "bounds")
    return found


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(key, source, size, source_size, target, taken): words that the mix takes of each document row.

    A source is taken whole as often as its target allows; of the rest, the
    documents under a hash threshold once more, and those exactly at it in
    part, so that a source misses its target by less than a word for each such
    document.  A null text has size 0; a null source is a source of its own; a
    null key hashes as the empty string.  Rows with one key have one hash and
    are taken alike.  Other columns are ignored; an empty table gives no rows.
    """
    sizes = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), hash_of(F.col(key)).alias("h"))
    sizes = written(sizes, "sizes")
    goal = targets(sizes, weights, repeats)
    quota = F.floor(F.col("target") + 1e-6)
    copies = F.when(F.col("source_size") > 0, F.floor(quota / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0)).cast("long")
    goal = written(goal.withColumn("copies", copies).withColumn("rest", quota - F.col("copies") * F.col("source_size")), "goals")
    bounds = _boundary(sizes, goal)
    plan = written(
        goal.alias("g").join(bounds.alias("b"), F.expr("g.source <=> b.source"), "left").selectExpr("g.source as s", "source_size", "target", "copies", "g.rest as rest", "bound", "below", "within"), "plan"
    )
    more = F.when(F.col("h") < F.col("bound"), F.col("size")).when((F.col("h") == F.col("bound")) & (F.col("within") > 0), F.expr("(size * (rest - below)) div within")).otherwise(F.lit(0))
    out = sizes.join(plan, F.col("source").eqNullSafe(F.col("s")))
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", (F.col("copies") * F.col("size") + more).cast("long").alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents' rows, repeated as often as the mix takes them; the row at the threshold only whole.

    A document taken k times and in part stands k times; one never taken whole
    is left out, one without words stands once.  Rows that share a key, or have
    none, are taken alike if they share source and size too.  Columns of any names are kept.
    """
    k, s, n, times, copy = spare(docs, "key", "from", "size", "times", "copy")
    took = mix(docs, key, text, source, **options).select(F.col(key).alias(k), F.col(source).alias(s), F.col("size").alias(n), F.expr("if(size = 0, 1, taken div size)").alias(times)).distinct()
    same = docs[key].eqNullSafe(F.col(k)) & docs[source].eqNullSafe(F.col(s)) & (size_of(docs[text]) == F.col(n))
    return docs.join(took, same).withColumn(copy, F.explode(F.expr(f"if({times} > 0, sequence(1L, {times}), cast(array() as array<bigint>))"))).select(*(docs[c] for c in docs.columns))


#: The same in DuckDB SQL, over documents.
SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
each AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM each),
levels AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed),
filled AS (SELECT *, (min(CASE WHEN level * weight <= 3 * source_size THEN {'place': place, 'level': level} END) OVER ())['level'] AS fill FROM levels),
goals AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, fill * weight) AS target FROM filled),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 1e-6)::BIGINT // source_size ELSE 0 END AS copies FROM goals),
ranked AS (
  SELECT s.doc_id, s.size, s.h, p.*, floor(p.target + 1e-6)::BIGINT - p.copies * p.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.h) AS within
  FROM sizes s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (copies * size + CASE WHEN upto <= rest THEN size WHEN upto - within < rest THEN (size * (rest - (upto - within))) // within ELSE 0 END)::BIGINT AS taken
FROM ranked
"""
