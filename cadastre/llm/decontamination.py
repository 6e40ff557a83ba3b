"""Operator 2: benchmark decontamination by a hash set of normalised word windows. Native."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.llm.tables import NO_KEY, spare, written

SIZE = 10
#: Runs of bytes that separate words of a lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bounds of the broadcast hash set; a larger benchmark takes a shuffled join instead.
SET_MOST, SET_BYTES = 50_000, 32 << 20


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    """Normalised words; none for a null or empty text."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(window, width, item) rows, distinct; an item of fewer words than ``size``, but not none, is one window."""
    rows = benchmark.select(F.col(item).alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("width", F.least(F.size("w"), F.lit(size)))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("width") + 1))
    rows = rows.select("item", "w", "width", at.alias("at"))
    return rows.select(F.array_join(F.slice("w", F.col("at"), F.col("width")), " ").alias("window"), "width", "item").distinct()


def _hash(words: str, at: str, width: int) -> str:
    return f"xxhash64(slice({words}, {at}, {width}))"


def hits(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """(k, t, at, width, window) for each occurrence of a window in the rows (k, t, w)."""
    distinct = windows.select("window", "width").distinct()
    widths = sorted(r.width for r in distinct.select("width").distinct().collect())  # at most SIZE
    count, size = distinct.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()
    hashed = distinct.select("width", F.xxhash64(F.split("window", " ")).alias("h")).distinct()
    small = count <= SET_MOST and size <= SET_BYTES
    if small:
        held = {width: [] for width in widths}
        for r in hashed.collect():
            held[r.width].append(f"{r.h}L" if r.h != NO_KEY else "bigint(-9223372036854775808)")
        found = [f"filter(if(size(w) >= {n}, sequence(1, size(w) - {n} + 1), cast(array() as array<int>)), i -> {_hash('w', 'i', n)} IN ({', '.join(held[n])}))" for n in widths]
        placed = texts
        for n, where in zip(widths, found, strict=True):
            placed = placed.withColumn(f"at{n}", F.expr(where))
    else:
        placed = texts
        for n in widths:
            starts = F.expr(f"explode(if(size(w) >= {n}, transform(sequence(1, size(w) - {n} + 1), i -> struct(i, {_hash('w', 'i', n)} as h)), null))").alias("x")
            rows = texts.select("k", "t", starts).select("k", "t", F.col("x.i").alias("i"), F.col("x.h").alias("h"))
            own = rows.join(hashed.where(F.col("width") == n).select("h"), "h").groupBy("k", "t").agg(F.collect_set("i").alias(f"at{n}"))
            placed = placed.join(own, ["k", "t"], "left")
    cut = ", ".join(f"transform(coalesce(at{n}, cast(array() as array<int>)), i -> struct(i as at, {n} as width, array_join(slice(w, i, {n}), ' ') as window))" for n in widths)
    if not widths:
        return texts.sparkSession.createDataFrame([], "k long, t long, at int, width int, window string")
    rows = placed.select("k", "t", F.explode(F.expr(f"concat({cut})")).alias("x")).select("k", "t", "x.*")
    return rows.join(F.broadcast(distinct) if small else distinct, ["window", "width"], "left_semi")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = SIZE) -> DataFrame:
    """(key, n_words, n_hit, n_items, items array<string>, runs, contaminated): a row per document row.

    n_hit: words inside any occurrence of a window; items: ids with occurring
    windows, sorted as strings; runs: the hit words as maximal (from, until)
    positions, counted from 1, until exclusive.  A null or empty text has no
    words and no hits; items without words match nothing; a null item id has
    windows but no place among the items.  A null key is kept.  Repeated rows
    each get the same result.  Other columns are ignored.  An empty benchmark
    leaves all documents clean.
    """
    windows = written(item_windows(benchmark, item, item_text, size), "windows")
    base = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("k"), F.xxhash64(F.col(text)).alias("t"), words_of(F.col(text)).alias("w"))
    hit = written(hits(base, windows).distinct(), "hits")
    spans = F.sort_array(F.collect_list(F.struct(F.col("at").alias("from"), (F.col("at") + F.col("width")).alias("until"))))
    merged = F.expr(
        "aggregate(spans, cast(array() as array<struct<from:int, until:int>>), (done, s) -> if(size(done) > 0 and s.from <= element_at(done, -1).until,"
        " concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).from as from, greatest(element_at(done, -1).until, s.until) as until))), concat(done, array(s))))"
    )
    runs = hit.groupBy("k", "t").agg(spans.alias("spans")).select("k", "t", merged.alias("runs"))
    seen = hit.select("k", "t", "window").distinct().join(windows.select("window", "item"), "window").where("item is not null").select("k", "t", F.col("item").cast("string").alias("item")).distinct()
    items = seen.groupBy("k", "t").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = written(base.select("key", "k", "t", F.size("w").cast("long").alias("n_words")), "base").join(runs, ["k", "t"], "left").join(items, ["k", "t"], "left")
    return out.select(
        F.col("key").alias(key),
        "n_words",
        F.expr("aggregate(coalesce(runs, array()), 0L, (n, r) -> n + r.until - r.from)").alias("n_hit"),
        F.size(F.coalesce("items", F.array().cast("array<string>"))).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("runs", F.expr("cast(array() as array<struct<from:int, until:int>>)")).alias("runs"),
        F.col("runs").isNotNull().alias("contaminated"),
        "t",
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", spans: bool = False, **options) -> DataFrame:
    """The documents' own columns without contaminated rows, or with the hit words cut out (``spans``).

    A null or empty text holds nothing and stays; rows without a key, repeated
    ones, and rows that share a key are judged each by its text.  An empty
    benchmark changes nothing.  Columns of any names are kept.
    """
    k, t, runs, words, gaps = spare(docs, "key", "hash", "runs", "words", "gaps")
    found = contamination(docs, benchmark, key, text, **options).where("contaminated").select(F.col(key).alias(k), F.col("t").alias(t), F.col("runs").alias(runs)).distinct()
    same = docs[key].eqNullSafe(F.col(k)) & (F.xxhash64(docs[text]) == F.col(t))
    if not spans:
        return docs.join(found, same, "left_anti")
    joined = docs.join(found, same, "left").drop(k, t)
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    joined = joined.withColumn(words, F.regexp_extract_all(text, F.lit(word), F.lit(0))).withColumn(gaps, F.split(text, word, -1))
    kept = F.expr(f"array_join(transform({gaps}, (g, i) -> concat(g, if(i >= size({words}) or exists({runs}, r -> i + 1 >= r.from and i + 1 < r.until), '', get({words}, i)))), '')")
    return joined.withColumn(text, F.when(F.col(runs).isNull(), F.col(text)).otherwise(kept)).select(docs.columns)
