"""Operator 9: licence scan by TF-IDF cosine to templates, inherited along directories. Native."""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastre.llm.decontamination import lower_ascii
from cadastre.llm.tables import NO_KEY, written

#: Least cosine between a segment and a template.
SIMILAR = 0.6
#: Lines of the overlapping segments besides single lines and whole texts; each starts a quarter of its length after the last, the final one ends the text.
WINDOWS = (2, 3, 4, 6, 8, 12, 16, 24, 32)
#: Whole licences (NAME.txt) and standard headers (NAME.header.txt), read on the driver.
TEXTS = Path(__file__).parent / "licence_texts"
#: Taken only where no other licence is like the file: open licences say "All rights reserved" too.
LAST = "Proprietary"
#: Fixed texts: how common licences are announced.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "BSD-3-Clause": "Distributed under the BSD 3-Clause License.",
    "BSD-2-Clause": "Distributed under the BSD 2-Clause License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "Proprietary": "Copyright. All rights reserved.",
}
_BETWEEN = r"[^0-9a-z\x{80}-\x{10FFFF}]+"


def _terms(text) -> Column:
    return F.filter(F.split(lower_ascii(text), _BETWEEN), lambda w: w != "")


def all_texts() -> list[tuple[str, str]]:
    """(licence, text) of the announcements, headers and whole licences."""
    return [*TEMPLATES.items(), *((p.name.removesuffix(".txt").removesuffix(".header"), p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt")))]


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(model, template, terms) rows of the licence texts, by default all; a licence may have several models."""
    pairs = sorted(all_texts() if texts is None else texts.items())
    rows = spark.createDataFrame([(i, *pair) for i, pair in enumerate(pairs)], "model int, template string, text string")
    return rows.select("model", "template", _terms(F.col("text")).alias("terms"))


def least_share(similar: float) -> float:
    """Least ratio of the squared weights of template words to those of other words in a segment of that cosine.

    A cosine to a template is at most the segment's length over template words
    divided by its whole length.  The sum of the template words' weights, or more
    closely the squares of each word's weights together, bound the first from
    above; the number of other words times the square of their weight bounds the rest from below.
    """
    return similar * similar / max(1 - similar * similar, 1e-12) * (1 - 1e-9)


def _vectors(rows: DataFrame, idf: DataFrame, most: float, keys: list[str]) -> DataFrame:
    """(keys, term, weight, norm2): known terms with tf * idf, and the squared length over all terms."""
    known = rows.select(*keys, "terms", F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"), F.first(F.size("terms")).alias("n"))
    known = known.join(F.broadcast(idf), "term", "left")  # at most one row for each template term
    weight = F.col("tf") * F.coalesce("idf", F.lit(most))
    length = known.groupBy(*keys).agg(F.sum(weight * weight).alias("norm2"))
    return known.where("idf is not null").select(*keys, "term", weight.alias("weight")).join(length, keys)


def licence_scan(files: DataFrame, path: str = "path", text: str = "text", key: str = "doc_id", licence_file: str = r"(?i)(^|/)(licen[cs]e|copying)[^/]*$", texts: dict[str, str] | None = None, similar: float = SIMILAR) -> DataFrame:
    """(key, path, licence, origin, similarity) for each row of files.

    Segments are lines, overlapping runs of WINDOWS lines that aren't blank, and
    whole texts, all of at least two template words.  Those whose template
    words weigh too little to reach ``similar`` are left out before the vectors
    are formed.  Document frequencies of template terms count all lines
    of all files; a term in no template has the weight of one seen once.  A
    file's own licence is the template of greatest cosine, if at least
    ``similar`` (ties: the template's name; LAST only if there is no other).  A file without one inherits that
    of the licence file in its nearest ancestor directory that has one (several
    there: the least path, then key).  origin is own, inherited or null.  A
    null text has no lines, a null path no directory; a null key is kept;
    repeated rows each get a result.
    """
    spark = files.sparkSession
    rows = files.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("k"), F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    models = written(templates(spark, texts), "templates")
    vocabulary = sorted(r.term for r in models.select(F.explode("terms").alias("term")).distinct().collect())  # of the templates only
    listed = ", ".join(f"'{w}'" for w in vocabulary)
    lines = rows.select(F.explode(F.split("text", "\n")).alias("segment")).where("trim(segment) != ''").select(_terms(F.col("segment")).alias("terms"))
    counted = lines.select(F.explode(F.array_distinct(F.expr(f"concat(filter(terms, w -> w IN ({listed})), array(''))"))).alias("term")).groupBy("term").count()
    counted = {r.term: r["count"] for r in counted.collect()}  # a row for each template term, and the number of lines
    total = counted.get("", 0)
    weights = {w: math.log((total + 1) / (counted.get(w, 0) + 1)) for w in vocabulary}
    most = math.log((total + 1) / 2) if total else 0.0
    idf = spark.createDataFrame(list(weights.items()), "term string, idf double")

    # What may reach ``similar``: its template words must outweigh the others, whatever their repetitions.
    levels: dict[float, list[str]] = {}
    for w, x in weights.items():
        levels.setdefault(math.ceil(4 * max(x, 0)) / 4, []).append(f"'{w}'")
    weight = "CASE " + " ".join(f"WHEN w IN ({', '.join(own)}) THEN {level}D" for level, own in sorted(levels.items())) + " ELSE 0D END"
    known = f"filter(ws, w -> w IN ({listed}))"
    # Whole runs only: each WINDOWS length from every quarter of it, and at the end of the text.
    at = lambda w: f"transform(array_union(sequence(0, size(all) - {w}, {max(1, w // 4)}), array(size(all) - {w})), i -> struct({w} AS size, i AS line))"
    runs = ", ".join(["array(struct(size(all) AS size, 0 AS line))", *(f"if(size(all) > {w}, {at(w)}, array())" for w in (1, *WINDOWS))])
    sums = "aggregate(slice(stats, r.line + 1, r.size), struct(0D AS a, 0D AS b, 0 AS n, 0 AS m), (s, x) -> struct(s.a + x.a AS a, s.b + x.b AS b, s.n + x.n AS n, s.m + x.m AS m))"
    least = f"{least_share(similar) * most * most!r}D"
    # Squares of words' weights over several lines are at most the lines' own squares times their number.
    enough = f"exists(array({sums}), s -> s.n >= 2 AND least(s.a * s.a, r.size * s.b) >= {least} * (s.m - s.n))"
    # The same with each word's repetitions in the whole run, for what is left.
    squares = f"aggregate(array_distinct(q), 0D, (s, w) -> s + power(size(filter(q, v -> v = w)) * ({weight}), 2))"
    others = "aggregate(slice(stats, r.line + 1, r.size), 0, (s, x) -> s + x.m - x.n)"
    closer = f"exists(array(flatten(slice(own, r.line + 1, r.size))), q -> {squares} >= {least} * {others})"
    found = f"transform(filter(filter(concat({runs}), r -> {enough}), r -> {closer}), r -> struct(r.size, r.line, flatten(slice(all, r.line + 1, r.size)) AS terms))"
    # One nested expression: lambda variables are computed once, columns would be computed anew wherever they are named.
    line = squares.replace("array_distinct(q)", "array_distinct(ws)").replace("filter(q,", "filter(ws,")
    stats = f"transform(own, (ws, i) -> struct(aggregate(ws, 0D, (s, w) -> s + {weight}) AS a, {line} AS b, size(ws) AS n, size(all[i]) AS m))"
    with_stats = f"flatten(transform(filter(array(own), o -> aggregate(o, 0, (s, ws) -> s + size(ws)) >= 2), o -> element_at(transform(array({stats}), stats -> {found}), 1)))"
    with_own = f"flatten(transform(array(transform(all, ws -> {known})), own -> {with_stats}))"
    texts_of = rows.select("k", F.xxhash64("path", "text").alias("t"), F.filter(F.transform(F.split("text", "\n"), _terms), lambda x: F.size(x) > 0).alias("all"))
    scored = texts_of.select("k", "t", F.explode_outer(F.expr(with_own)).alias("r")).where("r is not null").select("k", "t", "r.size", "r.line", "r.terms").dropDuplicates(["k", "t", "size", "line"])
    segments = _vectors(written(scored, "segments"), idf, most, ["k", "t", "size", "line"])
    patterns = _vectors(models, idf, most, ["model", "template"]).select("model", "template", "term", F.col("weight").alias("w2"), F.col("norm2").alias("m2"))
    products = segments.join(F.broadcast(patterns), "term").groupBy("k", "t", "size", "line", "model", "template").agg((F.sum(F.col("weight") * F.col("w2")) / F.sqrt(F.first("norm2") * F.first("m2"))).alias("cosine"))
    products = products.withColumn("cosine", F.round("cosine", 9)).where(F.col("cosine") >= similar)
    own = products.groupBy("k", "t").agg(F.min(F.struct((F.col("template") == LAST).alias("last"), (-F.col("cosine")).alias("away"), "template")).alias("x")).select("k", "t", F.col("x.template").alias("own"), (-F.col("x.away")).alias("similarity"))

    named = rows.select("key", "k", "path", F.xxhash64("path", "text").alias("t")).join(own, ["k", "t"], "left")
    named = written(named, "named")
    folder = F.when(F.instr("path", "/") > 0, F.expr("substring_index(path, '/', -1)")).otherwise(F.col("path"))
    parent = F.expr("left(path, greatest(length(path) - length(substring_index(path, '/', -1)) - 1, 0))")
    granted = named.where(F.col("own").isNotNull() & folder.rlike(licence_file)).groupBy(parent.alias("folder")).agg(F.min(F.struct("path", "k", "own", "similarity")).alias("g"))
    granted = written(granted.select("folder", F.col("g.own").alias("grant"), F.col("g.similarity").alias("grant_similarity")), "granted")
    parts = F.split(parent, "/")
    above = named.where("own is null and path is not null").select("k", "t", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts")).distinct()
    above = above.select("k", "t", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("folder"))
    nearest = above.join(granted, "folder").groupBy("k", "t").agg(F.max(F.struct("depth", "grant", "grant_similarity")).alias("n"))
    out = named.join(nearest, ["k", "t"], "left")
    return out.select(
        F.col("key").alias(key), F.col("path").alias(path), F.coalesce("own", "n.grant").alias("licence"), F.when(F.col("own").isNotNull(), "own").when(F.col("n").isNotNull(), "inherited").alias("origin"), F.coalesce("similarity", "n.grant_similarity").alias("similarity")
    )
