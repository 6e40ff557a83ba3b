"""Deed-corpus operators: normalised duplicates, statistics, splits, completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_hash(text: Column) -> Column:
    """SHA-256 of the text with each run of white space as one space."""
    return F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")).cast("binary"), 256)


def dedupe_corpus(docs: DataFrame) -> DataFrame:
    """(hash, doc_id, copies): the first document of each normalised text. Aggregated map-side, without texts."""
    return docs.groupBy(text_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    first = dedupe_corpus(docs)
    return first.agg(F.sum("copies").alias("total"), F.count("*").alias("kept"), F.sum(F.col("copies") - 1).alias("duplicates"))


def split_of(hash_hex: Column, train: int = 80, val: int = 10) -> Column:
    """train, val or test by the hash: reruns and additions leave a text where it was."""
    bucket = F.conv(F.substring(hash_hex, 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < train, "train").when(bucket < train + val, "val").otherwise("test")
