"""A training-data pipeline over the documents table, stage by stage.

Each stage works on all rows that the one before it kept.  All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadastre.llm.decontamination import decontaminated
from cadastre.llm.jaccard import without_near_duplicates
from cadastre.llm.mixing import mixed
from cadastre.llm.queries import END, tokenizer_spec
from cadastre.llm.tables import load, spare, written
from cadastre.llm.tokens import read_tokens, write_tokens
from cadastre.llm.toxicity import train, with_toxicity


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects at their language's threshold.

    A null or empty text has the score of no words; every row is judged by its
    own text, repeated keys too.  Without labels of both kinds nothing is dropped.
    """
    model = train(docs, load(spark, sf_dir, "labels"))
    score, threshold = spare(docs, "score", "threshold")
    return with_toxicity(docs, model, score=score, threshold=threshold).where(f"{score} < {threshold}").select(docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the smallest key."""
    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item; null and empty texts hold none."""
    return decontaminated(docs, load(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources come near their target weights; a null source is one of its own, documents without words stay."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards; returns what they hold for each document, repeated ones each; a null text is its end id alone."""
    return read_tokens(write_tokens(docs, tokenizer_spec(), END))


STAGES = [("toxicity", clean), ("near_duplicates", distinct), ("decontamination", decontaminate), ("mixing", mix), ("tokens", tokens)]

#: A trained classifier and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
