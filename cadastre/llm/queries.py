"""The registered queries of this subpackage, and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from cadastre.llm.collocations import SQL as COLLOCATIONS_SQL
from cadastre.llm.collocations import collocations
from cadastre.llm.decontamination import contamination
from cadastre.llm.fingerprints import fingerprints
from cadastre.llm.forest import nearest
from cadastre.llm.jaccard import jaccard_join
from cadastre.llm.licences import licence_scan
from cadastre.llm.mixing import SQL as MIXING_SQL
from cadastre.llm.mixing import mix
from cadastre.llm.rtree import SQL as NEGATIVES_SQL
from cadastre.llm.rtree import hard_negatives
from cadastre.llm.secrets import secret_spans
from cadastre.llm.substrings import suffix_dedup, window_dedup
from cadastre.llm.tables import load
from cadastre.llm.tokens import read_tokens, write_tokens
from cadastre.llm.toxicity import CUT, held_out, train, with_toxicity


#: Tokenizer file of op1, and the id that ends a document.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END = 1


def tokenizer_spec(path: str = TOKENIZER) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(load(spark, sf_dir, "documents"), tokenizer_spec(), END))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(load(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scored = with_toxicity(docs.select("doc_id", "text", "lang"), train(docs, load(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "threshold")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_spans(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(load(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(load(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def file_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: folders by source, language and hundred; round numbers are licence files of folders."""
    i = F.col("doc_id")
    folders = (
        F.when(i % 5000 == 0, F.array("source"))
        .when(i % 1000 == 0, F.array("source", "lang"))
        .otherwise(F.array(F.col("source"), F.col("lang"), F.floor(i / 100).cast("string")))
    )
    name = F.when(i % 100 == 0, F.concat(F.lit("LICENSE-"), i.cast("string"))).otherwise(F.concat(i.cast("string"), F.lit(".txt")))
    return docs.withColumn("path", F.concat(F.lit("/"), F.array_join(F.concat(folders, F.array(name)), "/")))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(file_paths(load(spark, sf_dir, "documents")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = window_dedup(load(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(load(spark, sf_dir, "documents"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_decontamination": op2_decontamination,
    "op3_fingerprints": op3_fingerprints,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_secrets": op6_secrets,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_licences": op9_licences,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_collocations": op12_collocations,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}

ORACLES: dict[str, str] = {"op5_mixing": MIXING_SQL, "op11_hard_negatives": NEGATIVES_SQL, "op12_collocations": COLLOCATIONS_SQL}
