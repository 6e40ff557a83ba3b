"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a fresh local folder only where it is unset and all runs in one process (tests)."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/cadastre-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write the rows as Parquet in the shared folder and read them back.

    Cuts the lineage so that a lost executor costs one read.  The shuffles
    behind the table are of no more use; a collection on the driver lets
    Spark's cleaner delete their files.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.written_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete written() tables that nothing still to be computed reads."""
    for table in tables:
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(table.written_path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stands for a null key, so that such rows sort first and join with themselves.
NO_KEY = -(2**63)


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Just (k, text): the key with null as NO_KEY, and the text with null as empty."""
    return docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("k"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def identified(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, x, text): as keyed(), with x telling apart the texts of a key that has several (their hash; 0 where a key has one)."""
    rows = keyed(docs, key, text)
    texts = rows.select("k", F.xxhash64("text").alias("x")).groupBy("k").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    several = written(texts.where("lo != hi").select("k", F.lit(True).alias("several")), "shared-keys")
    return rows.join(several, "k", "left").select("k", F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("x"), "text")


def row_identity(key: Column, text: Column) -> tuple[Column, Column]:
    """(k, x) of a row as keyed() and the hash of its text have them: tells rows apart that share a key."""
    return F.coalesce(key.cast("long"), F.lit(NO_KEY)), F.xxhash64(F.coalesce(text, F.lit("")))


def spare(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be no column of docs, in any case."""
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        return name if name.lower() not in taken else free(f"_{name}")

    return [free(n) for n in names]


def unkeyed(column: str = "k"):
    """The key back from keyed(): NO_KEY becomes null."""
    return F.when(F.col(column) != NO_KEY, F.col(column))
