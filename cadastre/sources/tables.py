"""Reading the given tables, and writing intermediate ones."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of the files that are read as one row; larger ones are read in pieces.
WHOLE = 1 << 27
#: Bytes of a piece of a larger file.
PIECE = 1 << 14


def file_fingerprints(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, size, modified, hash): every file under a path, subfolders too, with the SHA-256 of its bytes; ``pattern`` is a glob on names.

    A file of up to WHOLE bytes stands in one row of Spark's binary reader, a file at a time.  That reader can't
    read more than 2 GB, so larger files are read by Spark's text reader, in many tasks, as the bytes between line feeds; a SHA-256
    runs through its bytes in order, so their pieces are sorted by their place and hashed one after the other in one task.
    Only there, what lies between two line feeds must fit into a row, and files that the text reader would unpack by
    their name (.gz and the like) fail.  Spark's reader leaves out empty files; a folder without others gives no rows.
    """
    glob = {"pathGlobFilter": pattern} if pattern else {}
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, **glob).load(path)
    known = [F.col("_metadata.file_path").alias("file"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    hashes = files.where(F.col("length") <= WHOLE).select(*known[1:], F.sha2("content", 256).alias("hash"))
    large = files.where(F.col("length") > WHOLE).select(*known)
    if large.isEmpty():  # read from the files' listing, without their bytes
        return hashes
    lines = spark.read.options(recursiveFileLookup=True, lineSep="\n", **glob).text(path).where(F.col("_metadata.file_size") > WHOLE)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("bytes"))
    pieces = lines.mapInArrow(_pieces, "file string, size long, start long, piece long, bytes binary")
    found = pieces.repartition("file").sortWithinPartitions("file", "start", "piece").mapInArrow(_hashes, "file string, hash string")
    return hashes.unionByName(large.join(found, "file", "left").select(*hashes.columns))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, size, start, bytes) of blocks of files to numbered pieces of their bytes, line feeds put back behind each line."""
    held, place, number = [], None, 0

    def piece(rows: list[bytes]) -> pa.RecordBatch:
        data = b"".join(v + b"\n" for v in rows)
        cut = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        columns = [pa.array([v] * len(cut), t) for v, t in zip(place, (pa.string(), pa.int64(), pa.int64()), strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(range(number, number + len(cut)), pa.int64()), pa.array(cut, pa.binary())], names=["file", "size", "start", "piece", "bytes"])

    for batch in batches:
        at = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
        for k, line in enumerate(batch.column(3).to_pylist()):
            if at[k] != place:
                if held:
                    yield piece(held)
                held, place, number = [], at[k], 0
            held.append(line)
        if held:
            out = piece(held)
            number += out.num_rows
            held = []
            yield out


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, size, start, piece, bytes), sorted, to (file, hash).

    The text reader passes over a mark of UTF-8 at a file's beginning and doesn't tell whether a line feed is its last byte; the file's size tells both.
    """
    mark, file, size, seen, last, states = b"\xef\xbb\xbf", None, 0, 0, b"", ()

    def done() -> pa.RecordBatch:
        over = seen - size
        if over not in (0, 1, -len(mark), 1 - len(mark)):
            raise ValueError(f"{file} has {size} bytes, {seen} were read")
        state = states[over < 0]
        state.update(last if over in (0, -len(mark)) else last[:-1])
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([state.hexdigest()])], names=["file", "hash"])

    for batch in batches:
        for name, length, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True):
            if name != file:
                if file is not None:
                    yield done()
                file, size, seen, last, states = name, length, 0, b"", (hashlib.sha256(), hashlib.sha256(mark))
            for state in states:
                state.update(last)
            last, seen = data, seen + len(data)
    if file is not None:
        yield done()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a fresh local folder stands in where the setting is missing and all runs in one process."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/cadastre-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows written as Parquet at a fresh_path() and read back: cuts the lineage of loops."""
    spark, schema = df.sparkSession, df.schema
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.written_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing still to be computed reads; others are left alone."""
    for table in tables:
        if path := getattr(table, "written_path", None):
            where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
