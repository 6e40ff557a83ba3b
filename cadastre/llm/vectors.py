"""Vectors as packed rows, and pages of them that meet the questions asked of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one Arrow batch of questions at most, so that a block of scores stays small.
BLOCK = 2048


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are numbers."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def padded(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows with vectors of one length, shorter ones ended by zeros (which change no product), and that length."""
    width = rows.agg(F.max(F.size(vector))).first()[0] or 1
    return rows.withColumn(vector, F.concat(F.col(vector).cast("array<double>"), F.array_repeat(F.lit(0.0), F.lit(width) - F.size(vector)))), width


def binary(matrix: np.ndarray) -> pa.Array:
    """A binary column of a matrix's rows."""
    rows, width = matrix.shape[0], matrix.shape[1] * matrix.dtype.itemsize
    offsets = np.arange(rows + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix).tobytes())]).cast(pa.binary())


def matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """The rows of a binary column as a matrix."""
    size = width * np.dtype(kind).itemsize
    if not len(column) or not size:
        return np.zeros((len(column), width), dtype=kind)
    first = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8, count=len(column) * size, offset=int(first)).view(kind).reshape(len(column), width)


def listed(column: pa.Array, width: int) -> np.ndarray:
    """A list column of vectors of one length as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), width)


def packed(rows: DataFrame, width: int, kind: str) -> DataFrame:
    """(k, x, v): v, of type array<double>, as bytes of numbers of that kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["k"], b["x"], binary(listed(b["v"], width).astype(kind))], ["k", "x", "v"])

    return rows.select("k", "x", "v").mapInArrow(run, "k long, x long, v binary")


Answer = Callable[[pa.RecordBatch, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def meet(pages: DataFrame, questions: DataFrame, answer: Answer, schema: str) -> DataFrame:
    """Questions (cell, k, x, v, a), a of any type, put to the rows (cell, k, x, v) of their cell.

    Both are dealt by cell and sorted, rows before questions; a task holds the
    rows of one cell, whose number the caller bounds, and a block of questions.
    """
    fields = ["cell", "kind", "k", "x", "v", "a"]
    rows = pages.select("cell", F.lit(0).alias("kind"), "k", "x", "v", F.lit(None).cast(questions.schema["a"].dataType).alias("a"))
    asked = questions.select("cell", F.lit(1).alias("kind"), "k", "x", "v", "a")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
        for batch in batches:
            cell, kind = batch["cell"].to_numpy(), batch["kind"].to_numpy()
            ends = [*(np.flatnonzero((np.diff(cell) != 0) | (np.diff(kind) != 0)) + 1), len(cell)]
            for at, end in zip([0, *ends[:-1]], ends, strict=True):
                for low in range(at, end, BLOCK):
                    yield int(cell[low]), int(kind[low]), batch.slice(low, min(end, low + BLOCK) - low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = parts(b for b in batches if b.num_rows)
        held: list[pa.RecordBatch] = []
        at, blocks = None, []

        def asks(first: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal blocks
            yield first
            for part in stream:
                if part[:2] != (at, 1):
                    blocks = [part]
                    return
                yield part[2]

        while True:
            part = blocks.pop() if blocks else next(stream, None)
            if part is None:
                return
            cell, kind, block = part
            if kind == 0:
                held = [*(held if cell == at else []), block]
                at = cell
                continue
            if cell != at:
                held, at = [], cell
            page = pa.Table.from_batches(held, block.schema).combine_chunks().to_batches() if held else []
            todo = asks(block)
            if page:
                yield from answer(page[0], todo)
            for _ in todo:  # what an answer left unread
                pass
            held = []

    return rows.unionByName(asked).select(fields).repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(run, schema)
