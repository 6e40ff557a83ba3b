"""Repeated word windows across documents, by counting the rolling hash of every window.

A task hashes every window of its documents (Rabin-Karp, 64-bit) and settles
what it can see itself: of windows with one hash in a group of its documents,
all but those of the smallest key start earlier elsewhere.  That is the
combining step of the count; a window that a third of all documents share
leaves a group once.  The others go, by the leading bits of their hash, to
cells of about ``CELL`` windows, where a task finds those that a smaller key
has too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.llm.arrow import byte_rows, ints, longs
from cadastre.llm.repeats import Windows

#: Windows that a task compares among its own documents at once; a single document may have more.
GROUP = 1 << 20
#: Bytes of text for each cell of hashes: about two million windows.
CELL = 12_000_000
#: Leading bits of a hash that make its cell, at least and at most: cells grow beyond 780 GB of text.
LEAST_BITS, MOST_BITS = 8, 16

_RANGES = "array<struct<a:int,n:int>>"


def _planes(values: np.ndarray) -> bytes:
    """First bytes of all values, then the second ones, and so on: what is small leaves planes of zeros, which the shuffle's compression removes."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _values(planes: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(size, len(planes) // size).T).view(kind).ravel()


def _packed(h: np.ndarray, k: np.ndarray, x: np.ndarray, at: np.ndarray) -> tuple[bytes, ...]:
    """Windows of a cell, sorted by document: hashes without their leading byte, which the cell has, and keys as steps."""
    return h.view(np.uint8).reshape(len(h), 8)[:, :7].tobytes(), _planes(np.diff(k, prepend=0)), _planes(np.diff(x, prepend=0)), _planes(at)


def _unpacked(lead: int, h: bytes, k: bytes, x: bytes, at: bytes) -> tuple[np.ndarray, ...]:
    whole = np.full((len(h) // 7, 8), lead, dtype=np.uint8)
    whole[:, :7] = np.frombuffer(h, dtype=np.uint8).reshape(-1, 7)
    return whole.view(np.uint64).ravel(), np.cumsum(_values(k, np.int64)), np.cumsum(_values(x, np.int64)), _values(at, np.int32)


def _runs(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """First entry of each document, and its runs of following positions, of windows sorted by document and position."""
    first = np.flatnonzero(np.append(True, (np.diff(pos) != 1) | (np.diff(doc) != 0)))
    n = np.diff(np.append(first, len(pos)))
    heads = np.flatnonzero(np.append(True, np.diff(doc[first]) != 0))
    runs = pa.StructArray.from_arrays([ints(pos[first]), ints(n)], names=["a", "n"])
    return first[heads], pa.ListArray.from_arrays(pa.array(np.append(heads, len(first)).astype(np.int32)), runs)


def _later(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Which windows have the hash of a window of a smaller key."""
    order = np.argsort(h, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(h[order].view(np.int64)) != 0))
    least = np.minimum.reduceat(k[order], starts)
    out = np.empty(len(h), dtype=bool)
    out[order] = k[order] > np.repeat(least, np.diff(np.append(starts, len(h))))
    return out


def _hashed(windows: Windows, bits: int, group: int):
    """(k, x, text) to settled windows (k, x, ranges) and open ones by cell."""
    nothing = lambda n: [pa.nulls(n, pa.binary())] * 4
    names = ["cell", "h", "ks", "xs", "at", "k", "x", "ranges"]

    def settle(docs: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        docs.sort(key=lambda d: d[:2])
        sizes = [len(h) for *_, h in docs]
        h, doc = np.concatenate([h for *_, h in docs]), np.repeat(np.arange(len(docs)), sizes)
        keys, others = np.array([k for k, *_ in docs], dtype=np.int64), np.array([x for _, x, _ in docs], dtype=np.int64)
        pos = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        later = _later(h, keys[doc])
        hit, rest = np.flatnonzero(later), np.flatnonzero(~later)
        if len(hit):
            first, ranges = _runs(doc[hit], pos[hit])
            of = doc[hit][first]
            cell = ints(of % (1 << bits))
            yield pa.RecordBatch.from_arrays([cell, *nothing(len(of)), longs(keys[of]), longs(others[of]), ranges], names=names)
        cell = (h[rest] >> np.uint64(64 - bits)).astype(np.int32)
        order = np.argsort(cell, kind="stable")
        rest, cell = rest[order], cell[order]
        starts = np.flatnonzero(np.append(True, np.diff(cell) != 0))
        n, columns = len(starts), (h[rest], keys[doc[rest]], others[doc[rest]], pos[rest])
        rows = [_packed(*(c[i:j] for c in columns)) for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(rest)], strict=True)]
        values = [pa.array(v, type=pa.binary()) for v in zip(*rows, strict=True)]
        yield pa.RecordBatch.from_arrays([ints(cell[starts]), *values, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.struct([("a", pa.int32()), ("n", pa.int32())])))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        waiting = 0
        for batch in batches:
            keys, others = (batch.column(i).to_pylist() for i in (0, 1))
            for k, x, data in zip(keys, others, byte_rows(batch.column(2)), strict=True):
                if len(data) < windows.size:
                    continue
                h = windows.every(data)
                if len(h):
                    held.append((k, x, h))
                    waiting += len(h)
                if waiting >= group:
                    yield from settle(held)
                    held, waiting = [], 0
        if held:
            yield from settle(held)

    return run


def _counted(bits: int):
    """Rows sorted by cell: settled windows as they are, open ones that a smaller key of their cell has."""

    def flush(cell: int, rows: list[tuple[bytes, ...]]) -> Iterator[pa.RecordBatch]:
        h, k, x, at = (np.concatenate(v) for v in zip(*(_unpacked(cell >> (bits - 8), *r) for r in rows), strict=True))
        hit = np.flatnonzero(_later(h, k))
        if len(hit):
            hit = hit[np.lexsort((at[hit], x[hit], k[hit]))]
            k, x, at = k[hit], x[hit], at[hit]
            doc = np.cumsum(np.append(0, (np.diff(k) != 0) | (np.diff(x) != 0)))
            first, ranges = _runs(doc, at)
            yield pa.RecordBatch.from_arrays([longs(k[first]), longs(x[first]), ranges], names=["k", "x", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, ...]] = []
        now = None
        for batch in batches:
            settled = batch.filter(batch.column(1).is_null())
            if settled.num_rows:
                yield settled.select(["k", "x", "ranges"])
            unsettled = batch.filter(batch.column(1).is_valid())
            for cell, *row in zip(*(unsettled.column(i).to_pylist() for i in range(5)), strict=True):
                if held and cell != now:
                    yield from flush(now, held)
                    held = []
                now = cell
                held.append(tuple(row))
        if held:
            yield from flush(now, held)

    return run


def counted_windows(texts: DataFrame, windows: Windows, group: int = GROUP) -> DataFrame:
    """Windows of (k, x, text) rows that a smaller key has too: (k, x, ranges array<struct<a, n>>).

    A range is n consecutive windows, the first starting at symbol a; documents
    without such a window have no row.  A document is a pair (k, x), of one text.
    """
    if windows.within:
        raise ValueError("only windows of smaller keys are counted")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(size / CELL) + 1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bits = min(MOST_BITS, max(LEAST_BITS, (parts - 1).bit_length()))
    rows = texts.mapInArrow(_hashed(windows, bits, group), f"cell int, h binary, ks binary, xs binary, at binary, k long, x long, ranges {_RANGES}")
    found = rows.repartition(min(parts, 1 << bits), "cell").sortWithinPartitions("cell").mapInArrow(_counted(bits), f"k long, x long, ranges {_RANGES}")
    return found.groupBy("k", "x").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
