"""Repeated windows across documents, found through content-defined phrases.

A rolling hash picks a trigger in every window of the text; the windows that
share a trigger form a phrase (hashing.anchors).  Equal windows always have
equal triggers, so

1. phrases whose trigger occurs once cannot hold a repeated window;
2. a phrase (equal content) that occurred earlier is covered whole;
3. what is left is windows that distinct phrases with one trigger share.  The
   phrase dictionary holds each phrase once, so only few windows have to be
   hashed and compared singly.

Rows shuffled are phrases (about 2 for every window length of text), never
windows or texts of the whole corpus.  A trigger with very many distinct
phrases goes through an ordinary aggregation by window hash instead of one
task's memory.  Hashes are 64-bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.llm import hashing
from cadastre.llm.arrow import byte_rows, ints, longs
from cadastre.llm.tables import drop, written

#: A trigger with more distinct phrases than this is compared by rows, not in a task's memory.
LIGHT = 4096
#: Windows that a task compares at once, if no single trigger has more.
CHUNK = 1_000_000


@dataclass(frozen=True)
class Windows:
    """What a window is: its unit (bytes or words), length, and trigger length.

    ``within``: an earlier start in the same document counts too.
    """

    unit: str
    size: int
    gram: int
    within: bool

    def symbols(self, data: np.ndarray) -> np.ndarray:
        return hashing.byte_symbols(data) if self.unit == "bytes" else hashing.word_symbols(data)[0]

    def every(self, data: np.ndarray) -> np.ndarray:
        """Hashes of all windows of a text, by start."""
        return hashing.window_hashes(self.symbols(data), self.size)

    def payload(self, data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """What the window hashes of phrases are made from later: their bytes, or the hashes themselves."""
        if self.unit == "bytes":
            return [data[a : a + n - 1 + self.size].tobytes() for a, n in zip(starts, counts, strict=True)]
        hashes = hashing.window_hashes(self.symbols(data), self.size)
        return [hashes[a : a + n].tobytes() for a, n in zip(starts, counts, strict=True)]

    def hashes(self, payload: np.ndarray) -> np.ndarray:
        if self.unit == "bytes":
            return hashing.window_hashes(hashing.byte_symbols(payload), self.size)
        return np.frombuffer(payload.tobytes(), dtype=np.uint64)


def _phrases(windows: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, parts = [], [], []
            for row, data in enumerate(byte_rows(batch.column(2))):
                if len(data) < windows.size:
                    continue
                found = hashing.anchors(windows.symbols(data), windows.gram, windows.size)
                if len(found[0]):
                    rows.append(row), sizes.append(len(found[0])), parts.append(found)
            if parts:
                g, c, a, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                of = np.repeat(rows, sizes)
                k, x = (batch.column(i).to_numpy()[of] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([longs(g), longs(c), longs(k), longs(x), ints(a), ints(n)], names=["g", "c", "k", "x", "a", "n"])

    return run


def _cut_out(windows: Windows):
    """(k, x, text, parts) to one row for each part, with its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(3)
            flat, rows = parts.flatten(), np.diff(parts.offsets.to_numpy())
            at, a, n = 0, flat.field("a").to_numpy(), flat.field("n").to_numpy()
            payloads: list[bytes] = []
            for data, count in zip(byte_rows(batch.column(2)), rows, strict=True):
                payloads += windows.payload(data, a[at : at + count], n[at : at + count])
                at += count
            key, other = (np.repeat(batch.column(i).to_numpy(), rows) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [flat.field("g"), flat.field("heavy"), longs(key), longs(other), ints(a), pa.array(payloads, type=pa.binary())],
                names=["g", "heavy", "k", "x", "a", "payload"],
            )

    return run


def _shared_runs(windows: Windows, keys: np.ndarray, others: np.ndarray, starts: np.ndarray, hashes: list[np.ndarray]) -> tuple[np.ndarray, ...] | None:
    """Runs (k, x, a, n) of windows that started earlier, among phrases all of which are here."""
    if not hashes:
        return None
    sizes = [len(h) for h in hashes]
    h, phrase = np.concatenate(hashes), np.repeat(np.arange(len(sizes)), sizes)
    key, other = np.repeat(keys, sizes), np.repeat(others, sizes)
    pos = np.concatenate([a + np.arange(n) for a, n in zip(starts, sizes, strict=True)])
    order = np.lexsort((pos, other, key, h))
    hs, ks, xs, ps = h[order], key[order], other[order], pos[order]
    head = np.append(True, hs[1:] != hs[:-1])
    first = np.maximum.accumulate(np.where(head, np.arange(len(hs)), 0))
    later = ks > ks[first]
    if windows.within:
        later |= (xs > xs[first]) | ((xs == xs[first]) & (ps > ps[first]))
    mark = np.zeros(len(h), dtype=bool)
    mark[order] = later
    hit = np.flatnonzero(mark)
    if len(hit) == 0:
        return None
    new = np.append(True, (np.diff(hit) != 1) | (np.diff(phrase[hit]) != 0))
    begin = hit[new]
    return key[begin], other[begin], pos[begin], np.diff(np.append(np.flatnonzero(new), len(hit)))


def _compare(windows: Windows):
    """Rows (g, k, x, a, payload) sorted by trigger; phrases with one trigger stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        waiting = 0

        def flush(rows):
            k, x, a = (np.concatenate([r[i] for r in rows]) for i in (1, 2, 3))
            out = _shared_runs(windows, k, x, a, [h for r in rows for h in r[4]])
            if out is not None:
                k, x, a, n = out
                yield pa.RecordBatch.from_arrays([longs(k), longs(x), ints(a), ints(n)], names=["k", "x", "a", "n"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            g, k, x, a = (batch.column(i).to_numpy() for i in range(4))
            hashes = [windows.hashes(p) for p in byte_rows(batch.column(4))]
            last = int(np.searchsorted(g, g[-1]))  # the last trigger may go on in the next batch
            if held and last == 0 and held[-1][0][-1] != g[0]:
                yield from flush(held)
                held, waiting = [], 0
            held.append((g[:last], k[:last], x[:last], a[:last], hashes[:last]))
            waiting += sum(map(len, hashes))
            if waiting >= CHUNK and last:
                yield from flush(held)
                held, waiting = [], 0
            held.append((g[last:], k[last:], x[last:], a[last:], hashes[last:]))
        if held:
            yield from flush(held)

    return run


def _explode(windows: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [windows.hashes(p) for p in byte_rows(batch.column(3))]
            if hashes:
                sizes = [len(h) for h in hashes]
                pos = np.concatenate([a + np.arange(n) for a, n in zip(batch.column(2).to_numpy(), sizes, strict=True)])
                k, x = (np.repeat(batch.column(i).to_numpy(), sizes) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([longs(np.concatenate(hashes)), longs(k), longs(x), ints(pos)], names=["h", "k", "x", "a"])

    return run


def repeated_windows(texts: DataFrame, windows: Windows, light: int = LIGHT) -> DataFrame:
    """Windows of (k, x, text) rows that start earlier elsewhere: (k, x, ranges array<struct<a, n>>).

    A range is n consecutive windows, the first starting at symbol a.  A
    document is a pair (k, x), of one text.  Earlier means a smaller k, or with
    ``within`` also the same k and a smaller x, or the same document and a
    smaller start.  Documents without such a window have no row.
    """
    phrases = written(texts.mapInArrow(_phrases(windows), "g long, c long, k long, x long, a int, n int"), "phrases")
    repeated = phrases.groupBy("g").agg(F.count("*").alias("times"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    repeated = repeated.where(F.col("times") > 1 if windows.within else F.col("lo") < F.col("hi")).select("g")
    triggers = written(repeated, "triggers")
    found = written(phrases.join(triggers, "g", "left_semi"), "occurrences")
    drop(phrases, triggers)

    order = F.struct("k", "x", "a") if windows.within else F.struct("k")
    distinct = written(found.groupBy("g", "c").agg(F.min(order).alias("first")), "distinct")
    shared = written(distinct.groupBy("g").agg(F.count("*").alias("distinct")).where("distinct > 1"), "shared")
    dictionary = written(distinct.join(shared, "g", "left"), "dictionary")
    placed = found.join(dictionary, ["g", "c"]).select("g", "k", "x", "a", "n", (order > F.col("first")).alias("later"), "distinct")
    placed = written(placed.where("later or distinct is not null"), "placed")
    drop(found, distinct, shared, dictionary)

    whole = placed.where("later").select("k", "x", "a", "n")
    parts = placed.where("not later").groupBy("k", "x").agg(F.collect_list(F.struct("g", (F.col("distinct") > light).alias("heavy"), "a", "n")).alias("parts"))
    cut = texts.join(parts, ["k", "x"]).select("k", "x", "text", "parts").mapInArrow(_cut_out(windows), "g long, heavy boolean, k long, x long, a int, payload binary")
    cut = written(cut, "boundary")
    same = cut.where("not heavy").select("g", "k", "x", "a", "payload").repartition("g").sortWithinPartitions("g")
    same = same.mapInArrow(_compare(windows), "k long, x long, a int, n int")
    rows = cut.where("heavy").select("k", "x", "a", "payload").mapInArrow(_explode(windows), "h long, k long, x long, a int")
    first = rows.groupBy("h").agg(F.min(order).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    hot = rows.join(first, "h").where(order > F.col("first")).select("k", "x", "a", F.lit(1).alias("n"))
    return whole.unionByName(same).unionByName(hot).groupBy("k", "x").agg(F.collect_list(F.struct("a", "n")).alias("ranges"))


def merged(ranges_a: np.ndarray, ranges_n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs [start, end) of symbols, from ranges of windows."""
    if len(ranges_a) == 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    order = np.argsort(ranges_a, kind="stable")
    start, end = ranges_a[order].astype(np.int64), (ranges_a + ranges_n - 1 + size)[order].astype(np.int64)
    reach = np.maximum.accumulate(end)
    new = np.append(True, start[1:] > reach[:-1])
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
