"""Operators 8 and 10: removal of repeated byte strings and repeated word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.llm import hashing
from cadastre.llm.arrow import byte_rows
from cadastre.llm.repeats import Windows, merged, repeated_windows
from cadastre.llm.tables import identified, unkeyed
from cadastre.llm.windows import counted_windows

_OUT = "k long, n_units long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _removed(windows: Windows, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch.column(2)
            flat, rows = ranges.flatten(), np.diff(ranges.offsets.to_numpy())
            a, n, at = flat.field("a").to_numpy(), flat.field("n").to_numpy(), 0
            out: list[list] = [[], [], [], [], []]
            for data, count in zip(byte_rows(batch.column(1)), rows, strict=True):
                start, end = merged(a[at : at + count], n[at : at + count], windows.size)
                at += count
                if windows.unit == "bytes":
                    total = len(data)
                    edges = np.append(np.append(0, np.column_stack((start, end)).ravel()), total)
                    kept = b"".join(data[edges[i] : edges[i + 1]].tobytes() for i in range(0, len(edges), 2))
                else:
                    w0, w1 = hashing.words(data)
                    total = len(w0)
                    keep = np.ones(total, dtype=bool)
                    for s, e in zip(start, end, strict=True):
                        keep[s:e] = False
                    raw = data.tobytes()
                    kept = b" ".join([raw[s:e] for s, e in zip(w0[keep].tolist(), w1[keep].tolist(), strict=True)])
                row = (total, int((end - start).sum()), len(start), hashlib.sha256(kept).hexdigest(), kept if with_text else None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [batch.column(0), *(pa.array(v, type=t) for v, t in zip(out, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["k", "n_units", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, windows: Windows, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document row: (key, n_units, n_removed, n_spans, kept_sha256, kept).

    ``kept`` is what is left, as bytes (a removed byte string may end inside a
    character); null with ``with_text=False``.  A null text is empty: no units,
    nothing removed.  A null key counts as the smallest key.  Repeated rows are
    one document, and get the same result; rows of one key with different texts
    are documents of their own, in the order of their texts' hashes where an
    order counts.  Other columns are ignored and may have any names.  An empty
    table gives no rows.
    """
    texts = identified(docs, key, text)
    none = F.from_json(F.lit("[]"), "array<struct<a:int,n:int>>")
    joined = texts.join((repeated_windows if windows.within else counted_windows)(texts, windows), ["k", "x"], "left").select("k", "text", F.coalesce("ranges", none).alias("ranges"))
    return joined.mapInArrow(_removed(windows, with_text), _OUT).select(unkeyed().alias(key), "n_units", "n_removed", "n_spans", "kept_sha256", "kept")


def suffix_dedup(docs: DataFrame, size: int = 100, gram: int = 16, **names) -> DataFrame:
    """Removes every byte inside a ``size``-byte string that also starts earlier.

    Earlier: in a document with a smaller key, or in the same one with a
    smaller start.  Overlapping occurrences count, and strings are judged on
    the input.  See remove_repeats for nulls, empty texts and ties.
    """
    return remove_repeats(docs, Windows("bytes", size, gram, True), **names)


def window_dedup(docs: DataFrame, size: int = 13, gram: int = 4, **names) -> DataFrame:
    """Removes every word inside a ``size``-word window that a document with a smaller key has too.

    Words are [^\\x20\\x09-\\x0D]+, unchanged; kept words are joined by one
    space.  See remove_repeats for nulls, empty texts and ties.
    """
    return remove_repeats(docs, Windows("words", size, gram, False), **names)
