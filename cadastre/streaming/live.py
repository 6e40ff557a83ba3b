"""Live feeds. Each function takes a streaming or a batch DataFrame and declares the same plan for both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadastre.functions import cogo
from cadastre.operators import editlog
from cadastre.sources.field import scan_nmea

#: How late a row may come.
LATE = "10 minutes"


def _timed(rows: DataFrame) -> DataFrame:
    """Rows with ts as an instant, which watermarks need, and the watermark."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def _windowed(fixes: DataFrame, window) -> DataFrame:
    counted = _timed(fixes).groupBy(window.alias("w"), "receiver").agg(F.count("*").alias("fixes"), F.avg("value").alias("mean"))
    return counted.select("receiver", F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "fixes", "mean")


def fix_rate(fixes: DataFrame, length: str = "1 hour") -> DataFrame:
    """(receiver, begins, ends, fixes, mean) of fixes(receiver, ts, value) in tumbling windows."""
    return _windowed(fixes, F.window("ts", length))


def fix_smooth(fixes: DataFrame, length: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    """As fix_rate, in windows that slide by ``step``."""
    return _windowed(fixes, F.window("ts", length, step))


def occupations(fixes: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """As fix_rate, in sessions: a receiver's fixes with less than ``gap`` between them."""
    return _windowed(fixes, F.session_window("ts", gap))


def live_values(ops: DataFrame) -> DataFrame:
    """(doc, key, value): the latest write of each key, by (ts, actor). For update or complete mode."""
    return ops.groupBy("doc", "key").agg(F.max_by("value", F.struct("ts", "actor")).alias("value"))


def op_history(ops: DataFrame) -> DataFrame:
    """Operations, each op_id once within the allowed lateness. For append mode."""
    ops = _timed(ops)
    return ops.dropDuplicatesWithinWatermark(["op_id"]) if ops.isStreaming else ops.dropDuplicates(["op_id"])


def ingest_dedupe(texts: DataFrame) -> DataFrame:
    """(hash): each white-space-normalised text's SHA-256 once. State grows with the distinct texts."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    return texts.select(F.sha2(text.cast("binary"), 256).alias("hash")).dropDuplicates(["hash"])


def live_closure(legs: DataFrame) -> DataFrame:
    """(t, n, dx, dy, perimeter) of the legs(t, az, d) that have arrived, in any order."""
    return legs.groupBy("t").agg(F.count("*").alias("n"), F.sum(cogo.departure(F.col("az"), F.col("d"))).alias("dx"), F.sum(cogo.latitude(F.col("az"), F.col("d"))).alias("dy"), F.sum("d").alias("perimeter"))


def stream_fixes(lines: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Positions of the GGA sentences in lines(ts, .., line), by the plan of the batch scan, with a watermark on ts."""
    return scan_nmea(lines.withWatermark("ts", delay))


def live_geometry(ops: DataFrame) -> DataFrame:
    """Each vertex of the polygons as its operations so far leave it, for update or complete mode; ring_order() makes the rings of that table.

    The state is a row for each vertex, whatever the number of its operations;
    late and repeated operations change nothing that newer ones have decided.
    """
    return editlog.polygon_vertices(ops)


def live_presence(cursors: DataFrame, stale_ms: int = 30_000, delay: str = LATE) -> DataFrame:
    """(doc, actor, event, ts): joins and leaves of cursors(doc, actor, ts), each once the watermark makes it final. For append mode.

    A group's state holds its times of presence that the watermark hasn't passed,
    and its timer is set to the next of their ends; an actor that has left has no
    state.  Cursors may come late by ``delay``.
    """
    rows = cursors.where("ts is not null").select("doc", "actor", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    kinds = dict(rows.dtypes)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begins, ends, joined = (list(x) for x in (state.get if state.exists else ((), (), ())))
        new = [t for b in batches for t in (b["ts"].astype("datetime64[ms]").astype("int64")).tolist()]
        spans: list[list] = []
        for begin, end, known in sorted([*zip(begins, ends, joined, strict=True), *((t, t, False) for t in new)]):
            if spans and begin <= spans[-1][1] + stale_ms:
                spans[-1] = [spans[-1][0], max(end, spans[-1][1]), spans[-1][2] or known]
            else:
                spans.append([begin, end, known])
        now, out, left = state.getCurrentWatermarkMs(), [], []
        for begin, end, known in spans:
            if not known and begin <= now:
                out.append(("join", begin))
                known = True
            if known and end + stale_ms < now:
                out.append(("leave", end + stale_ms))
            else:
                left.append((begin, end, known))
        if left:
            state.update(tuple(map(list, zip(*left, strict=True))))
            state.setTimeoutTimestamp(max(now, min(end + stale_ms if known else begin for begin, end, known in left)) + 1)
        else:
            state.remove()
        if out:
            yield pd.DataFrame({"doc": [key[0]] * len(out), "actor": [key[1]] * len(out), "event": [e for e, _ in out], "ts": pd.to_datetime(np.array([t for _, t in out], dtype="datetime64[ms]"))})

    return rows.groupBy("doc", "actor").applyInPandasWithState(step, f"doc {kinds['doc']}, actor {kinds['actor']}, event string, ts timestamp", "begins array<long>, ends array<long>, joined array<boolean>", "append", GroupStateTimeout.EventTimeTimeout)
