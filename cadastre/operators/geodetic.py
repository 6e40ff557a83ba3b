"""Traverses on the ellipsoid."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastre.functions.geodesics import forward_arrays, inverse_arrays

#: Legs that a task takes at once.
BLOCK = 1 << 16


def _walk(legs: pa.Table, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lon, lat, run) at the ends of legs that stand by traverse, all traverses a leg at a time, and where the last one is.

    ``at`` is where the traverse is whose legs came before, if its legs go on here.
    """
    begins = legs["number"].to_numpy() == 1
    group = np.cumsum(begins)
    here = np.vstack([at, np.stack([legs["lon"].to_numpy()[begins], legs["lat"].to_numpy()[begins], np.zeros(begins.sum())], axis=1)])
    bearing, d, out = legs["bearing"].to_numpy(), legs["d"].to_numpy(), np.empty((len(group), 3))
    place = np.arange(len(group)) - np.searchsorted(group, group)
    order = np.argsort(place, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
        lon, lat, run = here[group[rows]].T
        out[rows] = here[group[rows]] = np.stack([*forward_arrays(lon, lat, bearing[rows], d[rows]), run + d[rows]], axis=1)
    return out, here[-1]


def geodesic_traverse(legs: DataFrame, starts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(t, seq, lon, lat, run): the ends of legs(t, seq, bearing, d) walked from starts(t, lon, lat), degrees and metres; run is the length so far.

    Each end is the next leg's beginning.  A task takes its traverses' legs in
    order, ``block`` at once, and walks those of all traverses side by side; one
    that isn't over goes on with the next legs, so a long traverse is never held whole.
    Traverses without a start are left out; after a leg without bearing or length places are null.
    """
    seq = dict(legs.dtypes)["seq"]
    met = legs.select("t", "seq", F.col("bearing").cast("double").alias("bearing"), F.col("d").cast("double").alias("d")).join(starts.select("t", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")), "t")
    rows = met.withColumn("number", F.row_number().over(Window.partitionBy("t").orderBy("seq", "bearing", "d")))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = np.full(3, np.nan), []
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            while size := sum(b.num_rows for b in held):
                if batch is not None and size < block:
                    break
                table = pa.Table.from_batches(held)
                ends, at = _walk(table.slice(0, block), at)
                held = table.slice(block).to_batches()
                ends = [pa.array(c, mask=np.isnan(c)) for c in ends.T]
                yield from pa.table([*table.slice(0, block).select(["t", "seq"]).columns, *ends], names=["t", "seq", "lon", "lat", "run"]).to_batches()

    return rows.mapInArrow(walk, f"t {dict(met.dtypes)['t']}, seq {seq}, lon double, lat double, run double")


def geodesic_closure(points: DataFrame, starts: DataFrame) -> DataFrame:
    """(t, n, perimeter, closure, bearing, ratio): how far each traverse of geodesic_traverse() ends from its start, the bearing back to it, and perimeter over closure (null under a nanometre)."""
    last = points.groupBy("t").agg(F.count("*").alias("n"), F.max(F.struct("seq", "lon", "lat", "run")).alias("p"))
    both = last.join(starts.select("t", F.col("lon").cast("double").alias("x"), F.col("lat").cast("double").alias("y")), "t").select("t", "n", F.col("p.run").alias("perimeter"), "p.lon", "p.lat", "x", "y")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = inverse_arrays(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("lon", "lat", "x", "y")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("t", "n", "perimeter")), *(pa.array(c, mask=np.isnan(c)) for c in found)], names=["t", "n", "perimeter", "closure", "bearing"])

    found = both.mapInArrow(close, f"t {dict(both.dtypes)['t']}, n long, perimeter double, closure double, bearing double")
    return found.withColumn("ratio", F.when(F.col("closure") >= 1e-9, F.col("perimeter") / F.col("closure")))


def adjust_geodesic(points: DataFrame, starts: DataFrame) -> DataFrame:
    """points(t, seq, lon, lat, run) with the misclosure, in degrees, taken out in proportion to the length so far (compass rule)."""
    last = points.groupBy("t").agg(F.max(F.struct("seq", "lon", "lat", "run")).alias("end")).join(starts.select("t", F.col("lon").alias("x"), F.col("lat").alias("y")), "t")
    share = F.coalesce(F.try_divide(F.col("run"), F.col("end.run")), F.lit(0.0))
    moved = points.join(last, "t")
    return moved.select("t", "seq", (F.col("lon") + (F.col("x") - F.col("end.lon")) * share).alias("lon"), (F.col("lat") + (F.col("y") - F.col("end.lat")) * share).alias("lat"), "run")
