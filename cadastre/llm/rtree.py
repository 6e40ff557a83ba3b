"""Hard negatives by an R-tree packed by sort-tile-recursive.

Rows are cut into tiles along the coordinates of greatest spread; a tile's rows
are packed into leaves of a small tree.  A node's box bounds its rows' inner
products with an anchor from both sides, coordinate by coordinate.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastre.llm.tables import written
from cadastre.llm.vectors import binary, listed, matrix, meet, padded, usable

#: Rows of a tile aimed at, of a leaf at most, and leaves below one inner node.
TILE, LEAF, FAN = 2048, 64, 8
#: Rows on which the tiles' bounds are fitted at most (twice that by chance).
SAMPLE = 65_536
#: Tiles at most: their boxes are broadcast (2 x 8 bytes a coordinate).  Beyond TILE times as many rows, tiles grow instead.
TILES = 16_384
#: Largest and least long.
TOP = 2**63 - 1


@dataclass
class Boxes:
    """Bounds of each box's rows, and of their labels."""

    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def products(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner products that rows of each box can have with each anchor."""
        up, down = np.maximum(anchors, 0.0), np.minimum(anchors, 0.0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T

    def merged(self, starts: np.ndarray) -> Boxes:
        return Boxes(np.minimum.reduceat(self.low, starts), np.maximum.reduceat(self.high, starts), np.minimum.reduceat(self.first, starts), np.maximum.reduceat(self.last, starts))


def slabs(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Order of the rows by label, and within a label by slabs: sort by a coordinate, cut, sort each part by the next."""
    order, out = np.argsort(labels, kind="stable"), []
    spread = np.argsort(-rows.var(axis=0), kind="stable") if rows.size else np.empty(0, dtype=np.int64)

    def tile(part: np.ndarray, depth: int) -> None:
        if len(part) <= LEAF or depth >= len(spread):
            out.append(part)
            return
        part = part[np.argsort(rows[part, spread[depth]], kind="stable")]
        half = LEAF * -(-len(part) // (2 * LEAF))
        tile(part[:half], depth + 1)
        tile(part[half:], depth + 1)

    for part in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1):
        tile(part, 0)
    return np.concatenate(out) if out else order


class Tree:
    """The rows of a tile in packed order, with the boxes of leaves and of inner nodes."""

    def __init__(self, page: pa.RecordBatch, width: int, kind: str, exact: bool):
        rows, labels = matrix(page["v"], width, kind).astype(np.float64), page["x"].to_numpy()
        order = slabs(rows, labels)
        self.rows, self.labels, self.ids, self.exact = rows[order], labels[order], page["k"].to_numpy()[order], exact
        self.starts = np.arange(0, len(order), LEAF)
        self.leaves = Boxes(self.rows, self.rows, self.labels, self.labels).merged(self.starts)
        self.inner = self.leaves.merged(np.arange(0, len(self.starts), FAN))

    def scores(self, leaf: int, anchor: np.ndarray) -> tuple[slice, np.ndarray]:
        here = slice(leaf * LEAF, leaf * LEAF + LEAF)
        return here, products(self.rows[here], anchor, self.exact)

    def search(self, anchors: np.ndarray, own: np.ndarray, same: bool, look: Callable, done: Callable) -> None:
        """Pop nodes by their greatest possible score: ``look(i, rows, scores)`` sees the rows of leaves, ``done(i, low, high)`` says which boxes anchor i needs no more."""
        if self.exact:
            (low, high), (inner_low, inner_high) = self.leaves.products(anchors), self.inner.products(anchors)
        else:  # bounds would be rounded: every box may hold anything
            low, high = (np.full((len(anchors), len(self.starts)), s * np.inf) for s in (-1, 1))
            inner_low, inner_high = (np.full((len(anchors), len(self.inner.low)), s * np.inf) for s in (-1, 1))

        def fits(boxes: Boxes, node: int, label: int) -> bool:
            first, last = boxes.first[node], boxes.last[node]
            return first <= label <= last if same else not first == label == last

        for i, label in enumerate(own):
            queue = [(-inner_high[i, n], 0, n) for n in range(len(self.inner.low)) if fits(self.inner, n, label) and not done(i, inner_low[i, n], inner_high[i, n])]
            heapq.heapify(queue)
            while queue:
                most, leaf, node = heapq.heappop(queue)
                if leaf:
                    if not done(i, low[i, node], -most):
                        here, scores = self.scores(node, anchors[i])
                        look(i, here, scores)
                    continue
                for n in range(node * FAN, min(node * FAN + FAN, len(self.starts))):
                    if fits(self.leaves, n, label) and not done(i, low[i, n], high[i, n]):
                        heapq.heappush(queue, (-high[i, n], 1, n))


def products(rows: np.ndarray, anchor: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as longs; those beyond a long become its bounds."""
    if exact:
        return (rows @ anchor).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(row, anchor, strict=True)) for row in rows]
    return np.array([max(-TOP - 1, min(TOP, w)) for w in whole], dtype=np.int64)


def kept(best: list[tuple[int, int]], scores: np.ndarray, ids: np.ndarray, count: int) -> list[tuple[int, int]]:
    """The first ``count`` (-score, id) of both."""
    return sorted([*best, *((-int(s), int(k)) for s, k in zip(scores, ids, strict=True))])[:count]


def positives(count: int, width: int, kind: str, exact: bool):
    """Answers of a tile: each anchor's best rows of its label, above what it knows of already."""

    def answer(page: pa.RecordBatch, questions: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(page, width, kind, exact)
        for block in questions:
            anchors, labels, keys = matrix(block["v"], width, kind).astype(np.float64), block["x"].to_numpy(), block["k"].to_numpy()
            least = block["a"].flatten().to_numpy().copy()
            best: list[list[tuple[int, int]]] = [[] for _ in keys]

            def look(i: int, here: slice, scores: np.ndarray) -> None:
                fit = (tree.labels[here] == labels[i]) & (tree.ids[here] != keys[i]) & (scores >= least[i])
                if fit.any():
                    best[i] = kept(best[i], scores[fit], tree.ids[here][fit], count)
                    if len(best[i]) == count:
                        least[i] = max(least[i], -best[i][-1][0])

            tree.search(anchors, labels, True, look, lambda i, low, high: high < least[i])
            rows = [(int(keys[i]), int(labels[i]), block["v"][i].as_py(), k, -s) for i, own in enumerate(best) for s, k in own]
            yield pa.RecordBatch.from_pylist([dict(zip(("q", "x", "v", "k", "score"), r, strict=True)) for r in rows], pa.schema([("q", pa.int64()), ("x", pa.int64()), ("v", pa.binary()), ("k", pa.int64()), ("score", pa.int64())]))

    return answer


def floor_of(score: int, low: int, of: int) -> int:
    """Least long n with of * n >= low * score."""
    return -((-low * score) // of)


def negatives(count: int, low: int, of: int, width: int, kind: str, exact: bool):
    """Answers of a tile: for each of an anchor's positives, the best rows of other labels within its window."""

    def answer(page: pa.RecordBatch, questions: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(page, width, kind, exact)
        for block in questions:
            anchors, labels, keys = matrix(block["v"], width, kind).astype(np.float64), block["x"].to_numpy(), block["k"].to_numpy()
            tops = block["a"].to_pylist()
            windows = [[[floor_of(p, low, of), p, []] for p in own] for own in tops]
            ends = [(min((w[0] for w in own), default=1), max((w[1] for w in own), default=0)) for own in windows]

            def look(i: int, here: slice, scores: np.ndarray) -> None:
                fit = np.flatnonzero((scores >= ends[i][0]) & (scores <= ends[i][1]) & (tree.labels[here] != labels[i]) & (tree.ids[here] != keys[i]))
                if not len(fit):
                    return
                scores, ids = scores[fit], tree.ids[here][fit]
                for w in windows[i]:
                    inside = (scores >= w[0]) & (scores <= w[1])
                    if inside.any():
                        w[2] = kept(w[2], scores[inside], ids[inside], count)
                        if len(w[2]) == count:
                            w[0] = -w[2][-1][0]
                ends[i] = min(w[0] for w in windows[i]), ends[i][1]

            def done(i: int, least: float, most: float) -> bool:
                return most < ends[i][0] or least > ends[i][1] or all(most < w[0] or least > w[1] for w in windows[i])

            tree.search(anchors, labels, False, look, done)
            rows = [(int(keys[i]), int(labels[i]), block["v"][i].as_py(), n, k, -s) for i, own in enumerate(windows) for n, w in enumerate(own) for s, k in w[2]]
            yield pa.RecordBatch.from_pylist([dict(zip(("q", "x", "v", "nth", "k", "score"), r, strict=True)) for r in rows], pa.schema([("q", pa.int64()), ("x", pa.int64()), ("v", pa.binary()), ("nth", pa.int32()), ("k", pa.int64()), ("score", pa.int64())]))

    return answer


@dataclass
class Tiling:
    """Tiles along some coordinates: level by level, the bound of each part so far."""

    along: np.ndarray
    bounds: list[np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray, tiles: int) -> Tiling:
        spread = np.argsort(-sample.var(axis=0), kind="stable") if sample.size else np.empty(0, dtype=np.int64)
        out = cls(spread, [])
        while 2 ** len(out.bounds) < tiles and len(out.bounds) < len(spread):
            at, along = out.of(sample), sample[:, spread[len(out.bounds)]]
            out.bounds.append(np.array([np.median(along[at == i]) if (at == i).any() else 0.0 for i in range(2 ** len(out.bounds))]))
        return out

    def of(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), dtype=np.int64)
        for level, bound in enumerate(self.bounds):
            at = 2 * at + (rows[:, self.along[level]] > bound[at])
        return at


def hard_negatives(rows: DataFrame, anchors: Column, key: str = "vec_id", label: str | Column = "label", vector: str = "embedding", positives_of: int = 5, count: int = 5, low: int = 80, of: int = 100, scale: float = 256.0, tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows that ``anchors`` holds for.

    Components become floor(scale * x); a score is the integer inner product.
    An anchor's positives are its first ``positives_of`` other rows of its label;
    a positive's negatives are the first ``count`` rows of other labels whose
    scores s satisfy low * p <= of * s <= of * p, p being the positive's.  Higher scores come first, ties by key.

    Rows with a null key, label or vector, or a null or non-finite component take
    no part.  Shorter vectors count as ended by zeros.  A row never meets rows of its own
    key; repeated rows are rows of their own, repeated anchors are answered once.  Scores
    beyond 64 bits are held at their bounds.  Other columns are ignored; an empty table gives no rows.
    """
    label = F.col(label) if isinstance(label, str) else label
    good = rows.where(F.col(key).isNotNull() & label.isNotNull() & usable(vector))
    good = good.select(F.col(key).cast("long").alias("k"), label.cast("long").alias("x"), anchors.alias("asks"), F.transform(vector, lambda c: c.cast("double") * scale).alias("v"))
    good, width = padded(good, "v")
    total, bound = good.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("v", F.abs)))).first()
    bound = float(np.ceil(bound or 0.0))
    kind, exact = "i2" if bound < 2**15 else "f8", bool(bound * bound * max(width, 1) < 2**53)
    spark = rows.sparkSession
    some = good if total <= sample else good.where(F.pmod(F.xxhash64("k", "x", "v"), F.lit(1 << 30)) < int((1 << 30) * sample / total)).limit(2 * sample)
    size = max(tile, -(-2 * total // TILES))
    tiling = Tiling.fit(np.floor(np.array([r.v for r in some.select("v").collect()], dtype=np.float64).reshape(-1, width)), max(1, -(-total // size)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = np.floor(listed(b["v"], width))
            yield pa.RecordBatch.from_arrays([pa.array(tiling.of(whole)), b["k"], b["x"], b["asks"], binary(whole.astype(kind))], ["tile", "k", "x", "asks", "v"])

    placed = written(good.select("k", "x", "asks", "v").mapInArrow(place, "tile long, k long, x long, asks boolean, v binary"), "placed")
    sizes = placed.groupBy("tile").count().orderBy("tile").collect()  # at most TILES
    parts = {r.tile: -(-r["count"] // (2 * size)) for r in sizes}
    starts = dict(zip(parts, np.cumsum([0, *parts.values()])[:-1].tolist(), strict=True))
    dealt = spark.createDataFrame([(t, starts[t], n) for t, n in parts.items()], "tile long, first long, parts long")
    cell = F.col("first") + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts"))
    tiled = written(placed.join(F.broadcast(dealt), "tile").select(cell.alias("cell"), "k", "x", "asks", "v"), "tiles")

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Boxes] = {}
        for b in batches:
            cells, x, whole = b["cell"].to_numpy(), b["x"].to_numpy(), matrix(b["v"], width, kind).astype(np.float64)
            order = np.argsort(cells, kind="stable")
            at = np.flatnonzero(np.diff(cells[order], prepend=-1))
            part = Boxes(whole[order], whole[order], x[order], x[order]).merged(at)
            for i, c in enumerate(cells[order][at].tolist()):
                one = Boxes(part.low[i], part.high[i], part.first[i], part.last[i])
                h = held.get(c, one)
                held[c] = Boxes(np.minimum(h.low, one.low), np.maximum(h.high, one.high), min(h.first, one.first), max(h.last, one.last))
        if held:
            many = list(held.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), binary(np.stack([m.low for m in many])), binary(np.stack([m.high for m in many])), pa.array([int(m.first) for m in many]), pa.array([int(m.last) for m in many])], ["cell", "low", "high", "first", "last"])

    directory: dict[int, Boxes] = {}
    by_cell = tiled.repartition("cell").mapInArrow(boxes, "cell long, low binary, high binary, first long, last long")
    for r in by_cell.collect():  # one row a cell
        directory[r.cell] = Boxes(np.frombuffer(r.low), np.frombuffer(r.high), r.first, r.last)
    cells = np.array(sorted(directory), dtype=np.int64)
    every = Boxes(*(np.array([getattr(directory[c], f) for c in cells.tolist()]) for f in ("low", "high", "first", "last")))
    shared = spark.sparkContext.broadcast(every)
    asked = tiled.where("asks").dropDuplicates(["k", "x", "v"])

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tiles whose box may hold what an anchor still lacks: rows of its label that reach its kth, or other rows within its windows; never its own tile for the first."""
        boxes = shared.value
        for b in batches:
            anchors, x = matrix(b["v"], width, kind).astype(np.float64), b["x"].to_numpy()
            low_of, high_of = boxes.products(anchors) if exact else (np.full((b.num_rows, len(cells)), -np.inf), np.full((b.num_rows, len(cells)), np.inf))
            one = (boxes.first[None, :] == x[:, None]) & (boxes.last[None, :] == x[:, None])
            if "cell" in b.schema.names:
                fit = (boxes.first[None, :] <= x[:, None]) & (x[:, None] <= boxes.last[None, :]) & (high_of >= b["a"].flatten().to_numpy()[:, None]) & (cells[None, :] != b["cell"].to_numpy()[:, None])
            else:
                tops = b["a"].to_pylist()
                least = np.array([[min((floor_of(p, low, of) for p in t), default=TOP)] for t in tops], dtype=np.float64).reshape(-1, 1)
                most = np.array([[max(t, default=-TOP)] for t in tops], dtype=np.float64).reshape(-1, 1)
                fit = ~one & (high_of >= least) & (low_of <= most)
            at, where = np.nonzero(fit)
            out = pa.RecordBatch.from_arrays([b["k"], b["x"], b["v"], b["a"]], ["k", "x", "v", "a"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(cells[where]), *out.columns], ["cell", *out.schema.names])

    shape = "cell long, k long, x long, v binary, a array<long>"
    found = "q long, x long, v binary, k long, score long"
    answer = positives(positives_of, width, kind, exact)
    nothing = F.array(F.lit(-TOP - 1))
    home = written(meet(tiled, asked.withColumn("a", nothing), answer, found), "near")
    first = Window.partitionBy("q", "x", "v").orderBy(F.desc("score"), "k")

    def numbered(found: DataFrame, by: Window, most: int) -> DataFrame:
        return found.withColumn("nth", F.row_number().over(by) - 1).where(F.col("nth") < most)

    kth = numbered(home, first, positives_of).where(F.col("nth") == positives_of - 1).select(F.col("q").alias("k"), "x", "v", F.array("score").alias("a"))
    known = asked.join(kth, ["k", "x", "v"], "left").withColumn("a", F.coalesce("a", nothing))
    wider = known.select("cell", "k", "x", "v", "a").mapInArrow(asks, shape)
    best = written(numbered(meet(tiled, wider, answer, found).unionByName(home), first, positives_of), "positives")
    tops = best.groupBy(F.col("q").alias("k"), "x", "v").agg(F.array_sort(F.collect_list(F.struct("nth", "score"))).alias("s")).select("k", "x", "v", F.col("s.score").alias("a"))
    hard = meet(tiled, tops.mapInArrow(asks, shape), negatives(count, low, of, width, kind, exact), "q long, x long, v binary, nth int, k long, score long")
    hard = hard.withColumn("rank", F.row_number().over(Window.partitionBy("q", "x", "v", "nth").orderBy(F.desc("score"), "k"))).where(F.col("rank") <= count)
    pairs = best.select("q", "x", "v", "nth", F.col("k").alias("positive_id"), F.col("score").alias("positive_score")).join(hard.withColumnsRenamed({"k": "negative_id", "score": "negative_score"}), ["q", "x", "v", "nth"])
    return pairs.select(F.col("q").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same rows in DuckDB's SQL.
SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS i FROM s WHERE same),
n AS (
  SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 100 * s.score >= 80 * p.score AND s.score <= p.score WHERE i <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
