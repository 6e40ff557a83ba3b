"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample; every row is then put in one leaf of each
tree.  A query opens leaves of all trees from one shared priority queue and
its candidates are ranked by their exact cosine.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastre.llm.tables import written
from cadastre.llm.vectors import binary, listed, matrix, meet, padded, usable

#: Trees; rows of a leaf aimed at (and at most of a page, on average, of a leaf that has more).
TREES, LEAF = 4, 1024
#: Rows on which the trees are fitted at most (twice that by chance), and the fewest of them in a leaf.
SAMPLE, LEAST = 65_536, 16
#: Share of the expected neighbours that the opened leaves must hold.
TARGET = 0.97


@dataclass
class Tree:
    """Directions and thresholds of the inner nodes, and their children; ~leaf stands for a leaf."""

    w: np.ndarray
    t: np.ndarray
    children: list[tuple[int, int]]
    leaves: int

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), dtype=np.int64) if self.children else np.full(len(rows), -1)
        for i, (low, high) in enumerate(self.children):
            here = np.flatnonzero(at == i)
            at[here] = np.where(rows[here] @ self.w[i] <= self.t[i], low, high)
        return ~at


def grow(sample: np.ndarray, leaf: float, seed: int) -> Tree:
    """A tree that halves the sample at medians along random directions until a part has at most ``leaf`` rows or can't be halved."""
    rng = np.random.default_rng(seed)
    w, t, children, leaves = [], [], [], 0
    todo = [(np.arange(len(sample)), None)]
    while todo:
        rows, parent = todo.pop(0)
        direction = rng.standard_normal(sample.shape[1])
        direction /= np.linalg.norm(direction) or 1
        along = sample[rows] @ direction
        cut = np.median(along) if len(rows) else 0.0
        if len(rows) > leaf and (along <= cut).any() and (along > cut).any():
            me = len(w)
            w.append(direction)
            t.append(cut)
            children.append([0, 0])
            todo += [(rows[along <= cut], (me, 0)), (rows[along > cut], (me, 1))]
        else:
            me, leaves = ~leaves, leaves + 1
        if parent is not None:
            children[parent[0]][parent[1]] = me
    return Tree(np.array(w).reshape(len(w), sample.shape[1]), np.array(t), [tuple(c) for c in children], leaves)


def unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows scaled by powers of two (exactly), their norms, and the rows at length one; rows aren't zero."""
    top = np.abs(rows).max(axis=1, initial=0)
    scaled = np.ldexp(rows, -np.frexp(top)[1][:, None])
    norm = np.sqrt((scaled * scaled).sum(axis=1))
    return scaled, norm, scaled / norm[:, None]


def below(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to about 0.0002."""
    return 0.5 * (1 + np.tanh(0.7978845608 * (z + 0.044715 * z**3)))


def opened(trees: list[Tree], query: np.ndarray, kth: float, target: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of opening.

    A neighbour at cosine c lies, along a random direction, at c times the
    query's place, with variance (1 - c^2) / width; so a leaf holds it with the product
    of the chances of its path's sides.  One queue over all trees pops the
    likeliest node.  It ends when the chance that no tree's opened leaves hold
    the neighbour is under 1 - target.
    """
    c = min(max(kth, 0.0), 1.0)
    spread = max(((1 - c * c) / len(query)) ** 0.5, 1e-9)
    left = [below(np.clip((x.t - c * (x.w @ query)) / spread, -9, 9)) for x in trees]
    queue = [(-1.0, i, 0 if x.children else -1) for i, x in enumerate(trees)]
    missed, out = [1.0] * len(trees), []
    while queue and np.prod(missed) > 1 - target:
        mass, i, node = heapq.heappop(queue)
        if node < 0:
            out.append((i, ~node))
            missed[i] = max(0.0, missed[i] + mass)
            continue
        p, (low, high) = left[i][node], trees[i].children[node]
        heapq.heappush(queue, (mass * p, i, low))
        heapq.heappush(queue, (mass * (1 - p), i, high))
    return out


def best(count: int, width: int):
    """Answers of a leaf's page: the nearest rows of each question."""

    def answer(page: pa.RecordBatch, questions: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, (rows, norms, units) = page["k"].to_numpy(), unit(matrix(page["v"], width, "f8"))
        for block in questions:
            own, (asked, lengths, directions) = block["k"].to_numpy(), unit(matrix(block["v"], width, "f8"))
            near = directions @ units.T
            near[own[:, None] == ids[None, :]] = -np.inf
            n = min(count, len(ids))
            known = block["a"].to_numpy()  # the kth score that another page has already
            kth = np.maximum(known, np.partition(near, len(ids) - n, axis=1)[:, len(ids) - n])
            q, r = np.nonzero((near >= kth[:, None] - 1e-9) & np.isfinite(near))
            score = (asked[q] * rows[r]).sum(axis=1) / (lengths[q] * norms[r])
            order = np.lexsort((ids[r], -score, q))
            q, r, score = q[order], r[order], score[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            q, r, score = q[rank < count], r[rank < count], score[rank < count]
            yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(block["x"].to_numpy()[q]), pa.array(ids[r]), pa.array(score)], ["q", "x", "k", "score"])

    return answer


def nearest(rows: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", count: int = 5, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` holds for, the ``count`` nearest others found, by cosine.

    Rows with a null key take no part, nor do vectors that are null, zero or
    hold a null or non-finite component.  Shorter vectors count as ended by
    zeros.  Rows with the query's key are never its neighbours; ties go to the
    smaller key; equal rows count once.  Queries of one key and several vectors are
    answered each.  Other columns are ignored.  An empty table gives no rows.

    Leaves with more rows than ``leaf`` (a group of copies can't be halved) are
    dealt into pages by hash; a query goes to all pages of a leaf.
    """
    kept = rows.where(F.col(key).isNotNull() & usable(vector) & F.exists(vector, lambda c: c != 0)).select(F.col(key).cast("long").alias("k"), queries.alias("asks"), F.col(vector).alias("v"))
    kept, width = padded(kept, "v")
    kept = written(kept.withColumn("x", F.xxhash64("v")), "vectors")
    total = kept.count()
    spark = kept.sparkSession
    some = kept if total <= sample else kept.where(F.pmod(F.xxhash64("k", "x"), F.lit(1 << 30)) < int((1 << 30) * sample / total)).limit(2 * sample)
    vectors = np.array([r.v for r in some.select("v").collect()], dtype=np.float64).reshape(-1, width)
    _, _, units = unit(vectors)
    at_most = max(min(LEAST, leaf), leaf * len(units) / max(total, 1))
    grown = [grow(units, at_most, seed) for seed in range(trees)]
    base = np.cumsum([0, *(x.leaves for x in grown)])
    forest = spark.sparkContext.broadcast(grown)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, directions = unit(rows := listed(b["v"], width))
            leaves = np.stack([base[i] + x.leaf_of(directions) for i, x in enumerate(forest.value)], axis=1)
            places = pa.ListArray.from_arrays(pa.array(np.arange(0, leaves.size + 1, trees, dtype=np.int32)), pa.array(leaves.ravel()))
            yield pa.RecordBatch.from_arrays([b["k"], b["x"], b["asks"], binary(rows), places], ["k", "x", "asks", "v", "leaves"])

    indexed = written(kept.select("k", "x", "asks", "v").mapInArrow(place, "k long, x long, asks boolean, v binary, leaves array<long>"), "forest")
    sizes = dict(indexed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect())
    pages = np.array([max(1, -(-sizes.get(i, 0) // (2 * leaf))) for i in range(base[-1])], dtype=np.int64)
    first = np.cumsum(np.concatenate(([0], pages)))
    dealt = spark.createDataFrame([(i, int(first[i]), int(pages[i])) for i in range(base[-1])], "leaf long, first long, pages long")
    cells = indexed.select("k", "x", "v", F.explode("leaves").alias("leaf")).join(F.broadcast(dealt), "leaf").select(
        (F.col("first") + F.pmod(F.xxhash64("k", "x"), F.col("pages"))).alias("cell"), "k", "x", "v"
    )
    asked = indexed.where("asks").dropDuplicates(["k", "x"])

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pages of the leaves that each query opens; at first (without a kth score) those it lies in."""
        for b in batches:
            _, _, directions = unit(matrix(b["v"], width, "f8"))
            at, cell, known = [], [], np.full(b.num_rows, -2.0)
            for i, home in enumerate(b["leaves"].to_pylist()):
                if "kth" in b.schema.names:
                    seen, kth = set(home), b["kth"][i].as_py()
                    known[i] = known[i] if kth is None else kth
                    home = [y for t, x in opened(forest.value, directions[i], kth or 0.0, target) if (y := int(base[t]) + x) not in seen]
                for y in home:
                    cell += range(first[y], first[y + 1])
                    at += [i] * int(pages[y])
            at = np.array(at, dtype=np.int64)
            out = pa.RecordBatch.from_arrays([b["k"], b["x"], b["v"]], ["k", "x", "v"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), out["k"], out["x"], out["v"], pa.array(known[at])], ["cell", "k", "x", "v", "a"])

    shape = "cell long, k long, x long, v binary, a double"
    found = "q long, x long, k long, score double"
    answer = best(count, width)
    home = written(meet(cells, asked.select("k", "x", "v", "leaves").mapInArrow(asks, shape), answer, found).distinct(), "near")
    place_in = Window.partitionBy("q", "x").orderBy(F.desc("score"), "k")
    kth = home.withColumn("rank", F.row_number().over(place_in)).where(F.col("rank") == count).select(F.col("q").alias("k"), "x", F.col("score").alias("kth"))
    wider = asked.join(kth, ["k", "x"], "left").select("k", "x", "v", "leaves", "kth").mapInArrow(asks, shape)
    both = meet(cells, wider, answer, found).unionByName(home).distinct()
    ranked = both.withColumn("rank", F.row_number().over(place_in)).where(F.col("rank") <= count)
    return ranked.select(F.col("q").alias("query_id"), "rank", F.col("k").alias("vec_id"), "score")
