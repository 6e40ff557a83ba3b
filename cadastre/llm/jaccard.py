"""Operator 7: Jaccard join of word-shingle sets, size-aware and heavy-light.

Two sets of n and m shingles link when 100 * common >= 80 * union, that is
9 * common >= 4 * (n + m).  Equal sets are one class from the start.

* Small classes list their subsets of every size that a link could need; a
  shared subset of that size is a link, with nothing left to verify.
* Large classes are put in inverted lists by their first shingles in one global
  order (a link must share one of the first n - ceil(0.8 n) + 1).  The order
  puts shingles of many classes last, so that most lists stay short.
* First every member is compared with one centre, that which its lists offer
  most often.  Then, between classes that are not yet connected, short lists are
  scanned pair by pair, where they show as many common first shingles as a link
  must have.  Long lists are never scanned by pairs of rows: their members are
  dealt into blocks, a task gets the whole sets of two blocks, counts what all
  pairs have in common at once, and returns a spanning forest of the links.

Rows stay in proportion to members; only sets travel, once for each block that
theirs must meet.  The boundary is the size with the least estimated cost, from
the histogram of set sizes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.llm import hashing
from cadastre.llm.arrow import byte_rows, longs
from cadastre.llm.components import components
from cadastre.llm.tables import drop, keyed, row_identity, unkeyed, written

WIDTH = 5
#: Part of the hash range in which shingles of many documents are put last.
ZONE = np.uint64(int(0.4 * 2**64))
#: A shingle of more classes than this is put last in the order.
HEAVY = 64
#: Most shingles put last (the most frequent ones): bounds the broadcast. Any order gives the same links.
HEAVY_MOST = 1_000_000
#: Most classes of a block, and most shingles they have together; a task compares two blocks.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: Partners that one task compares with a centre.
SHARE = 4096
#: Largest set size at which listing subsets is considered.
SUBSETS_MOST = 24
#: Cost of a row of an inverted list, in rows of listed subsets.
LIST_COST = 4


def prefix_size(n):
    """First shingles of which linked sets share one: n - ceil(0.8 n) + 1."""
    return n - (4 * n + 4) // 5 + 1


def needed(n: int, m: int) -> int:
    """Least common size of linked sets of n and m shingles."""
    return -(-4 * (n + m) // 9)


def subset_sizes(n: int, most: int) -> list[int]:
    """Sizes of the subsets that a small set lists, for partners of at most ``most``."""
    partners = range(-(-4 * n // 5), min(most, 5 * n // 4) + 1)
    return sorted({needed(n, m) for m in partners})


def boundary(sizes: dict[int, int]) -> int:
    """The largest size that lists subsets, by estimated rows; 0 if none does."""

    def cost(most: int) -> float:
        small = sum(c * math.comb(n, k) for n, c in sizes.items() if n <= most for k in subset_sizes(n, most))
        return small + LIST_COST * sum(c * prefix_size(n) for n, c in sizes.items() if 5 * n > 4 * most)

    return min(range(SUBSETS_MOST + 1), key=cost)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, x, text) to (k, x, n, f, g, first): set size, fingerprint, and the shingles below ZONE, or all if these are no prefix."""
    for batch in batches:
        n, f, g, first = [], [], [], []
        for data in byte_rows(batch.column(2)):
            own = hashing.shingles(data, WIDTH)
            print_ = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), dtype=np.int64)
            below = int(np.searchsorted(own, ZONE))
            keep = len(own) if len(own) <= SUBSETS_MOST or below < prefix_size(len(own)) else below
            n.append(len(own)), f.append(int(print_[0])), g.append(int(print_[1])), first.append(own[:keep].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, type=pa.int32()), pa.array(f, type=pa.int64()), pa.array(g, type=pa.int64()), pa.array(first, type=pa.binary())],
            names=["k", "x", "n", "f", "g", "first"],
        )


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, own): all shingles of the set."""
    for batch in batches:
        own = [hashing.shingles(data, WIDTH).tobytes() for data in byte_rows(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, type=pa.binary())], names=["id", "own"])


def _hashes(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes(), dtype=np.uint64)


def _listable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, first) to a row (t) for each shingle that the set may list in some order: those below ZONE, or all if these are no prefix."""
    for batch in batches:
        parts = []
        for n, own in zip(batch.column(0).to_pylist(), map(_hashes, byte_rows(batch.column(1))), strict=True):
            below = own[own < ZONE]
            parts.append(below if len(below) >= prefix_size(n) else own)
        if parts:
            yield pa.RecordBatch.from_arrays([longs(np.concatenate(parts))], names=["t"])


def _prefixes(heavy):
    """(k, n, first) to a row (t, k, n, often) for each of the first shingles in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = heavy.value
        for batch in batches:
            rows, keys, sizes, flags = [], [], [], []
            for n, own in zip(batch.column(1).to_pylist(), map(_hashes, byte_rows(batch.column(2))), strict=True):
                often = np.zeros(len(own), dtype=bool)
                if len(last):
                    at = np.minimum(np.searchsorted(last, own), len(last) - 1)
                    often = last[at] == own
                order = np.lexsort((own, often, own >= ZONE))[: prefix_size(n)]
                rows.append(own[order]), flags.append(often[order]), keys.append(len(order)), sizes.append(np.full(len(order), n, dtype=np.int32))
            if rows:
                k = np.repeat(batch.column(0).to_numpy(), keys)
                yield pa.RecordBatch.from_arrays([longs(np.concatenate(rows)), longs(k), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(flags))], names=["t", "k", "n", "often"])

    return run


def _subsets(most: int):
    """(k, n, first) of small sets to (c, s, k, n): size and hash of each listed subset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for k, n, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), map(_hashes, byte_rows(batch.column(2))), strict=True):
                for c in subset_sizes(n, most):
                    for subset in combinations(own.tolist(), c):
                        s = hashlib.blake2b(np.array(subset, dtype=np.uint64).tobytes(), digest_size=8).digest()
                        for column, value in zip(out, (c, int.from_bytes(s, "little", signed=True), k, n), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["c", "s", "k", "n"])

    return run


def _runs(cross: bool):
    """Rows sorted by (t, n, k) to pairs (a, n, b, m) of a list's members, of sizes that can link.

    Each member with the list's first of a near size, or (``cross``) every two
    members of different components; rows then end with the component.
    """

    def pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        t, n = table["t"].to_numpy(), table["n"].to_numpy()
        head = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        size = np.diff(np.append(head, len(t)))
        if not cross:
            left, right = [], []
            for at, s in zip(head[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                centre = at
                for i in range(at + 1, at + s):
                    if 4 * n[i] > 5 * n[centre]:
                        centre = i
                    else:
                        left.append(centre), right.append(i)
            return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)
        c, left, right = table["component"].to_numpy(), [], []
        for at, s in zip(head[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            if (c[at : at + s] == c[at]).all():
                continue
            i, j = np.triu_indices(s, 1)
            ok = (c[at + i] != c[at + j]) & (4 * n[at + j] <= 5 * n[at + i])
            left.append(at + i[ok]), right.append(at + j[ok])
        none = np.empty(0, dtype=np.int64)
        return np.concatenate(left or [none]), np.concatenate(right or [none])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush():
            table = pa.Table.from_batches(held)
            left, right = pairs(table)
            k, n = table["k"].to_numpy(), table["n"].to_numpy()
            return pa.RecordBatch.from_arrays([longs(k[left]), pa.array(n[left]), longs(k[right]), pa.array(n[right])], names=["a", "n", "b", "m"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            t = batch.column(0).to_numpy()
            last = int(np.searchsorted(t, t[-1]))  # the last list may go on in the next batch
            if held and held[-1].column(0)[-1].as_py() != t[0]:
                yield flush()
                held = []
            if last:
                held.append(batch.slice(0, last))
                yield flush()
                held = []
            held.append(batch.slice(last))
        if held:
            yield flush()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by t to those whose list has two members at least."""
    before, last = None, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = batch if last is None else pa.concat_batches([last, batch])
        t = table.column(0).to_numpy()
        same = np.append(before is not None and t[0] == before, t[1:] == t[:-1])
        keep = same[:-1] | same[1:]  # the last row waits for the next batch
        if keep.any():
            yield table.slice(0, len(keep)).filter(pa.array(keep))
        before, last = t[-2] if len(t) > 1 else before, table.slice(len(t) - 1)
    if last is not None and before is not None and last.column(0)[0].as_py() == before:
        yield last


def _common(p: np.ndarray, q: np.ndarray) -> int:
    return int(np.count_nonzero(q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p))


def _near_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, share, other, id, own) sorted by a, share, other: each centre before its partners; to the (a, b) that link."""
    centre = np.empty(0, dtype=np.uint64)
    for batch in batches:
        left, right = [], []
        for a, other, k, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), map(_hashes, byte_rows(batch.column(4))), strict=True):
            if not other:
                centre = own
            elif 9 * _common(own, centre) >= 4 * (len(own) + len(centre)):
                left.append(a), right.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(left, type=pa.int64()), pa.array(right, type=pa.int64())], names=["a", "b"])


def _counts(row: np.ndarray, column: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common shingles of every left and right member; row: member of each shingle, column: which shingle it is.

    Shingles of few members add pair by pair, those of many by matrix products.
    """
    place = [np.full(int(max(left.max(), right.max(), row.max())) + 1, -1, dtype=np.int64) for _ in range(2)]
    for at, members in zip(place, (left, right), strict=True):
        at[members] = np.arange(len(members))
    rows, columns = [], []
    for at in place:
        mine = at[row] >= 0
        order = np.argsort(column[mine], kind="stable")
        rows.append(at[row[mine]][order]), columns.append(column[mine][order])
    width = int(column.max()) + 1
    size = [np.bincount(c, minlength=width) for c in columns]
    begin = [np.cumsum(z) - z for z in size]
    work = size[0] * size[1]
    dense = np.flatnonzero(work > max(256, len(left) * len(right) // 128))
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, len(dense), 512):
        own = dense[at : at + 512]
        number = np.full(width, -1, dtype=np.int64)
        number[own] = np.arange(len(own))
        sides = []
        for r, c, members in zip(rows, columns, (left, right), strict=True):
            side, hit = np.zeros((len(members), len(own)), dtype=np.float32), number[c] >= 0
            side[r[hit], number[c[hit]]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    work[dense] = 0
    sparse = np.flatnonzero(work)
    upto = np.cumsum(work[sparse])
    at = 0
    while at < len(sparse):
        until = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 22), side="right")))
        own = sparse[at:until]
        # Every left member of a shingle with every right member of it.
        c = np.repeat(own, size[0][own])
        one = np.repeat(begin[0][own] - (np.cumsum(size[0][own]) - size[0][own]), size[0][own]) + np.arange(len(c))
        times = size[1][c]
        two = np.repeat(begin[1][c] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        pair = np.repeat(rows[0][one], times) * len(right) + rows[1][two]
        out += np.bincount(pair, minlength=out.size).reshape(out.shape).astype(np.float32)
        at = until
    return out


def _forest(link: np.ndarray, same: bool) -> tuple[list[int], list[int]]:
    """Spanning edges (left, right) of a table of links; ``same``: left and right are the same members."""
    sides = [np.zeros(link.shape[0], dtype=bool)]
    sides.append(sides[0] if same else np.zeros(link.shape[1], dtype=bool))
    left, right = [], []
    for start in np.flatnonzero(link.any(axis=1)).tolist():
        if sides[0][start]:
            continue
        sides[0][start] = True
        todo = [(0, start)]
        while todo:
            side, u = todo.pop()
            new = np.flatnonzero((link[:, u] if side else link[u]) & ~sides[1 - side]).tolist()
            sides[1 - side][new] = True
            left += new if side else [u] * len(new)
            right += [u] * len(new) if side else new
            todo += [(0 if same else 1 - side, v) for v in new]
    return left, right


def _block_links(second: np.ndarray, k: np.ndarray, component: np.ndarray, own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (a, b) between two blocks, or inside the first if there is no second."""
    none = np.empty(0, dtype=np.int64)
    n = np.array([len(x) for x in own], dtype=np.int64)
    shingle, number, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    row, often = np.repeat(np.arange(len(own)), n), times[number] > 1
    if not often.any():
        return none, none
    _, column = np.unique(number[often], return_inverse=True)
    left, right = np.flatnonzero(~second), np.flatnonzero(second)
    same = len(right) == 0
    right = left if same else right
    if len(left) == 0:
        return none, none
    common = _counts(row[often], column, left, right)
    link = (9 * common >= 4 * (n[left][:, None] + n[right][None, :])) & (component[left][:, None] != component[right][None, :])
    a, b = _forest(link, same)
    return k[left[a]] if a else none, k[right[b]] if b else none


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, second, id, component, own) sorted by pair to the links of each pair of blocks."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        own = [_hashes(x) for part in held for x in byte_rows(part.column(4))]
        second, k, component = (np.concatenate([part.column(i).to_numpy(zero_copy_only=False) for part in held]) for i in (1, 2, 3))
        a, b = _block_links(second.astype(bool), k, component, own)
        return pa.RecordBatch.from_arrays([longs(a), longs(b)], names=["a", "b"])

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            pair = batch.column(0).to_numpy()
            until = int(np.searchsorted(pair, pair[at], side="right"))
            if held and held[-1].column(0)[0].as_py() != pair[at]:
                yield flush()
                held = []
            held.append(batch.slice(at, until - at))
            at = until
    if held:
        yield flush()


def _inverted_lists(large: DataFrame) -> DataFrame:
    """(k, n, first) to (t, k, n, often): all lists that are not ``often`` have at most HEAVY members."""
    spark = large.sparkSession
    often = large.select("n", "first").mapInArrow(_listable, "t long").groupBy("t").count().where(F.col("count") > HEAVY)
    often = written(often, "often")
    last = often.orderBy(F.desc("count"), "t").limit(HEAVY_MOST)
    heavy = spark.sparkContext.broadcast(np.sort(np.array([r.t for r in last.select("t").toLocalIterator()], dtype=np.int64).view(np.uint64)))
    listed = large.select("k", "n", "first").mapInArrow(_prefixes(heavy), "t long, k long, n int, often boolean")
    if len(heavy.value) == HEAVY_MOST:  # further ones may be long too
        listed = listed.drop("often").join(often.select("t", F.lit(True).alias("often")), "t", "left").select("t", "k", "n", F.coalesce("often", F.lit(False)).alias("often"))
    return written(listed, "lists")


def _enough(count: Column) -> Column:
    """Whether so many common first shingles can belong to a link of sizes n and m."""
    rest = F.greatest(F.expr("n - (n - ceil(4 * n / 5) + 1)"), F.expr("m - (m - ceil(4 * m / 5) + 1)"))
    return count >= F.expr("ceil(4 * (n + m) / 9)") - rest


def _sets_of(texts: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, own): the whole sets of the classes in ``ids``, from one text of each."""
    wanted = classes.select("id", "k", "x").join(ids, "id", "left_semi")
    rows = texts.join(wanted, ["k", "x"]).dropDuplicates(["k", "x"]).select("id", "text")
    return written(rows.mapInArrow(_whole, "id long, own binary"), "members")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link.  Each b's set goes to its a, whose own set goes to every share of its partners."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    partners = pairs.join(shares, "a").select("a", F.expr("cast(pmod(xxhash64(b), shares) as int)").alias("share"), F.lit(True).alias("other"), F.col("b").alias("id"))
    centres = shares.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(False).alias("other"), F.col("a").alias("id"))
    rows = partners.unionByName(centres).join(sets, "id").select("a", "share", "other", "id", "own")
    return rows.repartition("a", "share").sortWithinPartitions("a", "share", "other").mapInArrow(_near_centre, "a long, b long")


def _met(long_lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Long-list rows (t, k, n, band, component) to the blocks that must meet.

    (pair, second, id, component) rows: the members of the two blocks of each
    pair; and the ids.  Members are grouped by the lists that hold several
    components, by size band, and by whether they belong to the group's largest
    component, whose members needn't meet each other.
    """
    mixed = long_lists.groupBy("t").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("k").alias("first")).where("lo < hi").select("t", "first")
    rows = written(long_lists.join(mixed, "t"), "mixed")
    groups = components(rows.select(F.col("k").alias("a"), F.col("first").alias("b"))).withColumnRenamed("component", "g")
    members = rows.select("k", "n", "band", "component").distinct().join(groups, "k")
    members = written(members, "grouped")
    main = members.groupBy("g", "component").count().groupBy("g").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    members = members.join(main, "g").withColumn("inner", F.col("component") == F.col("main")).drop("main")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy("g", "band", "inner").agg(parts.alias("parts"))
    members = written(members.join(sizes, ["g", "band", "inner"]).withColumn("block", F.expr("cast(pmod(xxhash64(k), parts) as int)")).drop("parts"), "blocks")
    blocks = written(members.select("g", "band", "inner", "block").distinct(), "blocks")
    p = blocks.select("g", F.col("band").alias("p_band"), F.col("inner").alias("p_inner"), F.col("block").alias("p_block"), F.explode(F.array("band", F.col("band") + 1)).alias("q_band"))
    q = blocks.select("g", F.col("band").alias("q_band"), F.col("inner").alias("q_inner"), F.col("block").alias("q_block"))
    meet = p.join(q, ["g", "q_band"]).where("not (p_inner and q_inner) and (p_band < q_band or struct(p_inner, p_block) <= struct(q_inner, q_block))")
    same = F.expr("p_band = q_band and p_inner = q_inner and p_block = q_block").alias("same")
    meet = written(meet.select(F.monotonically_increasing_id().alias("pair"), "*", same), "meet")
    sides = [meet.where(cond).select("pair", F.lit(second).alias("second"), "g", *(F.col(f"{side}_{c}").alias(c) for c in ("band", "inner", "block"))) for side, second, cond in (("p", False, "true"), ("q", True, "not same"))]
    placed = members.join(sides[0].unionByName(sides[1]), ["g", "band", "inner", "block"]).select("pair", "second", F.col("k").alias("id"), "component")
    placed = written(placed, "placed")
    drop(rows, blocks, meet, members)
    return placed, placed.select("id").distinct()


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, x, n, rep struct<k, x>): a row per document row, with its key, text hash, set size, and the least (k, x) of its component.

    k is the key (tables.keyed); a row without words is its own component.
    """
    texts = keyed(docs, key, text).select("k", F.xxhash64("text").alias("x"), "text")
    sets = written(texts.mapInArrow(_sets, "k long, x long, n int, f long, g long, first binary"), "sets")
    base = written(sets.select("k", "x", "n", "f", "g"), "base")
    classes = base.where("n > 0").groupBy("n", "f", "g").agg(F.min(F.struct("k", "x")).alias("rep"))
    classes = written(classes.select("n", "f", "g", "rep.k", "rep.x", F.monotonically_increasing_id().alias("id")), "classes")
    chosen = sets.select("k", "x", "n", "first").join(classes.select("k", "x", "id"), ["k", "x"]).dropDuplicates(["k", "x"])
    chosen = written(chosen.select(F.col("id").alias("k"), "n", "first"), "chosen")
    drop(sets)
    small_most = boundary({r.n: r["count"] for r in chosen.where(F.col("n") <= SUBSETS_MOST * 2).groupBy("n").count().collect()})

    subsets = written(chosen.where(F.col("n") <= small_most).mapInArrow(_subsets(small_most), "c int, s long, k long, n int"), "subsets")
    least = written(subsets.groupBy("c", "s").agg(F.min(F.struct("n", "k")).alias("to"), F.count("*").alias("times")).where("times > 1"), "least")
    small = written(subsets.join(least, ["c", "s"]).where("k != to.k and 9 * c >= 4 * (n + to.n)").select(F.col("to.k").alias("a"), F.col("k").alias("b")).distinct(), "small")
    drop(subsets, least)

    large = chosen.where(5 * F.col("n") > 4 * small_most)
    rows = _inverted_lists(large)
    drop(chosen)
    # Lists of one member tell nothing; of the others, short ones stand in one task each.
    light = written(rows.where("not often").select("t", "k", "n").repartition("t").sortWithinPartitions("t").mapInArrow(_shared, "t long, k long, n int"), "light")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).alias("band")
    long_lists = written(rows.where("often").select("t", "k", "n", band), "long")
    drop(rows)
    stars = light.repartition("t").sortWithinPartitions("t", "n", "k").mapInArrow(_runs(False), "a long, n int, b long, m int")
    centres = written(long_lists.groupBy("t", "band").agg(F.min(F.struct("n", "k")).alias("to")), "centres")
    spread = long_lists.join(centres, ["t", "band"]).where("k != to.k and 4 * n <= 5 * to.n")
    stars = stars.unionByName(spread.select(F.col("to.k").alias("a"), F.col("to.n").alias("n"), F.col("k").alias("b"), F.col("n").alias("m")))
    likely = stars.groupBy("a", "n", "b", "m").count().where(_enough(F.col("count")))
    best = written(likely.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a")).select("a", "b"), "pairs")
    sets = _sets_of(texts, classes, best.select(F.col("a").alias("id")).unionByName(best.select(F.col("b").alias("id"))).distinct())
    first = written(_linked(best, sets).unionByName(small), "links")
    drop(centres, best, sets, small)
    known = written(components(first), "components")

    def placed(lists: DataFrame) -> DataFrame:
        return lists.join(known, "k", "left").withColumn("component", F.coalesce("component", "k"))

    crossed = placed(light).select("t", "k", "n", "component").repartition("t").sortWithinPartitions("t", "n", "k").mapInArrow(_runs(True), "a long, n int, b long, m int")
    pairs = written(crossed.groupBy("a", "n", "b", "m").count().where(_enough(F.col("count"))).select("a", "b"), "pairs")
    blocks, ids = _met(written(placed(long_lists), "placed"))
    sets = _sets_of(texts, classes, ids.unionByName(pairs.select(F.col("a").alias("id"))).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    rest = written(_linked(pairs, sets), "links")
    met = blocks.join(sets, "id").select("pair", "second", "id", "component", "own").repartition("pair").sortWithinPartitions("pair")
    rest = rest.unionByName(met.mapInArrow(_blocks, "a long, b long"))
    joined = written(components(first.unionByName(rest)).withColumnRenamed("k", "id"), "components")
    drop(light, long_lists, sets, pairs)

    named = classes.join(joined, "id", "left").select("n", "f", "g", F.struct("k", "x").alias("own"), F.coalesce("component", "id").alias("component"))
    least = named.groupBy("component").agg(F.min("own").alias("rep"))
    named = written(named.join(least, "component").select("n", "f", "g", "rep"), "named")
    with_set = base.where("n > 0").join(named, ["n", "f", "g"]).select("k", "x", "n", "rep")
    return with_set.unionByName(base.where("n = 0").select("k", "x", "n", F.struct("k", "x").alias("rep")))


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: (key, n_shingles, component_id).

    Sets are the distinct 5-word shingles of the text with A-Z lower-cased,
    words [^\\x20\\x09-\\x0D]+; a text of fewer words is one shingle.  A null,
    empty or blank text has no set, links with nothing and is its own
    component.  component_id is the smallest key reachable by links.  A null
    key counts as the smallest key and comes back as null.  Repeated rows and
    rows with one key are documents of their own: all are kept, and a key joins
    nothing.  Other columns are ignored.  An empty table gives no rows.
    """
    out = grouped(docs, key, text)
    return out.select(unkeyed().alias(key), F.col("n").cast("long").alias("n_shingles"), unkeyed("rep.k").alias("component_id"))


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents' own rows, one of each group of near duplicates: that of the least key, then text hash.

    Rows without words are in no group, and all stay.  Of equal rows of a group
    one stays.  Rows that share a key, or have none, but differ in text are
    documents of their own.  All columns are kept, whatever their names.
    """
    groups = written(grouped(docs, key, text).where("n > 0").select("k", "x", "rep"), "groups")
    gone = groups.where("struct(k, x) != rep").select("k", "x").distinct()
    again = groups.where("struct(k, x) = rep").groupBy("k", "x").count().where("count > 1").select("k", "x")
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    k, x = row_identity(docs[key], docs[text])
    marked = docs.select(row, k.alias("k"), x.alias("x")).join(gone, ["k", "x"], "left_anti")
    once = marked.join(again, ["k", "x"], "left_semi").dropDuplicates(["k", "x"])
    return marked.join(again, ["k", "x"], "left_anti").unionByName(once).select("row.*")
