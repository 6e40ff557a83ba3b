"""Hard negatives, nearest neighbours and collocations against brute force, with all odd cases."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastre.llm import collocations as C
from cadastre.llm import forest, rtree
from cadastre.llm import queries as Q

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, k string, x string, v string, cell int, a int"
CLASH = ("k", "x", "v", 1, 2)


def vectors(n=420, width=6, seed=3):
    """Clusters, exact copies, ties, zero, null, short and non-finite vectors, null keys and labels, repeated rows."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((7, width))
    rows = [(i, [float(np.float32(c)) for c in centres[i % 7] + 0.3 * rng.standard_normal(width)], i % 4) for i in range(n)]
    rows = [(i, rows[50][1], label) if i % 3 == 0 else (i, v, label) for i, v, label in rows]
    odd = [(1000, None, 1), (1001, [0.0] * width, 1), (1050, [1.0, None] + [0.0] * (width - 2), 2), (1100, [math.nan] * width, 0), (1150, [math.inf] + [1.0] * (width - 1), 0), (None, rows[1][1], 1), (1200, rows[1][1], None), (1250, [0.5, -0.25], 3), (1300, [], 2)]
    return rows + rows[100:110] + odd


def table(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(3)


def whole(rows, width=6):
    good = [(k, np.array([*v, *[0.0] * (width - len(v))]), label) for k, v, label in rows if k is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    return good


def wanted_negatives(rows, of_anchor=5, count=5):
    good = [(k, [int(math.floor(256 * c)) for c in v], label) for k, v, label in whole(rows) if label is not None]
    out, seen = [], set()
    for k, v, label in good:
        if k % 10 or (k, label, tuple(v)) in seen:
            continue
        seen.add((k, label, tuple(v)))
        scored = sorted((-int(sum(a * b for a, b in zip(v, w, strict=True))), j, m) for j, w, m in good if j != k)
        for s, p, _ in [x for x in scored if x[2] == label][:of_anchor]:
            fit = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:count]
            out += [(k, p, i + 1, x[1], -s, -x[0]) for i, x in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("factor", [1.0, 500.0, 1e6])
def test_hard_negatives(spark, factor):
    rows = [(k, v and [c if c is None else float(np.float32(c * factor)) for c in v], label) for k, v, label in vectors(420 if factor < 1e6 else 60)]
    got = rtree.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, tile=64)
    assert sorted(map(tuple, got.collect())) == wanted_negatives(rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_boxes_bound_all_products():
    rng = np.random.default_rng(5)
    rows, anchors = rng.integers(-99, 99, (300, 9)).astype(float), rng.integers(-99, 99, (20, 9)).astype(float)
    starts = np.arange(0, 300, 30)
    low, high = rtree.Boxes(rows, rows, np.zeros(300), np.zeros(300)).merged(starts).products(anchors)
    scores = anchors @ rows.T
    assert (np.minimum.reduceat(scores, starts, axis=1) >= low).all() and (np.maximum.reduceat(scores, starts, axis=1) <= high).all()


def test_search_skips_boxes_strictly_below_the_kth():
    rng = np.random.default_rng(6)
    rows = np.sort(rng.integers(1, 5000, 2000))[:, None].astype(float)
    page = rtree.pa.RecordBatch.from_arrays([rtree.pa.array(np.arange(2000)), rtree.pa.array(np.zeros(2000, dtype=np.int64)), rtree.binary(rows)], ["k", "x", "v"])
    tree, read = rtree.Tree(page, 1, "f8", True), []
    kth = [0]

    def look(i, here, scores):
        read.append(here)
        kth[0] = max(kth[0], sorted(scores)[-5])

    tree.search(np.ones((1, 1)), np.zeros(1, dtype=np.int64), True, look, lambda i, low, high: high < kth[0])
    assert len(read) <= 2


def test_nearest(spark):
    rows = vectors()
    good = [(k, v) for k, v, _ in whole(rows) if np.any(v)]
    got = {}
    for r in forest.nearest(table(spark, rows), F.col("vec_id") % 5 == 0, leaf=32, sample=200).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {k for k, _ in good if k % 5 == 0}
    hit = total = 0
    for k, own in got.items():
        own.sort(key=lambda r: r.rank)
        v = next(w for j, w in good if j == k)
        score = {j: float(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)) for j, w in good if j != k}
        assert [r.rank for r in own] == [1, 2, 3, 4, 5] and all(abs(r.score - score[r.vec_id]) < 1e-12 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        least = sorted(score.values())[-5] - 1e-12
        hit += sum(r.score >= least for r in own)
        total += 5
    assert hit / total >= 0.9
    copies = [r.vec_id for r in sorted(got[15], key=lambda r: r.rank)]
    assert copies == [0, 3, 6, 9, 12]  # ties of exact copies go to the smaller key, over all pages


def test_nearest_with_few_or_no_rows(spark):
    few = [(5, [1.0, 0.0], 1), (6, [0.5, 0.5], 1), (10, [-1.0, 0.0], 1)]
    got = sorted(map(tuple, forest.nearest(table(spark, few), F.col("vec_id") % 5 == 0).collect()))
    assert [r[:3] for r in got] == [(5, 1, 6), (5, 2, 10), (10, 1, 6), (10, 2, 5)]
    for odd in ([], [(None, None, None)], [(1, [0.0], 1)]):
        assert forest.nearest(table(spark, odd), F.col("vec_id") % 5 == 0).count() == 0
        assert rtree.hard_negatives(table(spark, odd), F.col("vec_id") % 5 == 0).count() == 0


def test_nearest_recall_over_the_table(spark):
    rows = Q.load(spark, "/root/testdata/sf0.1", "embeddings").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    got = {}
    for r in Q.op13_nearest_neighbours(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for i in np.flatnonzero(ids % 50 == 0):
        near = v @ v[i]
        near[i] = -2
        hits.append(len(got[ids[i]] & set(ids[np.argsort(-near)[:5]])) / 5)
    assert len(hits) == 40 and np.mean(hits) >= 0.9


def test_leaves_open_until_the_target_is_met():
    rng = np.random.default_rng(1)
    rows = rng.standard_normal((4000, 16))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    trees = [forest.grow(rows, 100, seed) for seed in range(3)]
    far, near = forest.opened(trees, rows[0], 0.3, 0.97), forest.opened(trees, rows[0], 0.99, 0.97)
    assert len(near) < len(far) / 4 and len(set(far)) == len(far)
    assert {(i, int(t.leaf_of(rows[:1])[0])) for i, t in enumerate(trees)} & set(near)
    all_of = Counter(i for i, _ in forest.opened(trees, rows[0], 0.3, 1.0))
    assert any(all_of[i] == t.leaves for i, t in enumerate(trees))


def phrases(texts, least, cover=50, top=2000):
    n, f = Counter(), Counter()
    for lang, text in texts:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[s : s + k])) for k in (1, 2, 3) for s in range(len(w) - k + 1))
    out = []
    rows = []
    for (lang, p), a in f.items():
        if len(p) == 1 or a < least:
            continue
        if any(f[lang, q] * 100 >= cover * a for (m, q), c in f.items() if m == lang and len(q) == 3 > len(p) and c >= least and p in (q[:2], q[1:])):
            continue
        score, _, l, r = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        rows.append((lang, -score, -a, " ".join(p).encode(), l, r))
    for lang in n:
        own = sorted(x for x in rows if x[0] == lang)[:top]
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (_, s, a, p, l, r) in enumerate(own)]
    return sorted(out)


TEXTS = [
    ("en", None), (None, ""), ("en", " \t\n.,"), (None, "New York is big. new york, New  York; NEW\tYORK!"), ("en", "a b c a b c a b c a b c"), ("en", "a b c a b c a b c a b c"), ("de", "straße é straße é straße é"), ("de", "a\rb a\nb a b a b a b"),
    ("fr", "un deux trois " * 40), ("fr", "x" * 5000), ("fr", "un deux " * 30 + "," * 30),
]


@pytest.mark.parametrize("block", [C.BLOCK, 16])
def test_collocations(spark, block, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", block)
    docs = spark.createDataFrame([(1, lang, t, 3) for lang, t in TEXTS], "doc_id long, lang string, text string, f int").repartition(2)
    got = C.collocations(docs, least=3)
    assert sorted(map(tuple, got.collect())) == phrases(TEXTS, 3)
    assert C.collocations(docs.limit(0)).count() == 0 and C.collocations(docs.where("text is null"), least=1).count() == 0


def test_collocations_report_the_first_of_a_language(spark):
    docs = spark.createDataFrame(TEXTS, "lang string, text string")
    assert sorted(map(tuple, C.collocations(docs, least=2, top=3).collect())) == phrases(TEXTS, 2, top=3)


def test_words_over_blocks(monkeypatch):
    text = ("Lorem ipsum, dolor  sit\tamet. " + "y" * 300 + " consectetur\n") * 50
    data = C.LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
    one = C.words_of(data)
    monkeypatch.setattr(C, "BLOCK", 64)
    for a, b in zip(one, C.words_of(data), strict=True):
        assert (a == b).all() or len(np.unique(a - b)) == 1
    assert len(one[0]) == len(re.findall(r"[^ \t.,;:!?\n-\r]+", text))


def test_merged_summaries_keep_what_is_frequent():
    """Whatever way the summaries are cut and merged, no key of ``least`` or more is lost, and a counter and what was taken from it bound its count."""
    rng = np.random.default_rng(9)
    stream = np.concatenate([rng.integers(0, 5000, 30_000), np.repeat(np.arange(6000, 6040), 40)]).astype(np.uint32)
    rng.shuffle(stream)
    true, least = Counter(stream.tolist()), 40
    capacity = len(stream) // least + 1
    keys, counts, lost = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64), 0
    for part in np.array_split(stream, 23):
        k, c = np.unique(part, return_counts=True)
        keys, counts, low = C.merged(np.concatenate([keys, k]), np.concatenate([counts, c]), capacity)
        lost += low
        assert len(keys) <= capacity
    got = dict(zip(keys.tolist(), counts.tolist(), strict=True))
    assert lost < least and all(got.get(k, 0) > 0 for k, f in true.items() if f >= least)
    assert all(c <= true[k] <= c + lost for k, c in got.items())
