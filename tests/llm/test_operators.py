"""The ten operators and the pipeline against brute force on a small fixture with all odd cases."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastre.llm import queries as Q
from cadastre.llm.components import components
from cadastre.llm.decontamination import contamination, decontaminated
from cadastre.llm.fingerprints import fingerprints
from cadastre.llm import fingerprints as fp
from cadastre.llm import jaccard
from cadastre.llm.jaccard import jaccard_join
from cadastre.llm.licences import TEXTS as LICENCE_TEXTS
from cadastre.llm.licences import WINDOWS, all_texts, licence_scan
from cadastre.llm.mixing import mix, mixed
from cadastre.llm.repeats import Windows, repeated_windows
from cadastre.llm.secrets import BASE as BASE_KINDS
from cadastre.llm.secrets import COMPLETED_BY, KINDS, SCOPE, WEAK, secret_spans
from cadastre.llm.substrings import suffix_dedup, window_dedup
from cadastre.llm.windows import counted_windows
from cadastre.llm.tables import identified, written
from cadastre.llm.tokens import FRAME, read_documents, read_tokens, write_tokens
from cadastre.llm.toxicity import CUT, features, train, with_toxicity

BASE = " ".join(f"word{i % 37}x{i * 7 % 101}" for i in range(400))
OTHER = " ".join(f"Ünlike{i * 13 % 211}é" for i in range(300))
TEXTS = [
    None, "", " \n\t ", "one", "One", "a b c d", "a b c d e f", "a b c d e f g", BASE, BASE, BASE + " tail end", BASE.replace("word3x", "Word3x"), OTHER, OTHER[50:],
    "ab" * 400, "xyz " * 300, BASE[:700] + OTHER[:900], OTHER[:900] + BASE[300:1500], "k " + " ".join(f"s{i}" for i in range(9)), " ".join(f"s{i}" for i in range(8)),
]
SCHEMA = "doc_id long, text string, source string, lang string, k long, t string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, x, (None, "b", "a")[i % 3], ("en", None)[i % 2], 7, "clash") for i, x in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_suffix_dedup(docs, empty):
    got, seen = by_id(suffix_dedup(docs)), set()
    for i, x in enumerate(TEXTS):
        data = (x or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        r = got[i * 3]
        assert (r.n_units, r.n_removed, r.n_spans, bytes(r.kept)) == (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept)
    assert suffix_dedup(empty).count() == 0


def test_window_dedup_and_heavy_triggers(docs, empty):
    got, seen = by_id(window_dedup(docs)), set()
    for i, x in enumerate(TEXTS):
        words = re.findall(r"[^\x20\x09-\x0D]+", x or "")
        gone = [0] * len(words)
        windows = [tuple(words[s : s + 13]) for s in range(len(words) - 12)]
        for s, w in enumerate(windows):
            if w in seen:
                gone[s : s + 13] = [1] * 13
        seen.update(windows)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        assert (got[i * 3].n_units, got[i * 3].n_removed, got[i * 3].kept_sha256) == (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert window_dedup(empty).count() == 0
    for w in (Windows("words", 13, 4, False), Windows("bytes", 100, 16, True)):
        cover = lambda df, size=w.size: {(r.k, r.x): {a + j for a, n in r.ranges for j in range(n)} for r in df.collect()}
        assert cover(repeated_windows(identified(docs), w, light=0)) == cover(repeated_windows(identified(docs), w))
    w = Windows("words", 13, 4, False)
    assert cover(counted_windows(identified(docs), w)) == cover(counted_windows(identified(docs), w, group=1)) == cover(repeated_windows(identified(docs), w)) != {}


def test_removal_among_rows_that_share_a_key(spark):
    long = BASE[:900]
    rows = [(5, long + " one more"), (5, "short"), (5, "other " + long), (5, "short"), (None, OTHER[:600]), (None, "x " + OTHER[:600]), (None, None), (9, long), (7, OTHER[:300] + OTHER[:300])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    several = {None, 5}
    keys = sorted({(-1 if k is None else k, hashes[x] if k in several else 0, x or "") for k, x in rows})
    seen_bytes, seen_words, expected = set(), {}, {}
    for k, _, x in keys:
        data, words = x.encode(), x.split()
        gone, out = [0] * len(data), [0] * len(words)
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen_bytes:
                gone[s : s + 100] = [1] * 100
            seen_bytes.add(data[s : s + 100])
        for s in range(len(words) - 12):
            if seen_words.setdefault(tuple(words[s : s + 13]), k) < k:
                out[s : s + 13] = [1] * 13
        expected[k, x] = (len(data), sum(gone)), (len(words), sum(out))
    for i, remove in enumerate((suffix_dedup, window_dedup)):
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_units, r.n_removed) for r in remove(docs).collect())
        assert got == sorted((-1 if k is None else k, *expected[-1 if k is None else k, x or ""][i]) for k, x in rows)


def test_jaccard_join(docs, empty):
    def shingles(x):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(x) for x in TEXTS]
    label = list(range(len(sets)))
    for _ in sets:
        for i, p in enumerate(sets):
            for j, q in enumerate(sets):
                if p and q and 100 * len(p & q) >= 80 * len(p | q):
                    label[i] = label[j] = min(label[i], label[j])
    got = by_id(jaccard_join(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i * 3: (len(p), label[i] * 3) for i, p in enumerate(sets)}
    assert jaccard_join(empty).count() == 0


def components_by_brute_force(texts):
    sets = [{tuple(x.split()[i : i + 5]) for i in range(len(x.split()) - 4)} for x in texts]
    to = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 100 * len(x & y) >= 80 * len(x | y):
                to = [min(to[i], to[j]) if c in (to[i], to[j]) else c for c in to]
    return to


def test_jaccard_join_of_short_texts_with_a_common_line(spark, monkeypatch):
    common = " ".join(f"common{i}" for i in range(11))
    texts = [f"{common} " + " ".join(f"own{i}x{j}" for j in range(4 + i % 8)) for i in range(600)]
    texts += [x + " end" for x in texts[::40]] + [f"{common} own{i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = spark.createDataFrame([(i, 0, x) for i, x in enumerate(texts)], "k long, x long, text string").mapInArrow(jaccard._sets, "k long, x long, n int, f long, g long, first binary")
    expected = components_by_brute_force(texts)
    for heavy, most, block in ((64, 1_000_000, 2048), (4, 3, 8)):
        monkeypatch.setattr(jaccard, "HEAVY", heavy)
        monkeypatch.setattr(jaccard, "HEAVY_MOST", most)
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "SUBSETS_MOST", 0)  # inverted lists for all
        lists = jaccard._inverted_lists(own.select("k", "n", "first"))
        assert lists.where("not often").groupBy("t").count().agg(F.max("count")).first()[0] <= heavy
        got = by_id(jaccard_join(docs))
        assert [got[i].component_id for i in range(len(texts))] == expected


def test_jaccard_join_of_a_loose_group_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    text = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(500):
        words = list(text)
        for j in rng.sample(range(len(words)), rng.randrange(1, 9)):
            words[j] = f"new{rng.randrange(60)}"
        texts.append(" ".join(words if i % 7 else words[: rng.randrange(90, 120)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = components_by_brute_force(texts)
    assert 20 < len(set(expected)) < 480
    for block, shingles, share in ((2048, 1 << 20, 4096), (40, 1 << 20, 3), (2048, 3000, 64)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", shingles)
        monkeypatch.setattr(jaccard, "SHARE", share)
        got = by_id(jaccard_join(docs))
        assert [got[i].component_id for i in range(len(texts))] == expected


def test_common_shingles_of_blocks():
    rng = np.random.default_rng(3)
    own = [np.unique(np.append(rng.integers(0, 400, 60), rng.integers(0, 4000, 30))).astype(np.uint64) for _ in range(90)]
    row, column = np.repeat(np.arange(90), [len(x) for x in own]), np.concatenate(own).astype(np.int64)
    own.append(np.empty(0, dtype=np.uint64))  # a last member of which nothing is left
    left, right = np.arange(0, 91, 3), np.setdiff1d(np.arange(91), np.arange(0, 91, 3))
    for one, two in ((left, right), (np.arange(91), np.arange(91))):
        assert (jaccard._counts(row, column, one, two) == [[len(np.intersect1d(own[i], own[j])) for j in two] for i in one]).all()


def test_near_duplicates_of_shared_keys_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, 1), (None, "quite another text of some words", 2), (None, text + " end", 3), (5, "one text here", 4), (5, "some other text here", 5), (5, "one text here", 6), (7, text, 7), (8, None, 8), (8, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int")
    got = jaccard.without_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = sorted(r.k for r in got.collect())
    assert len(kept) == 6 and {2, 5, 8, 9} <= set(kept) and len({1, 3} & set(kept)) == 1 and len({4, 6} & set(kept)) == 1
    assert jaccard.without_near_duplicates(docs.where("false")).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components(links).collect()} == {0}
    assert components(links.where("false")).count() == 0


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, BASE[:300]), (2, "S0 s1, s2"), (3, None), (4, "..."), (10, OTHER.upper()), (None, "a b")], "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda x: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    windows = {}
    for r in bench.collect():
        w = words(r.text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(r.item_id)
    got = by_id(contamination(docs, bench))
    for i, x in enumerate(TEXTS):
        w, hit, items = words(x), set(), set()
        for key, ids in windows.items():
            for s in range(len(w) - len(key) + 1):
                if tuple(w[s : s + len(key)]) == key:
                    hit |= set(range(s, s + len(key)))
                    items |= ids - {None}
        r = got[i * 3]
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (len(w), len(hit), sorted(map(str, items)), bool(hit))
    assert decontaminated(docs, bench).columns == docs.columns and decontaminated(docs, bench).count() == sum(not r.contaminated for r in got.values())
    cut = by_id(decontaminated(docs, bench, spans=True))
    assert all(len(words(cut[i].text)) == r.n_words - r.n_hit for i, r in got.items())
    assert contamination(empty, bench).count() == 0 and not contamination(docs, bench.where("false")).where("contaminated").count()


def test_names_that_clash(spark, docs):
    more = docs.withColumns({c: F.lit(1) for c in ("key", "hash", "runs", "words", "Gaps", "from", "size", "times", "copy", "_key", "score", "threshold")})
    bench = spark.createDataFrame([(1, BASE[:300])], "item_id long, text string")
    for spans in (False, True):
        assert decontaminated(more, bench, spans=spans).columns == more.columns
        assert decontaminated(more, bench, spans=spans).count() == decontaminated(docs, bench, spans=spans).count()
    assert mixed(more).columns == more.columns and mixed(more).count() == mixed(docs).count()


def test_pipeline_stages(spark):
    """Each stage on what the one before kept, against brute force, at the smallest scale."""
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150).withColumn("score", F.lit("clash"))
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    stages, kept = dict(P.STAGES), docs
    assert [*stages] == ["toxicity", "near_duplicates", "decontamination", "mixing", "tokens"]
    after, model = written(stages["toxicity"](spark, kept, sf), "t"), train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    below = lambda r: model.score(features(np.frombuffer((r.text or "").encode(), dtype=np.uint8))) < model.thresholds.get(r.lang, CUT)
    assert after.columns == docs.columns and sorted(map(str, after.collect())) == sorted(str(r) for r in docs.collect() if below(r))
    kept, before = written(stages["near_duplicates"](spark, after, sf), "t"), after.collect()
    cut = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) for r in before]
    sets, to = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in cut], list(range(len(cut)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                to = [min(to[i], to[j]) if c in (to[i], to[j]) else c for c in to]
    assert kept.columns == docs.columns and kept.count() == len(set(to)) < len(before)
    clean = written(stages["decontamination"](spark, kept, sf), "t")
    pattern, words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    windows = {tuple(w[i : i + min(10, len(w))]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for w in [words(r.text)] if w for i in range(max(1, len(w) - 9))}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    assert sorted(r.text or "" for r in clean.collect()) == sorted(r.text or "" for r in kept.collect() if not hit(words(r.text)))
    mix_ = written(stages["mixing"](spark, clean, sf), "t")
    taken = {(r.doc_id, r.size): r for r in mix(clean).collect()}
    counts = Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in mix_.collect())
    assert all(n == (1 if k[1] == 0 else taken[k].taken // k[1]) for k, n in counts.items())
    ids = stages["tokens"](spark, mix_, sf).collect()
    assert len(ids) == mix_.count() and sum(r.n_tokens for r in ids) == max(r.start + r.n_tokens for r in ids)


def test_mixing(docs, empty):
    rows = mix(docs).collect()
    assert all(r.taken <= 3 * r.size for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert own[0].source_size == sum(r.size for r in own) and abs(sum(r.taken for r in own) - own[0].target) <= 2 + len(own)
    assert sorted(map(tuple, mix(docs.repartition(2)).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert mixed(docs).columns == docs.columns and mix(empty).count() == 0


def test_secrets(spark):
    key, blob = "AKIA" + "A1B2C3D4E5F6G7H8", "abcdEFGH1234" * 4
    texts = [None, "", f"é {key} then {blob} and https://host/x Password = 'hunter22'", f"{blob} https://host/x", "secret:token:abcdefgh token=abc", "0123456789abcdef01234567 x"]
    docs = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)] + [(2, texts[2], 1)], "doc_id long, text string, kind int")
    got = [r for r in secret_spans(docs).collect() if r.doc_id == 2]
    assert len(got) == 2 and got[0] == got[1]
    r = got[0]
    assert (r.n_assign, r.n_access, r.n_hex) == (1, 1, 0) and "access:2:22" in r.base and "blob:" in r.spans and "endpoint:" in r.spans
    rest = {r.doc_id: r.spans for r in secret_spans(docs).collect()}
    assert rest[0] == rest[1] == rest[3] == rest[4] == "" and rest[5] == "hex:0:24"


def secrets_by_brute_force(text):
    found = [(m.start(), number, m.end()) for number, (_, pattern, least, group) in enumerate((*BASE_KINDS, *WEAK)) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    base = [x for x in found if x[1] < len(BASE_KINDS)]
    kept = list(base)
    for s, number, e in found:
        if number >= len(BASE_KINDS) and not any(a <= s and b >= e for a, _, b in base):
            others = {KINDS[kind] for a, kind, b in found if a <= e + SCOPE and b >= s - SCOPE}
            if all(others & set(group) for group in COMPLETED_BY[KINDS[number]]):
                kept.append((s, number, e))
    return ",".join(f"{KINDS[kind]}:{s}:{e}" for s, kind, e in sorted(kept))


def test_secrets_of_long_values(spark):
    identifier, endpoint, key = "ASIA" + "Q7W8E9R0T1Y2", "https://host/x", "AKIA" + "A1B2C3D4E5F6G7H8"
    texts = []
    for size in (48, 399, 400, 801, 5000):
        strong = ["token=" + "aB3-" * (size // 4), "0123456789abcdef" * (size // 16 + 2), "abcdEFGH1234" * (size // 12 + 4)]
        for gap in (1, SCOPE, SCOPE + 1):
            for weak in (identifier, endpoint, f"{identifier} {endpoint}", "Zz9/" * (size // 4 + 10)):
                texts += [x for long in strong for x in (long + "!" * gap + weak, weak + "!" * gap + long)]
            texts += [key + "!" * gap + strong[2], strong[2] + "!" * gap + key]
    got = by_id(secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i].spans for i in range(len(texts))] == [secrets_by_brute_force(x) for x in texts]
    assert "identifier" in got[texts.index("token=" + "aB3-" * 1250 + "!" + identifier)].spans


def test_fingerprints(docs, empty):
    got = by_id(fingerprints(docs, buckets=3))
    for i, x in enumerate(TEXTS):
        x, following = x or "", TEXTS[(i + 1) % len(TEXTS)] or ""
        q = len(x) // 4
        r = got[i * 3]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256((x[: len(x) - q] + following[:q]).encode()).hexdigest())
        assert 0 <= r.near_edited <= 1
    assert got[24].fingerprint == got[27].fingerprint and got[24].near_next == 1.0 and got[36].near_next > 0.8
    assert fingerprints(empty, buckets=2).count() == 0


def test_sketches_against_all_shingles(spark, docs):
    texts = [*TEXTS, " ".join(f"u{i}" for i in range(3000)), " ".join(f"u{i}" for i in range(400)), " ".join(f"u{i}" for i in range(350, 420))]
    words = [re.findall(r"[^\x20\x09-\x0D]+", x or "") for x in texts]
    shingles = [[w[i : i + 5] for i in range(max(1, len(w) - 4))] if w else [] for w in words]
    rows = spark.createDataFrame([(i, w) for i, ws in enumerate(shingles) for w in ws], "i int, w array<string>")
    hashes = [set() for _ in texts]
    for r in rows.select("i", F.xxhash64("w").bitwiseAND(F.lit((1 << 63) - 1)).alias("h")).collect():
        hashes[r.i].add(r.h)

    def kept(own):
        low = sorted(h for h in own if h < fp.LIMIT)
        if len(low) >= fp.FLOOR:
            return low, fp.LIMIT
        least = sorted(own)[: fp.FLOOR]
        return least, (1 << 63) - 1 if len(least) < fp.FLOOR else least[-1]

    pairs = spark.createDataFrame([(i, j, texts[i], texts[j]) for i in range(len(texts)) for j in range(len(texts))], "i int, j int, a string, b string")
    s, t = fp.sketch(F.col("a")), fp.sketch(F.col("b"))
    pairs = pairs.select("i", "j", s.alias("s"), t.alias("t")).select("i", "j", "s", fp.fingerprint(F.col("s")).alias("text"), fp.likeness(F.col("s"), F.col("t")).alias("near"), fp.containment(F.col("s"), F.col("t")).alias("part"), fp.merged(F.col("s"), F.col("t")).alias("both"))
    for r in pairs.collect():
        (x, xup), (y, yup) = kept(hashes[r.i]), kept(hashes[r.j])
        assert (list(r.s.h), r.s.upto) == (x, xup) and r.text == f"{xup:X}:" + ",".join(f"{h:X}" for h in x)
        upto = min(xup, yup)
        p, q = {h for h in x if h <= upto}, {h for h in y if h <= upto}
        assert r.near == (len(p & q) / len(p | q) if p | q else 1.0) and r.part == (len(p & q) / len(p) if p else 1.0)
        assert (list(r.both.h), r.both.upto) == (sorted(h for h in hashes[r.i] | hashes[r.j] if h <= upto), upto)
    whole, part = len(TEXTS), len(TEXTS) + 1
    assert any(r.i == part and r.j == whole and r.part > 0.95 for r in pairs.collect())


def test_fingerprints_of_rows_that_share_a_key(spark):
    rows = [(k, f"{k} text {i} " + " ".join(f"w{j * i % 7}" for j in range(8 + i))) for i in range(40) for k in (None, 3, i)] + [(3, "same"), (3, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], hashes[r[1]]))
    expected = []
    for i, (k, x) in enumerate(ordered):
        q, following = len(x) // 4, ordered[(i + 1) % len(ordered)][1]
        expected.append((str(k), hashlib.sha256((x[: len(x) - q] + following[:q]).encode()).hexdigest()))
    for buckets in (1, 2, 16):
        got = fingerprints(docs, buckets=buckets).collect()
        assert sorted((str(r.doc_id), r.edited_sha256) for r in got) == sorted(expected)


def test_licences(spark, empty):
    rows = [(1, "/p/LICENSE", "Released under the MIT License."), (2, "/p/a/b/x.py", "code"), (3, "/q/y.py", None), (4, "/p/z", "x\nLicensed under the Apache License, Version 2.0."), (5, None, "text"), (5, None, "text")]
    got = licence_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert {(r.doc_id, r.licence, r.origin) for r in got} == {(1, "MIT", "own"), (2, "MIT", "inherited"), (3, None, None), (4, "Apache-2.0", "own"), (5, None, None)} and len(got) == 6
    assert licence_scan(empty.withColumn("path", F.lit("/x"))).count() == 0


def test_licences_of_whole_texts_and_wrapped_headers(spark):
    clauses = ["Permission is hereby granted, free of charge, to any person obtaining a copy", "of this software and associated documentation files (the \"Software\"), to deal", "in the Software without restriction, including without limitation the rights", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell", "copies of the Software, and to permit persons to whom the Software is", "furnished to do so, subject to the following conditions:"]
    header = ["Licensed under the Apache License, Version 2.0 (the \"License\");", "you may not use this file except in compliance with the License.", "You may obtain a copy of the License at", "", "    http://www.apache.org/licenses/LICENSE-2.0", "", "Unless required by applicable law or agreed to in writing, software", "distributed under the License is distributed on an \"AS IS\" BASIS,", "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "See the License for the specific language governing permissions and", "limitations under the License."]
    code = [f"value{i} = compute{i}(alpha{i}, beta{i})" for i in range(80)]
    whole = {p.name.removesuffix(".txt"): p.read_text() for p in sorted(LICENCE_TEXTS.glob("*.txt")) if not p.name.endswith(".header.txt")}
    rows = [(f"/{name}/LICENSE", f"Copyright (c) 2019 Some One\nAll rights reserved.\n\n{x[: len(x) // 3]}additional words{x[len(x) // 3 :]}") for name, x in whole.items()] + [(f"/{name}/src/a.py", "x = 1") for name in whole]
    expected = [(name, o) for o in ("own", "inherited") for name in whole]
    rows += [("/h/a.py", "\n".join(["# " + x for x in header] + code)), ("/h/b.py", "\n".join([*code, "// This work is licensed under", "// the GNU General Public", "// License, version 3.", *code])), ("/h/m.c", "\n".join(["/*", *clauses, "*/", *code])), ("/h/c.py", "\n".join(code)), ("/h/p.txt", "we use the software of the files and copy them\nto the other folder")]
    expected += [("Apache-2.0", "own"), ("GPL-3.0", "own"), ("MIT", "own"), (None, None), (None, None)]
    got = by_id(licence_scan(spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, path string, text string")))
    assert [(rows[i][0], got[i].licence, got[i].origin) for i in range(len(rows))] == [(x[0], *y) for x, y in zip(rows, expected, strict=True)]


def licences_by_brute_force(rows, similar):
    """(licence, cosine) of each text by all its segments, without any filter."""
    terms = lambda x: [w for w in re.split("[^0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), x)) if w]
    models = [(name, Counter(terms(x))) for name, x in sorted(all_texts())]
    vocabulary = {w for _, m in models for w in m}
    lines = [terms(line) for x in rows for line in x.split("\n") if line.strip()]
    total, df = len(lines), Counter(w for line in lines for w in set(line))
    idf = lambda w: math.log((total + 1) / (df[w] + 1)) if w in vocabulary else math.log((total + 1) / 2)
    vectors = [(name, {w: n * idf(w) for w, n in m.items()}) for name, m in models]
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = []
    for x in rows:
        own = [t for t in map(terms, x.split("\n")) if t]
        spans = {(len(own), 0)} | {(w, i) for w in (1, *WINDOWS) if w < len(own) for i in {*range(0, len(own) - w + 1, max(1, w // 4)), len(own) - w}} if own else set()
        found = []
        for size, at in spans:
            v = Counter(w for t in own[at : at + size] for w in t)
            if sum(n for w, n in v.items() if w in vocabulary) >= 2:
                v = {w: n * idf(w) for w, n in v.items()}
                for name, m in vectors:
                    cosine = round(sum(c * m.get(w, 0) for w, c in v.items()) / (norm(v) * norm(m)), 9) if norm(v) * norm(m) else 0
                    if cosine >= similar:
                        found.append((name == "Proprietary", -cosine, name))
        out.append((min(found)[2], -min(found)[1]) if found else (None, None))
    return out


def test_licences_against_all_segments(spark):
    rng = random.Random(11)
    vocabulary = "software license version permission copy free public general modify notice the of and to any use MIT Apache BSD GNU rights reserved copyright under".split()
    texts = []
    for i in range(120):
        lines = [" ".join(rng.choice(vocabulary) if rng.random() < i % 6 / 5 else f"x{rng.randrange(500)}" for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(1, 9))]
        texts.append("\n".join(lines))
    texts += ["Released under the MIT License and six other words on line", "Released under\nthe MIT\n\nLicense", "", "MIT", "mit mit mit", "All rights reserved."]
    rows = spark.createDataFrame([(i, f"/{i}/a", x) for i, x in enumerate(texts)], "doc_id long, path string, text string")
    for similar in (0.6, 0.35):
        got, expected = by_id(licence_scan(rows, similar=similar)), licences_by_brute_force(texts, similar)
        assert [got[i].licence for i in range(len(texts))] == [x for x, _ in expected]
        assert all(y is None or abs(got[i].similarity - y) < 1e-6 for i, (_, y) in enumerate(expected))
    assert expected[120][0] == "MIT"


def test_tokens_round_trip(docs, empty):
    from tokenizers import Tokenizer

    spec = Q.tokenizer_spec()
    coder = Tokenizer.from_str(spec)
    shards, at = write_tokens(docs, spec), 0
    got = by_id(read_tokens(shards))
    for i, x in enumerate(TEXTS):
        ids = [*coder.encode(x or "", add_special_tokens=False).ids, 1]
        r = got[i * 3]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    one = read_documents(shards, [24]).collect()
    assert [len(r.ids) for r in one] == [got[24].n_tokens]
    assert read_tokens(write_tokens(empty, spec)).count() == 0


def test_tokens_of_a_document_over_several_frames(spark):
    from tokenizers import Tokenizer

    spec = Q.tokenizer_spec()
    long = " ".join(f"alpha{i % 977} beta, Gamma{i % 13}." for i in range(40_000))
    docs = spark.createDataFrame([(1, "first words"), (2, long), (2, "same key"), (None, "no key"), (3, "last words")], "doc_id long, text string").repartition(1)
    shards, coder = write_tokens(docs, spec), Tokenizer.from_str(spec)
    ids = [*coder.encode(long, add_special_tokens=False).ids, 1]
    assert len(ids) > 2 * FRAME
    row = next(r for r in read_tokens(shards).collect() if r.n_tokens == len(ids))
    assert row.doc_id == 2 and row.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
    read = {(r.doc_id, len(r.ids)): list(r.ids) for r in read_documents(shards, [2, 3, None]).collect()}
    assert len(read) == 4 and read[2, len(ids)] == ids


def test_toxicity(spark, empty):
    rows = [(i, f"calm words number {i * 7 % 50} here " * 5 + ("vile" + "abcdefgh"[i % 8 :] if i % 4 == 0 else ""), "en", i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, *_ in rows], "doc_id long, toxic int")
    model = train(docs, labels)
    scored = with_toxicity(docs.unionByName(spark.createDataFrame([(900, None, None, 0), (901, "", "en", 0)], docs.schema)), model).collect()
    assert len(scored) == 402 and all(0 <= r.score <= 1 for r in scored)
    assert sum((r.score >= 0.3) == (r.doc_id % 4 == 0) for r in scored if r.doc_id < 900) > 390
    assert train(docs, labels.where("toxic = 0")) is None and with_toxicity(empty, None).count() == 0
