"""Collocations: phrases whose parts stand together more often than apart.

First pass: Misra-Gries summaries of the n-grams' hashes, one for each hash
partition, merged in a bounded number of counters.  Their capacity exceeds the
partition's mass divided by the threshold, so that every frequent n-gram
survives.  Second pass: exact counts of the n-grams that survive, as texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastre.llm.arrow import byte_rows
from cadastre.llm.hashing import LOWER, U64, byte_symbols, mix, prefix_sums, range_hash
from cadastre.llm.tables import written

#: Words of a phrase at most, its least count, the share of its count at which a longer phrase covers it, phrases reported for a language.
WORDS, LEAST, COVER, TOP = 3, 10, 50, 2000
#: Bytes of text for one hash partition (a byte bounds 1.5 n-grams), and partitions at most.
SHARE, PARTS = 1 << 22, 1 << 16
#: Bits of the sieve that the second pass is given: 16 MB, whatever the corpus.
SIEVE_BITS = 27
#: Bytes whose words are hashed at once; n-grams that a task gathers before it sends them; phrases sent at once.
BLOCK, GATHER, SENT = 1 << 20, 1 << 20, 1 << 15
#: Parts in which a language's phrases are ranked first.
DEAL = 64

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and piece of each word of lower-cased bytes, block by block; no block ends within a word."""
    parts, at, before = [], 0, 0
    while at < len(data):
        end, step = min(len(data), at + BLOCK), BLOCK
        while end < len(data) and not len(gaps := np.flatnonzero(_GAP[data[at:end]])):
            step *= 2
            end = min(len(data), at + step)
        if end < len(data):
            end = at + int(gaps[-1]) + 1
        block = data[at:end]
        inside = np.zeros(len(block) + 2, dtype=np.int8)
        inside[1:-1] = ~_GAP[block]
        edge = np.diff(inside)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        breaks = np.cumsum(_BREAK[block]) + before
        if len(start):
            parts.append((range_hash(prefix_sums(byte_symbols(block)), start, stop), start + at, stop + at, breaks[start]))
        before, at = int(breaks[-1]), end
    if not parts:
        return np.empty(0, dtype=U64), *(np.empty(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def grams(words: np.ndarray, piece: np.ndarray, seed: np.uint64, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, first words, hashes) of the n-grams within pieces, for n up to ``most``."""
    key = words.copy()
    for n in range(1, most + 1):
        if n > 1:
            key = mix(key[: len(words) - n + 1] * U64(0x9E3779B97F4A7C15) + words[n - 1 :]) if len(words) >= n else key[:0]
        first = np.arange(len(key))
        fits = piece[: len(key)] == piece[n - 1 : n - 1 + len(key)] if n > 1 else slice(None)
        yield n, first[fits], mix(key[fits] ^ seed ^ U64(n))


def seed_of(lang: str) -> np.uint64:
    data = np.frombuffer(lang.encode(), dtype=np.uint8)
    return range_hash(prefix_sums(byte_symbols(data)), np.array([0]), np.array([len(data)]))[0]


def texts(batch: pa.RecordBatch, block: int = BLOCK) -> Iterator[tuple[str, np.ndarray]]:
    """(lang, lower-cased bytes) of a batch: texts of one language together, up to a block, a line break between them."""
    lang, data, size = None, [], 0
    for name, row in sorted(zip(batch["lang"].to_pylist(), byte_rows(batch["text"]), strict=True), key=lambda x: x[0]):
        if data and (name != lang or size + len(row) > block):
            yield lang, LOWER[np.concatenate(data)]
            data, size = [], 0
        lang = name
        data += [row, np.array([10], dtype=np.uint8)]
        size += len(row) + 1
    if data:
        yield lang, LOWER[np.concatenate(data)]


def merged(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Counters of equal keys added; if more than ``capacity`` are left, all are lowered by the largest that has no room, which is returned, and the empty ones go."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ keys.dtype.type(1))) if len(keys) else np.empty(0, dtype=np.int64)
    keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
    if len(keys) <= capacity:
        return keys, counts, 0
    lost = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    left = counts > lost
    return keys[left], counts[left] - lost, lost


def summaries(parts_log: int, most: int):
    """Of a task's texts: for each hash partition its n-grams' mass, and their hashes (32 further bits) with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, mass = 0, np.zeros(1 << parts_log, dtype=np.int64)

        def sent() -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            part = (keys >> U64(64 - parts_log)).astype(np.int64) if parts_log else np.zeros(len(keys), dtype=np.int64)
            # counts as bytes: a larger one takes several entries, which merge to their sum
            times = (counts + 254) // 255
            part, keys, last = np.repeat(part, times), np.repeat(keys, times), np.cumsum(times) - 1
            small = np.full(len(keys), 255, dtype=np.uint8)
            small[last] = counts - 255 * (times - 1)
            short = ((keys << U64(parts_log)) >> U64(32)).astype(np.uint32)
            at = np.flatnonzero(np.diff(part, prepend=-1))
            for low in range(0, len(at), 4096):
                ends = np.append(at, len(part))[low : low + 4097]
                own = [(int(part[a]), short[a:b].tobytes(), small[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in own], pa.int64()), pa.array([1] * len(own), pa.int32()), pa.array([0] * len(own), pa.int64()), pa.array([o[1] for o in own], pa.binary()), pa.array([o[2] for o in own], pa.binary())], ["part", "kind", "mass", "keys", "counts"])

        for batch in batches:
            for lang, data in texts(batch):
                words, _, _, piece = words_of(data)
                for _, _, keys in grams(words, piece, seed_of(lang), most):
                    held.append(keys)
                    size += len(keys)
                    part = (keys >> U64(64 - parts_log)).astype(np.int64) if parts_log else np.zeros(len(keys), dtype=np.int64)
                    mass += np.bincount(part, minlength=len(mass))
                if size >= GATHER:
                    yield from sent()
                    held, size = [], 0
        if size:
            yield from sent()
        at = np.flatnonzero(mass)
        empty = pa.nulls(len(at), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.zeros(len(at)), pa.int32()), pa.array(mass[at]), empty, empty], ["part", "kind", "mass", "keys", "counts"])

    return run


def survivors(bits: int, least: int):
    """Of a partition's summaries, masses first: those merged by Misra-Gries, and the bits of what may reach ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, keys, counts, held, lost = None, 0, [], [], 0, 0

        def shrunk() -> None:
            nonlocal keys, counts, held, lost
            if keys:
                k, c, low = merged(np.concatenate(keys), np.concatenate(counts).astype(np.int64), mass // least + 1)
                keys, counts, held, lost = [k], [c], len(k), lost + low

        def ended() -> Iterator[pa.RecordBatch]:
            if part is None:
                return
            shrunk()
            fits = keys[0][counts[0] + lost >= least] if keys else np.empty(0, dtype=np.uint32)
            sieve = np.zeros(1 << max(bits - 3, 0), dtype=np.uint8)
            at = (fits >> np.uint32(32 - bits)).astype(np.int64) if bits else np.zeros(len(fits), dtype=np.int64)
            np.bitwise_or.at(sieve, at >> 3, (1 << (at & 7)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([sieve.tobytes()], pa.binary()), pa.array([len(fits)], pa.int64())], ["part", "sieve", "n"])

        for batch in batches:
            for p, kind, m, k, c in zip(*(batch[x] for x in ("part", "kind", "mass", "keys", "counts")), strict=True):
                if p.as_py() != part:
                    yield from ended()
                    part, mass, keys, counts, held, lost = p.as_py(), 0, [], [], 0, 0
                if kind.as_py() == 0:
                    mass += m.as_py()
                    continue
                keys.append(np.frombuffer(k.as_buffer(), dtype=np.uint32))
                counts.append(np.frombuffer(c.as_buffer(), dtype=np.uint8))
                held += len(keys[-1])
                if held > 2 * (mass // least + 1) + GATHER:
                    shrunk()
        yield from ended()

    return run


def phrases_at(whole: bytes, start: np.ndarray, end: np.ndarray, at: np.ndarray, n: int) -> list[str]:
    """The phrases of n words from the words ``at``, their words joined by one blank."""
    plain = end[at + n - 1] - start[at] == sum(end[at + i] - start[at + i] for i in range(n)) + n - 1  # one byte between words
    runs = zip(at.tolist(), start[at].tolist(), end[at + n - 1].tolist(), plain.tolist(), strict=True)
    return [(whole[s:e].replace(b"\t", b" ") if p else b" ".join(whole[start[a + i] : end[a + i]] for i in range(n))).decode() for a, s, e, p in runs]


def table_of(lang: str, phrases: list[str | None], n: int, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(f)), pa.array(phrases, pa.string()), pa.array(np.full(len(f), n, dtype=np.int32)), pa.array(f.astype(np.int64))], ["lang", "phrase", "words", "f"])


def counted(sieve, parts_log: int, bits: int, most: int):
    """Of a batch's texts: (lang, phrase, words, f) of the n-grams that the sieve holds, and the count of all words (phrase null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(sieve.value, dtype=np.uint8)
        for batch in batches:
            for lang, data in texts(batch, 2 * BLOCK):
                words, start, end, piece = words_of(data)
                yield table_of(lang, [None], 0, np.array([len(words)]))
                whole = data.tobytes()
                for n, first, keys in grams(words, piece, seed_of(lang), most):
                    index = keys >> U64(64 - parts_log - bits)
                    fits = np.flatnonzero(table[(index >> U64(3)).astype(np.int64)] >> (index & U64(7)).astype(np.uint8) & 1)
                    _, at, count = np.unique(keys[fits], return_index=True, return_counts=True)
                    at = first[fits[at]]
                    for low in range(0, len(at), SENT):
                        yield table_of(lang, phrases_at(whole, start, end, at[low : low + SENT], n), n, count[low : low + SENT])

    return run


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """(lang, phrase, words, f): exact counts of all phrases of up to ``words`` words that occur ``least`` times or more, and of all words (phrase null)."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts_log = max(0, min(PARTS, -(-size // share)) - 1).bit_length()
    bits = SIEVE_BITS - parts_log
    sums = rows.mapInArrow(summaries(parts_log, words), "part long, kind int, mass long, keys binary, counts binary")
    # masses come first, so that a partition's capacity is known before its counters
    left = sums.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(survivors(bits, least), "part long, sieve binary, n long")
    sieve = np.zeros(1 << (SIEVE_BITS - 3), dtype=np.uint8)
    width = 1 << (bits - 3)
    for r in left.collect():  # its bytes are those of the sieve, 16 MB in all
        sieve[r.part * width : (r.part + 1) * width] = np.frombuffer(r.sieve, dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(sieve.tobytes())
    found = rows.mapInArrow(counted(shared, parts_log, bits, words), "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("phrase").isNull() | (F.col("f") >= least))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, cover: int = COVER, top: int = TOP, words: int = WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two to ``words`` words.

    Words are ASCII-lower-cased; a phrase stays within a piece between marks
    or line ends.  a, l, r are the counts of the phrase and of the parts of its
    weakest cut, n of all words of its language, score is floor(1000000 a a / (l r)).
    A phrase inside a longer one with at least ``cover`` hundredths of its count is left out.

    A null text is empty, a null language is ``und``; repeated rows count each; texts
    without words and empty tables give no rows; other columns are ignored.
    Products are exact while counts are under 10^15.
    """
    counts = written(frequent(docs, text, lang, least, words), "phrases")
    known = counts.where(F.col("phrase").isNotNull()).select("lang", "phrase", "words", F.col("f").cast("decimal(18,0)").alias("f"))
    total = counts.where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))
    candidates = known.where("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = candidates.select("lang", "phrase", "words", "f", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "w").select(
        "lang", "phrase", "words", "f", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest")
    )
    part = known.select("lang", "phrase", "f")
    cuts = cuts.join(part.toDF("lang", "head", "l"), ["lang", "head"]).join(part.toDF("lang", "rest", "r"), ["lang", "rest"])
    score = F.expr("(f * f * 1000000BD) div (l * r)")
    worst = cuts.groupBy("lang", "phrase", "words", "f").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # phrases inside longer candidates: every shorter run of two words or more
    inner = candidates.where("words > 2").select(
        "lang", "f", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda s: F.array_join(F.slice("w", s, n), " "))))).alias("phrase")
    )
    longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = worst.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer"), F.lit(0)) * 100 < F.col("f") * cover)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    flat = left.select("lang", "phrase", F.col("f").cast("long").alias("a"), F.col("cut.l").cast("long").alias("l"), F.col("cut.r").cast("long").alias("r"), F.col("cut.score").cast("long").alias("score"))
    first = flat.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(DEAL))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(total) if total.count() <= 100_000 else total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows in DuckDB's SQL.
SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM texts),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, k AS words, array_to_string(w[s:s + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM pieces, (SELECT unnest([1, 2, 3]) AS k))),
f AS (SELECT lang, words, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
cuts AS (SELECT c.*, unnest(range(1, words)) AS k FROM cand c),
scored AS (
  SELECT c.lang, c.phrase, c.words, c.f, c.k, l.f AS l, r.f AS r, (1000000 * c.f * c.f) // (l.f * r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
worst AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS i FROM scored),
longer AS (
  SELECT lang, p AS phrase, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS p FROM cand WHERE words = 3) GROUP BY lang, p),
ranked AS (
  SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, w.f DESC, w.phrase) AS rank, w.phrase, w.f AS a, w.l, w.r, score
  FROM worst w LEFT JOIN longer g ON g.lang = w.lang AND g.phrase = w.phrase WHERE i = 1 AND coalesce(100 * g.f, 0) < 50 * w.f)
SELECT r.lang, r.rank::INTEGER AS rank, r.phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked r JOIN total t ON t.lang = r.lang WHERE rank <= 2000
"""
