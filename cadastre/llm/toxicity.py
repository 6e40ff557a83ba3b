"""Operator 4: convolutional toxicity classifier over hashed word embeddings, in numpy.

A word's embedding is the sum of the embeddings of its hash and of the hashes
of its first 4, 5 and 6 bytes, so that unseen forms of a stem are known too.
Filters of widths 1 to 3 run over a text's words; the maximum of each over the
whole text feeds a logistic output.  Fitted on the driver from a bounded sample
of labelled rows; every row is scored in Arrow batches on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.llm import hashing
from cadastre.llm.arrow import byte_rows

BUCKETS = 1 << 15
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6)
#: Bound of the training sample: rows of each class, and bytes of a row's text.
TOXIC_ROWS, CLEAN_ROWS, ROW_BYTES = 2000, 5000, 200_000
EPOCHS = 6
#: Score at which a text counts as toxic if its language has no threshold of its own.
CUT = 0.3
#: Labelled rows of each class that a language's own threshold needs.
LANGUAGE_ROWS = 25

#: Bytes inside words: digits, letters and everything beyond ASCII.
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def features(data: np.ndarray) -> np.ndarray:
    """Buckets of each word of a text: one column for the word, one for each prefix."""
    data = hashing.LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _WORD[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = hashing.prefix_sums(hashing.byte_symbols(data))
    columns = [hashing.range_hash(sums, start, end)]
    columns += [hashing.range_hash(sums, start, np.minimum(start + p, end)) ^ np.uint64(p) for p in PREFIXES]
    return np.stack([(c >> np.uint64(49)).astype(np.uint16) for c in columns], axis=1)


@dataclass
class Model:
    embedding: np.ndarray  # BUCKETS x DIM
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float
    scale: float = 1.0
    thresholds: dict | None = None

    def pooled(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedded words padded with empty ones, so that every filter fits once, pooled filter outputs, and where each was found."""
        x = np.zeros((len(words) + max(WIDTHS), DIM), dtype=np.float32)
        for column in range(words.shape[1]):
            x[: len(words)] += self.embedding[words[:, column]]
        top, at = [], []
        for width, w, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            n = len(x) - width + 1
            z = x[:n] @ w[0]
            for j in range(1, width):
                z += x[j : j + n] @ w[j]
            best = z.argmax(axis=0)
            at.append(best), top.append(z[best, np.arange(FILTERS)] + b)
        return x, np.concatenate(top), np.concatenate(at)

    def logit(self, words: np.ndarray) -> float:
        return float(np.maximum(self.pooled(words)[1], 0) @ self.out + self.shift)

    def score(self, words: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.logit(words), -40, 40))))


def _start(rows: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> Model:
    """First embedding coordinate: how much more often a bucket is in toxic texts than in others."""
    seen = np.zeros((2, BUCKETS))
    for words, label in zip(rows, labels, strict=True):
        seen[int(label), np.unique(words)] += 1
    rate = (seen + 0.5) / (np.bincount(labels.astype(int), minlength=2)[:, None] + 1)
    strength = np.log(rate[1] / rate[0]) * np.minimum(seen.sum(axis=0), 10) / 10
    embedding = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    embedding[:, 0] = np.clip(strength, -4, 4) / 4
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w in filters:
        w[:, 0, :] = np.abs(w[:, 0, :]) + 0.5 / len(w)
    return Model(embedding, filters, [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS], np.full(FILTERS * len(WIDTHS), 0.2, dtype=np.float32), -1.0)


def fit(rows: list[np.ndarray], labels: np.ndarray, languages: list, seed: int = 7) -> Model:
    """Stochastic gradient descent (Adagrad); a fifth of the rows calibrates the cut and the thresholds."""
    rng = np.random.default_rng(seed)
    held = np.arange(len(rows)) % 5 == 4
    learn = np.flatnonzero(~held)
    model = _start([rows[i] for i in learn], labels[learn], rng)
    rate, many = 0.05, FILTERS * len(WIDTHS)
    memory = [np.full_like(x, 1e-3) for x in (model.embedding, *model.filters, *model.bias, model.out)]
    shift_memory, pos_weight = 1e-3, float(np.sqrt((labels[learn] == 0).sum() / max(1, (labels[learn] == 1).sum())))

    def step(value: np.ndarray, past: np.ndarray, gradient: np.ndarray) -> None:
        past += gradient * gradient
        value -= rate * gradient / np.sqrt(past)

    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            words, label = rows[i], labels[i]
            x, top, at = model.pooled(words)
            active = np.maximum(top, 0)
            z = float(active @ model.out + model.shift)
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label) * (pos_weight if label else 1.0)
            if abs(error) < 1e-3:
                continue
            back = error * model.out * (top > 0)
            step(model.out, memory[-1], (error * active).astype(np.float32))
            shift_memory += error * error
            model.shift -= rate * error / np.sqrt(shift_memory)
            for k, width in enumerate(WIDTHS):
                own, where = back[k * FILTERS : (k + 1) * FILTERS].astype(np.float32), at[k * FILTERS : (k + 1) * FILTERS]
                w = model.filters[k].copy()
                span = where[None, :] + np.arange(width)[:, None]
                step(model.filters[k], memory[1 + k], x[span].transpose(0, 2, 1) * own)
                step(model.bias[k], memory[1 + len(WIDTHS) + k], own)
                for j in range(width):
                    for f in np.flatnonzero(own):
                        if span[j, f] < len(words):
                            ids = np.unique(words[span[j, f]])
                            gradient = own[f] * w[j, :, f]
                            memory[0][ids] += gradient * gradient
                            model.embedding[ids] -= rate * gradient / np.sqrt(memory[0][ids])
    assert len(model.out) == many
    _calibrate(model, [rows[i] for i in np.flatnonzero(held)], labels[held], [languages[i] for i in np.flatnonzero(held)])
    return model


def _best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """Logit with the best F1: the middle of the gap below it."""
    order = np.argsort(-logits, kind="stable")
    z, y = logits[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    i = int(np.argmax(f1))
    return float((z[i] + (z[i + 1] if i + 1 < len(z) else z[i] - 1)) / 2)


def _calibrate(model: Model, rows: list[np.ndarray], labels: np.ndarray, languages: list) -> None:
    """Shifts and scales the logit so that the best cut scores CUT, and finds each language's threshold."""
    model.thresholds = {}
    if labels.sum() == 0 or labels.sum() == len(labels):
        return
    logits = np.array([model.logit(r) for r in rows])
    cut, aim = _best_cut(logits, labels), np.log(CUT / (1 - CUT))
    spread = max(1e-3, float(np.std(logits)))
    model.scale = 1 / spread
    model.shift += aim * spread - cut
    logits += aim * spread - cut
    for language in sorted({x for x in languages if x is not None}):
        own = np.array([x == language for x in languages])
        if min(labels[own].sum(), (1 - labels[own]).sum()) >= LANGUAGE_ROWS:
            z = _best_cut(logits[own], labels[own])
            model.thresholds[language] = float(1 / (1 + np.exp(-z * model.scale)))


def held_out(key: str = "doc_id"):
    """Rows never learnt from: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", lang: str = "lang") -> Model | None:
    """Fits on at most TOXIC_ROWS + CLEAN_ROWS labelled rows that are not held out, least key hash first.

    None if either class has no such row.
    """
    rank = F.xxhash64(F.col(key))
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).select(key, F.col(label).cast("int").alias("y"), rank.alias("rank"))
    chosen = rows.where("y = 1").orderBy("rank", key).limit(TOXIC_ROWS).unionByName(rows.where("y = 0").orderBy("rank", key).limit(CLEAN_ROWS))
    small = docs.where(F.octet_length(text) <= ROW_BYTES).select(key, F.col(text).alias("t"), F.col(lang).alias("l"))

    def run(batches):
        for batch in batches:
            packed = [features(x).tobytes() for x in byte_rows(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(packed, type=pa.binary())], names=["rank", "y", "l", "words"])

    # At most TOXIC_ROWS + CLEAN_ROWS short rows: a proven bound for the broadcast.
    sample = small.join(F.broadcast(chosen), key).select("rank", "y", "t", "l").mapInArrow(run, "rank long, y int, l string, words binary").toArrow().sort_by([("rank", "ascending"), ("y", "ascending")])
    y = sample["y"].to_numpy().astype(np.float64)
    if len(y) == 0 or y.min() == y.max():
        return None
    words = [np.frombuffer(x.as_buffer(), dtype=np.uint16).reshape(-1, 1 + len(PREFIXES)) for x in sample["words"]]
    return fit(words, y, sample["l"].to_pylist())


def with_toxicity(docs: DataFrame, model: Model | None, text: str = "text", lang: str = "lang", score: str = "score", threshold: str = "threshold") -> DataFrame:
    """The rows with two more columns: a score from 0 to 1, and the threshold of the row's language.

    Every row is scored on its whole text; a null text is empty, and an empty
    one gets the score of no words.  Without a model all scores are 0.  The
    language takes part in the threshold only, never in the score; a language
    without a calibrated threshold, or null, has CUT.  Columns named as the new
    ones are replaced, all others are kept.
    """
    if model is None:
        return docs.withColumns({score: F.lit(0.0), threshold: F.lit(CUT)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(column: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(features(x)) for x in byte_rows(column)], type=pa.float64())

    own = F.lit(CUT)
    for language, cut in (model.thresholds or {}).items():
        own = F.when(F.col(lang) == language, F.lit(cut)).otherwise(own)
    return docs.withColumns({score: scores(F.coalesce(F.col(text), F.lit(""))), threshold: own})
