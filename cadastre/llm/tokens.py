"""Operator 1: token ids in binary shards of independent zstandard frames.

A shard is a sequence of zstandard frames and ends with a seek table in a
skippable frame (the public seekable format): compressed size, decompressed
size and checksum (low 32 bits of xxh64) of every frame.  The last frame before
it is the index: for each document its key, a null flag and its number of ids.
All other frames hold ids as little-endian unsigned 32-bit integers; a long
document goes on in the next frame.  A reader finds a document's frames from
index and seek table and decompresses only those.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastre.llm.tables import NO_KEY, keyed, new_path, unkeyed, written

#: Ids of a frame.
FRAME = 1 << 16
LEVEL = 3
#: Fixed values of the seekable format: skippable frame, footer.
_SKIPPABLE, _FOOTER = 0x184D2A5E, 0x8F92EAB1
#: Bytes of text that are encoded at once, and of pieces and their ids that a Python worker remembers before it starts anew.
CHUNK, CACHE = 8 << 20, 64 << 20
#: Marks after a word's last letter; pieces of the tokenizers meant here never hold a letter and one of these together.
MARKS = "!#$%&*+,./:;=?@^_|~)]}>"

_coder: dict = {}


class Pieces:
    """Encodes texts piece by piece: what stands between ASCII white space is encoded once and remembered.

    Only for tokenizers whose pieces never cross white space and that drop it.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.lowers = Tokenizer.from_str(spec), _lowers(json.loads(spec).get("normalizer") or {})
        self.forget()

    def forget(self) -> None:
        self.slot, self.ids, self.ends, self.held = {"": 0}, np.empty(0, dtype="<u4"), np.zeros(1, dtype=np.int64), 0
        self.part, self.part_ids, self.part_ends = {"": 0}, np.empty(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    def learn(self, new: list[str]) -> None:
        """Encodes new pieces: what comes before closing marks, and the marks, each once."""
        parts = []
        for piece in new:
            core = piece.rstrip(MARKS)
            parts += (core, piece[len(core) :]) if core and core[-1] < "\u0530" and core[-1].lower()[-1].isalpha() else (piece, "")
        fresh = [x for x in dict.fromkeys(parts) if x not in self.part]
        if fresh:
            got = self.tokenizer.encode(fresh, is_pretokenized=True, add_special_tokens=False)
            size = np.bincount(np.array(got.word_ids, dtype=np.int64), minlength=len(fresh))
            self.part.update(zip(fresh, range(len(self.part_ends), len(self.part_ends) + len(fresh)), strict=True))
            self.part_ends = np.append(self.part_ends, len(self.part_ids) + np.cumsum(size))
            self.part_ids = np.append(self.part_ids, np.array(got.ids, dtype="<u4"))
        at, upto = _gathered(self.part_ends, np.fromiter(map(self.part.__getitem__, parts), dtype=np.int64, count=len(parts)))
        self.slot.update(zip(new, range(len(self.ends), len(self.ends) + len(new)), strict=True))
        self.ends = np.append(self.ends, len(self.ids) + upto[2::2])
        self.ids = np.append(self.ids, self.part_ids[at])
        self.held += sum(map(len, new)) + sum(map(len, fresh)) + 4 * len(at)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's ids end."""
        if self.held > CACHE:
            self.forget()
        pieces = pc.ascii_split_whitespace(pc.ascii_lower(texts) if self.lowers else texts)
        words = pieces.flatten().dictionary_encode()
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), "\n")[0].as_py()
        distinct = joined.split("\n") if len(words.dictionary) else []
        if new := [w for w in distinct if w not in self.slot]:
            self.learn(new)
        own = np.fromiter(map(self.slot.__getitem__, distinct), dtype=np.int64, count=len(distinct))[words.indices.to_numpy()]
        at, upto = _gathered(self.ends, own)
        return self.ids[at], upto[pieces.offsets.to_numpy()[1:]]


def _gathered(ends: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ids of the slots one after the other, and where each slot's begin and end among them."""
    begin = np.append(0, ends[:-1])[slots]
    size = ends[slots] - begin
    upto = np.append(0, np.cumsum(size))
    return np.repeat(begin - upto[:-1], size) + np.arange(upto[-1]), upto


def _encoder(spec: str) -> Pieces:
    if _coder.get("spec") != spec:
        _coder.update(spec=spec, pieces=Pieces(spec))
    return _coder["pieces"]


def _chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about CHUNK bytes, of one text at least."""
    upto, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(texts):
        until = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, side="right")))
        yield texts.slice(at, until - at)
        at = until


def _lowers(normalizer: dict) -> bool:
    return normalizer.get("type") == "Lowercase" or any(map(_lowers, normalizer.get("normalizers", [])))


def drops_white_space(spec: str) -> bool:
    """Whether a tokenizer file splits at white space and drops it, parts letters from marks, and pads or cuts nothing."""
    parts = json.loads(spec)
    before = parts.get("pre_tokenizer") or {}
    first = (before.get("pretokenizers") or [before])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    splits = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and r"[\p{L}]+" in pattern and r"[^\s\p{L}\p{N}]+" in pattern
    return bool(splits and not parts.get("truncation") and not parts.get("padding"))


class ShardWriter:
    """Appends frames to an open binary file."""

    def __init__(self, file):
        self.file, self.frames, self.docs = file, [], []
        self.waiting, self.held = [], 0
        self.press = zstandard.ZstdCompressor(level=LEVEL)

    def _frame(self, data: bytes) -> None:
        packed = self.press.compress(data)
        self.file.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, key: int, ids: bytes) -> None:
        self.docs.append((key, len(ids) // 4))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 4 * FRAME:
            data, at = b"".join(self.waiting), 0
            while len(data) - at >= 4 * FRAME:
                self._frame(data[at : at + 4 * FRAME])
                at += 4 * FRAME
            self.waiting, self.held = [data[at:]], len(data) - at

    def close(self) -> None:
        if self.held:
            self._frame(b"".join(self.waiting))
        index = np.array(self.docs, dtype="<i8").reshape(-1, 2)
        self._frame(index[:, 0].tobytes() + index[:, 1].tobytes())
        table = b"".join(struct.pack("<III", *x) for x in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0x80, _FOOTER)
        self.file.write(struct.pack("<II", _SKIPPABLE, len(table) + len(footer)) + table + footer)


class ShardReader:
    """Reads a shard through a random-access file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        count, descriptor, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != _FOOTER or not descriptor & 0x80:
            raise ValueError("no seek table with checksums at the end of the shard")
        table = np.frombuffer(file.read_at(12 * count, size - 9 - 12 * count), dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.table = table
        self.at = np.concatenate(([0], np.cumsum(table[:, 0])))
        self.begin = np.concatenate(([0], np.cumsum(table[:-1, 1])))  # of ids, in bytes
        index = np.frombuffer(self.frame(count - 1), dtype="<i8").reshape(2, -1)
        self.keys, self.sizes = index
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))

    def frame(self, i: int) -> bytes:
        data = zstandard.ZstdDecompressor().decompress(bytes(self.file.read_at(int(self.table[i, 0]), int(self.at[i]))), max_output_size=int(self.table[i, 1]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[i, 2]:
            raise ValueError(f"frame {i} doesn't match its checksum")
        return data

    def document(self, i: int) -> bytes:
        """The ids of the i-th document: only its own frames are read."""
        start, end = 4 * int(self.starts[i]), 4 * int(self.starts[i + 1])
        first, last = np.searchsorted(self.begin, start, side="right") - 1, np.searchsorted(self.begin, end, side="left")
        data = b"".join(self.frame(f) for f in range(first, max(first, last)))
        return data[start - int(self.begin[first]) : end - int(self.begin[first])]

    def documents(self) -> Iterator[tuple[int, bytes]]:
        """All documents in order, each frame read once."""
        data, at, f = b"", 0, 0
        for key, size in zip(self.keys.tolist(), self.sizes.tolist(), strict=True):
            while len(data) - at < 4 * size:
                data, at, f = data[at:] + self.frame(f), 0, f + 1
            yield key, data[at : at + 4 * size]
            at += 4 * size


def _write(spec: str, folder: str, end: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, tail = _encoder(spec), b"" if end is None else struct.pack("<I", end)
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"{root}/shard-{task.partitionId():06d}.zst"
        part, shard, file = f"{name}.{task.taskAttemptId()}.tmp", None, None
        for batch in batches:
            keys = iter(batch.column(0).to_pylist())
            for texts in _chunks(batch.column(1)):
                if shard is None:
                    file = fs.open_output_stream(part)
                    shard = ShardWriter(file)
                ids, ends = coder.encode(texts)
                data, begin = ids.tobytes(), 0
                for stop in (4 * ends).tolist():
                    shard.add(next(keys), data[begin:stop] + tail)
                    begin = stop
        if shard is None:
            return
        shard.close()
        file.close()
        fs.move(part, name)  # a repeated task writes the same file again
        yield pa.RecordBatch.from_arrays(
            [pa.array([task.partitionId()]), pa.array([f"{folder}/{os.path.basename(name)}"]), pa.array([len(shard.docs)]), pa.array([sum(n for _, n in shard.docs)])],
            names=["shard", "path", "n_docs", "n_ids"],
        )

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fs, name = pyarrow.fs.FileSystem.from_uri(path)
            with fs.open_input_file(name) as file:
                shard = ShardReader(file)
                crc = [zlib.crc32(ids) for _, ids in shard.documents()]
                at = start + shard.starts[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(shard.keys), pa.array(at), pa.array(shard.sizes), pa.array(crc, type=pa.int64())], names=["k", "start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, spec: str, end: int | None = 1, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Encodes whole texts into shards in ascending key order: (shard, path, n_docs, n_ids, start), a row per shard.

    spec: the tokenizer file's content; end: id appended to every document, or
    None.  A null or empty text has no other id.  A null key comes first;
    rows with one key follow each other by the hash of their text.  start counts the ids of
    all shards before.  An empty table writes nothing.  Other columns are ignored.
    """
    if not drops_white_space(spec):
        raise ValueError("the tokenizer keeps white space; its pieces can't be encoded singly")
    folder = folder or new_path(docs.sparkSession, "tokens")
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    ordered = keyed(docs, key, text).select("k", "text", F.xxhash64("text").alias("x")).repartitionByRange("k", "x").sortWithinPartitions("k", "x")
    shards = written(ordered.select("k", "text").mapInArrow(_write(spec, folder, end), "shard long, path string, n_docs long, n_ids long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard only
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(shards: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the shards' files alone.

    A document without a key has null there; one of no text has the end id
    only, or nothing; repeated rows stand as often as they were written.  No
    shards give no rows.
    """
    shards = written(shards, "offsets")
    spread = shards.select("path", "start").repartition(max(1, shards.count()))
    return spread.mapInArrow(_read, "k long, start long, n_tokens long, ids_crc32 long").select(unkeyed().alias(key), "start", "n_tokens", "ids_crc32")


def read_documents(shards: DataFrame, keys: list[int | None], key: str = "doc_id") -> DataFrame:
    """(key, ids array<long>) of the requested documents: decompresses their frames only."""
    wanted = np.array(sorted({NO_KEY if k is None else k for k in keys}), dtype=np.int64)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as file:
                    shard = ShardReader(file)
                    found = np.flatnonzero(np.isin(shard.keys, wanted))
                    ids = [np.frombuffer(shard.document(int(i)), dtype="<u4").astype(np.int64) for i in found]
                yield pa.RecordBatch.from_arrays([pa.array(shard.keys[found]), pa.array(ids, type=pa.list_(pa.int64()))], names=["k", "ids"])

    return shards.select("path").mapInArrow(run, "k long, ids array<long>").select(unkeyed().alias(key), "ids")
