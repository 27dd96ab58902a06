"""Token files: independent zstandard frames, a document index, a trailing seek table with a checksum for each frame.

A file (one a task, holding a range of the order) is

* data frames: zstandard frames of little-endian unsigned 32-bit ids, cut at
  documents once FRAME_IDS ids have gathered (a longer document has a frame of its own);
* one skippable frame with the document index, itself zstandard-compressed:
  doc_id int64 (null as the least int64), n uint64, for each document in order;
* the seek table, a skippable frame in the layout of the zstandard seekable
  format: compressed size, size and XXH64 (low 32 bits) of each data frame, then
  the number of frames, a descriptor byte and the magic number.

Any zstandard reader gets all ids in one stream; TokenFile reads the tail of a
file, and then only the frames of the documents asked for.

A text is cut at ASCII white space, each distinct piece is encoded once in a
Python worker with the tokenizers library, and the ids are put together in numpy.
That is what encoding whole texts gives if the tokenizer's matches cross no white
space; splits_at_space() finds that out from the tokenizer's file and a probe, and
whole texts are encoded for all other tokenizers.

Files are written under new names in the shared folder; a task's file counts only
through the row that the task returns, so a lost and repeated task leaves at most
an unused file. Defined cases: a null text is an empty one and holds the end id
alone; repeated rows are written each; a null order key comes first; an empty
table gives no file.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession

from factloom.llm._shared import shared_dir, table
from factloom.llm._text import SPACE, hashes, raw, slices, words

FRAME_IDS = 1 << 16
END_ID = 2
#: Words that a worker remembers with their ids (about 40 bytes each); then it starts anew.
CACHE_WORDS = 2_000_000
_INDEX_MAGIC, _SEEK_MAGIC, _SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_NULL_ID = np.iinfo(np.int64).min


class TokenWriter:
    """Writes one file; add() documents in order, then close()."""

    def __init__(self, sink, level: int = 3):
        self.sink, self.compress = sink, zstandard.ZstdCompressor(level=level).compress
        self.seek: list[tuple[int, int, int]] = []
        self.ids: list[np.ndarray] = []
        self.held, self.docs, self.sizes = 0, [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.held and self.held + len(ids) > FRAME_IDS:
            self._frame()
        self.docs.append(_NULL_ID if doc_id is None else doc_id)
        self.sizes.append(len(ids))
        self.ids.append(ids)
        self.held += len(ids)

    def _frame(self) -> None:
        plain = np.concatenate(self.ids).astype("<u4").tobytes()
        for k in range(0, len(plain), 1 << 30):  # sizes in the seek table have 32 bits
            part = plain[k : k + (1 << 30)]
            packed = self.compress(part)
            self.sink.write(packed)
            self.seek.append((len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
        self.ids, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        index = self.compress(struct.pack("<Q", len(self.docs)) + np.array(self.docs, dtype="<i8").tobytes() + np.array(self.sizes, dtype="<u8").tobytes())
        self.sink.write(struct.pack("<II", _INDEX_MAGIC, len(index)) + index)
        entries = b"".join(struct.pack("<III", *x) for x in self.seek)
        self.sink.write(struct.pack("<II", _SEEK_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(self.seek), 0x80, _SEEK_END))
        self.sink.close()


class TokenFile:
    """Reads a file through its seek table and index."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        n, flags, magic = struct.unpack("<IBI", self._read(end - 9, 9))
        if magic != _SEEK_END or flags != 0x80:
            raise ValueError("no seek table")
        at = end - 9 - 12 * n - 8
        table_ = np.frombuffer(self._read(at + 8, 12 * n), dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.packed, self.plain, self.check = table_.T
        self.packed_at = np.concatenate(([0], np.cumsum(self.packed)))
        self.plain_at = np.concatenate(([0], np.cumsum(self.plain)))
        index_at = int(self.packed_at[-1])
        magic, size = struct.unpack("<II", self._read(index_at, 8))
        if magic != _INDEX_MAGIC:
            raise ValueError("no document index")
        index = zstandard.ZstdDecompressor().decompress(self._read(index_at + 8, size))
        (docs,) = struct.unpack_from("<Q", index)
        self.doc_ids = np.frombuffer(index, dtype="<i8", count=docs, offset=8)
        self.sizes = np.frombuffer(index, dtype="<u8", count=docs, offset=8 + 8 * docs).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        plain = zstandard.ZstdDecompressor().decompress(self._read(int(self.packed_at[k]), int(self.packed[k])), max_output_size=int(self.plain[k]))
        if len(plain) != self.plain[k] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.check[k]:
            raise ValueError(f"frame {k} is damaged")
        return plain

    def document(self, row: int) -> np.ndarray:
        """The ids of the row-th document; only its frames are read."""
        a, b = 4 * int(self.first[row]), 4 * int(self.first[row + 1])
        k = max(0, int(np.searchsorted(self.plain_at, a, side="right")) - 1)
        out, begin = b"", int(self.plain_at[k]) if len(self.plain) else 0
        while begin + len(out) < b:
            out += self.frame(k)
            k += 1
        return np.frombuffer(out, dtype="<u4")[(a - begin) // 4 : (b - begin) // 4]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, frame by frame."""
        held, at, k = b"", 0, 0  # at: where the next document begins in held
        for row, doc in enumerate(self.doc_ids.tolist()):
            size = 4 * int(self.sizes[row])
            while len(held) - at < size:
                held, at, k = held[at:] + self.frame(k), 0, k + 1
            ids = np.frombuffer(held, dtype="<u4", count=size // 4, offset=at)
            at += size
            yield (None if doc == _NULL_ID else doc), ids


class Encoder:
    """Texts to ids, each text with the end id behind it."""

    def __init__(self, model: str, end_id: int = END_ID, whole: bool = False, most_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.whole, self.most_words = Tokenizer.from_str(model), end_id, whole, most_words
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # an added token that is matched in raw text parts pieces that are encoded in one call
        parts = [(k, t.content) for k, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.part_id, self.part = parts[-1] if parts else (None, None)
        self._clear()

    def _clear(self) -> None:
        self.known, self.check = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        self.at, self.count, self.flat = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's begin."""
        if self.part is None or any(self.part in x for x in texts):
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            return np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(size.sum())), np.concatenate(([0], np.cumsum(size)))
        runs = [self.part.join(texts[k : k + 500]) for k in range(0, len(texts), 500)]
        if not runs:
            return np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        flat = np.concatenate([np.array([*x.ids, self.part_id], dtype=np.uint32) for x in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)])
        ends = flat == self.part_id
        return flat[~ends], np.concatenate(([0], np.flatnonzero(ends) - np.arange(int(ends.sum()))))

    def _words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words to ids: the place of each word, and where the ids of each place begin and how many they are in self.flat.

        Words are told apart by 128 bits of hashes; those met before in this worker are not encoded again.
        """
        place, one = pd.factorize(hashes(data, start, end))
        at = np.empty(len(one), dtype=np.int64)
        at[place[::-1]] = np.arange(len(place))[::-1]
        two = hashes(data, start[at], end[at], seed=1)
        if len(self.known) + len(one) > self.most_words:
            self._clear()
        slot = np.minimum(np.searchsorted(self.known, one), max(0, len(self.known) - 1))
        new = np.flatnonzero((self.known[slot] != one) | (self.check[slot] != two)) if len(self.known) else np.arange(len(one))
        if len(new):
            text = data.tobytes()
            flat, first = self.encode([text[a:b].decode() for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist())])
            base = len(self.flat)
            self.flat = np.concatenate((self.flat, flat))
            order = np.argsort(one[new])
            to = np.searchsorted(self.known, one[new][order])  # of equal first hashes the newest comes first
            self.known, self.check = np.insert(self.known, to, one[new][order]), np.insert(self.check, to, two[new][order])
            self.at, self.count = np.insert(self.at, to, (first[:-1] + base)[order]), np.insert(self.count, to, np.diff(first)[order])
            slot = np.searchsorted(self.known, one)
        return place, self.at[slot], self.count[slot]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow column in one array, with end ids, and where each row's begin."""
        if self.whole:
            source, first = self.encode([x or "" for x in texts.to_pylist()])
            piece, at, count = np.arange(len(texts)), first[:-1], np.diff(first)
            pieces = np.arange(len(texts) + 1)
        else:
            data, rows = raw(texts)
            start, end, pieces = words(data, rows, ~SPACE)
            piece, at, count = self._words(data, start, end)
            source = self.flat
        count, at = count[piece], at[piece]
        before = np.concatenate(([0], np.cumsum(count)))
        row_first = before[pieces] + np.arange(len(pieces))  # each row before has one end id
        out = np.full(int(before[-1]) + len(pieces) - 1, self.end_id, dtype=np.uint32)
        row = np.repeat(np.arange(len(pieces) - 1), np.diff(pieces))
        out[np.arange(int(before[-1])) + np.repeat(row, count)] = source[np.arange(int(before[-1])) - np.repeat(before[:-1] - at, count)]
        return out, row_first


#: Texts in which words meet white space, marks, digits, capitals and letters outside ASCII in many ways.
_PROBES = ("It's 3,14 ÉCOLE x́ y", " a  b\tc\n\nd \r\n", "é ́a ΣΑΣ ß\x0bz\x0c", "wo rd. (x) [y] {z} - -- ... !? 1 2 34 5", "the The THE then  the\n the", "\u3000 \u00a0x\u2028y")


def splits_at_space(model: str) -> bool:
    """Whether encoding the pieces between ASCII white space gives the ids of whole texts, for a tokenizer's file.

    A step has to keep only pieces without white space (a Split that drops all but its matches, or a white space splitter);
    steps that add or join spaces, and added tokens with white space in them or beside them, rule it out. The pattern of a
    Split is not read: what is left has to pass the probes.
    """
    spec = json.loads(model)
    steps, before = _parts(spec.get("pre_tokenizer"), "pretokenizers"), _parts(spec.get("normalizer"), "normalizers")
    drops = any(x["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") or x["type"] == "Split" and x["behavior"] == "Removed" and x["invert"] for x in steps)
    joins = any(x["type"] == "Metaspace" or x["type"] == "ByteLevel" and (x["add_prefix_space"] or x["use_regex"]) for x in steps)
    alters = any(x["type"] in ("Prepend", "Precompiled") or x["type"] == "Replace" and x["pattern"] != {"Regex": r"\s+"} for x in before)
    if not drops or joins or alters or any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", [])):
        return False
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model)
    ids = lambda x: tokenizer.encode(x, add_special_tokens=False).ids
    return all(ids(x) == [i for piece in x.encode().split() for i in ids(piece.decode())] for x in _PROBES)


def _parts(spec: dict | None, inner: str) -> list[dict]:
    """The single steps of a pre-tokenizer or normalizer."""
    if not spec:
        return []
    return [y for x in spec[inner] for y in _parts(x, inner)] if spec.get("type") == "Sequence" else [spec]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(model: str, end_id: int, whole: bool) -> Encoder:
    """The encoder of this Python worker, kept from task to task with the words it has met."""
    key = (xxhash.xxh64_intdigest(model), end_id, whole)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model, end_id, whole)
    return _ENCODERS[key]


_SHARD_SCHEMA = "path string, first_key bigint, n_docs bigint, n_ids bigint"


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, order: tuple[str, ...] = ("doc_id",), text: str = "text", end_id: int = END_ID, whole: bool | None = None) -> list[dict]:
    """Write docs as token files in the given order; returns the files in order, each with its number of documents and ids.

    One row a file comes to the driver. whole: encode whole texts; by default only where the tokenizer needs it.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        plain = f.read()
    model = docs.sparkSession.sparkContext.broadcast(plain)
    if whole is None:
        # in a task: the tokenizer would stay in the driver's memory
        def probe(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([not splits_at_space(model.value)] * batch.num_rows, pa.bool_())], ["whole"])

        whole = docs.sparkSession.range(0, 1, 1, 1).mapInArrow(probe, "whole boolean").first()["whole"]
    ordered = docs.select("doc_id", text, *[c for c in order if c != "doc_id"]).repartitionByRange(*order).sortWithinPartitions(*order, text)

    def write(batches):
        writer = path = None
        n_docs = n_ids = 0
        for batch in batches:
            for part in slices(batch, text):
                if writer is None:
                    from pyspark import TaskContext

                    fs, base = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(base, recursive=True)
                    number = TaskContext.get().partitionId()
                    path = f"{folder}/{number:08d}-{uuid.uuid4().hex}.tok.zst"
                    writer = TokenWriter(fs.open_output_stream(pafs.FileSystem.from_uri(path)[1], compression=None))
                ids, first = encoder(model.value, end_id, whole).column(part.column(text))
                for k, doc in enumerate(part.column("doc_id").to_pylist()):
                    writer.add(doc, ids[first[k] : first[k + 1]])
                n_docs, n_ids = n_docs + part.num_rows, n_ids + len(ids)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "first_key": number, "n_docs": n_docs, "n_ids": n_ids}], pa.schema([("path", pa.string()), ("first_key", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = ordered.mapInArrow(write, _SHARD_SCHEMA).collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: r["first_key"])]


_DIGEST_SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_digests(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""
    start, rows = 0, []
    for s in shards:
        rows.append((s["path"], start))
        start += s["n_ids"]

    def read(batches):
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as source:
                    out: list[tuple] = []
                    for doc, ids in TokenFile(source).documents():
                        out.append((doc, at, len(ids), zlib.crc32(ids)))
                        at += len(ids)
                        if len(out) == 10_000:
                            yield _batch(out)
                            out = []
                    yield _batch(out)

    files = spark.createDataFrame(rows, "path string, start bigint")
    return files.repartition(max(1, len(rows)), "path").mapInArrow(read, _DIGEST_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    shards = write_token_files(docs, shared_dir(spark), public_tokenizers.path("word_bpe_49k.json"))
    return read_digests(spark, shards)
