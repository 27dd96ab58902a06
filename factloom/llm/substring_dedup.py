"""Substring deduplication by super-k-mers.

A window is 13 consecutive words of one document. Its minimiser is the least
hash among its MINIMISER-word grams. Consecutive windows with the same minimiser
travel together as one packed string of words (a super-k-mer) to that
minimiser's bucket, about one string for six windows. A task writes its strings
for one bucket as one zstandard blob. In the bucket all windows are sorted and
compared, and every window whose words also start in a document with a smaller
doc_id is reported back as a range of words of its document.

Buckets hold about BUCKET_BYTES each, so their number grows with the corpus; the
JVM sorts the blobs by bucket (and can spill), and a Python task holds one bucket
at a time.

Skew: a minimiser with more than HOT_LEAST super-k-mers is hot (240 kB of text), or, beyond
8e9 super-k-mers, with more than HOT_SHARE of them, so that the list that tasks get stays
below 1 / HOT_SHARE entries, 32 MB. Windows with a hot minimiser travel singly, to the bucket of their own words. Of equal
ones in a run of documents a task sends only that of the smallest doc_id: the
others are known to be repeats already, and only their ranges travel.

Windows are compared by 128 bits of hashes of their words.

Defined cases: null texts have no words; equal windows within one document are no
repeats; a null doc_id comes after all others; of rows that share a doc_id, or have none,
neither is the smaller, and each loses what repeats in it alone: ranges belong to a doc_id
and a text (64 bits of its hash); repeated rows get equal results; texts shorter than a
window stay; a very long text is cut into super-k-mers as one run, at about 60 bytes of
memory a byte; an empty table gives an empty result; extra columns stay, whatever their
names, but for those with names of output columns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm._shared import keep, table
from factloom.llm._text import SPACE, U64, hashes, mix, ngrams, raw, slices, within, words

WINDOW = 13
MINIMISER = 3
#: A minimiser is hot above this share of all super-k-mers; so at most 4,000,000 are (32 MB of hashes).
HOT_SHARE = 2.5e-7
HOT_LEAST = 2000
#: Packed words of a bucket, on average.
BUCKET_BYTES = 16 << 20
#: Text that a task cuts into super-k-mers at a time.
RUN_BYTES = 6 << 20
#: Ranges of repeats that are broadcast (about 30 bytes each); beyond it texts are shuffled to them.
BROADCAST_RANGES = 1_000_000
_STRING_BYTES = 120
_LAST = np.iinfo(np.int64).max


class _Windows:
    """The windows of a run of documents: positions, minimisers, and the super-k-mers they form."""

    def __init__(self, part: pa.RecordBatch, text: str):
        self.doc = part.column("doc_id").cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)
        self.text = part.column("text_hash").to_numpy()
        self.data, rows = raw(part.column(text))
        self.start, self.end, self.first = words(self.data, rows, ~SPACE)
        self.hash = hashes(self.data, self.start, self.end)
        self.at = within(self.first, WINDOW)
        grams = ngrams(self.hash, MINIMISER)
        width, least = 1, grams
        while width * 2 <= WINDOW - MINIMISER + 1:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        shift = WINDOW - MINIMISER + 1 - width
        least = np.minimum(least[: len(least) - shift], least[shift:]) if shift else least
        self.minimiser = mix(least[self.at]) if len(self.at) else np.zeros(0, dtype=U64)
        self.row = np.searchsorted(self.first, self.at, side="right") - 1
        opens = np.ones(len(self.at), dtype=bool)
        opens[1:] = (self.minimiser[1:] != self.minimiser[:-1]) | (self.row[1:] != self.row[:-1])
        self.open = np.flatnonzero(opens)
        self.last = np.concatenate((self.open[1:], [len(self.at)]))[: len(self.open)] - 1


def _pack(doc: np.ndarray, text: np.ndarray, position: np.ndarray, strings: list[bytes]) -> bytes:
    size = np.fromiter(map(len, strings), dtype=np.uint32, count=len(strings))
    head = np.array([len(strings)], dtype=np.uint32)
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head.tobytes(), np.diff(doc, prepend=0).astype(np.int64).tobytes(), text.astype(np.int64).tobytes(), position.astype(np.uint32).tobytes(), size.tobytes(), *strings]))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    x = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(x, dtype=np.uint32, count=1)[0])
    doc = np.cumsum(np.frombuffer(x, dtype=np.int64, count=n, offset=4))
    text = np.frombuffer(x, dtype=np.int64, count=n, offset=4 + 8 * n)
    position = np.frombuffer(x, dtype=np.uint32, count=n, offset=4 + 16 * n).astype(np.int64)
    size = np.frombuffer(x, dtype=np.uint32, count=n, offset=4 + 20 * n).astype(np.int64)
    return doc, text, position, size, x[4 + 24 * n :]


_COUNT_SCHEMA = "minimiser bigint, n bigint"
_BLOB_SCHEMA = "bucket bigint, repeats boolean, blob binary"
_RANGE_SCHEMA = "doc_id bigint, text_hash bigint, first bigint, n bigint"


def _hot_minimisers(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """The hot minimisers, sorted, and the number of super-k-mers."""

    def count(batches):
        for batch in batches:
            for part in slices(batch, text, RUN_BYTES):
                w = _Windows(part, text)
                keys, n = np.unique(w.minimiser[w.open], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([None, *keys.view(np.int64).tolist()], pa.int64()), pa.array(np.concatenate(([len(w.open)], n)))], ["minimiser", "n"])

    counts = docs.select("doc_id", "text_hash", text).mapInArrow(count, _COUNT_SCHEMA).groupBy("minimiser").agg(F.sum("n").alias("n")).where(F.col("minimiser").isNull() | (F.col("n") > HOT_LEAST))
    counts = keep(counts)
    total = counts.where("minimiser is null").first()
    total = total["n"] if total else 0
    hot = counts.where(F.col("minimiser").isNotNull() & (F.col("n") > max(HOT_LEAST, HOT_SHARE * total))).select("minimiser").toPandas()["minimiser"].to_numpy(dtype=np.int64)
    return np.sort(hot.view(U64)), total


def _map(part: pa.RecordBatch, text: str, hot: np.ndarray, buckets: int):
    """(bucket, repeats, blob) rows of a run of documents."""
    w = _Windows(part, text)
    data = w.data.tobytes()
    out: list[tuple[int, bool, bytes]] = []
    key = w.minimiser[w.open]
    is_hot = np.isin(key, hot)
    begin, stop = w.at[w.open][~is_hot], w.at[w.last][~is_hot] + WINDOW
    row, bucket = w.row[w.open][~is_hot], key[~is_hot] % U64(buckets)
    if is_hot.any():
        # windows one by one; of equal ones, that of the smallest doc_id goes on
        size = (w.last - w.open + 1)[is_hot]
        k = np.arange(int(size.sum())) + np.repeat(w.open[is_hot] - (np.cumsum(size) - size), size)
        at, r = w.at[k], w.row[k]
        one, two = ngrams(w.hash, WINDOW)[at], ngrams(w.hash, WINDOW, 1)[at]
        order = np.lexsort((at, w.doc[r], two, one))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        repeat = w.doc[r[order]] > w.doc[r[order[head]]]
        # equal windows of the document that has the least doc_id all go on, as each needs the answer
        sent, known = order[~repeat], np.sort(order[repeat])
        begin, stop = np.concatenate((begin, at[sent])), np.concatenate((stop, at[sent] + WINDOW))
        row, bucket = np.concatenate((row, r[sent])), np.concatenate((bucket, mix(one[sent] ^ two[sent]) % U64(buckets)))
        if len(known):
            ranges = np.stack(_ranges(w.doc[r[known]], w.text[r[known]], at[known] - w.first[r[known]]), axis=1)
            to = int(mix(np.array([w.doc[0] & _LAST], dtype=U64))[0] % U64(buckets))
            out.append((to, True, zstandard.compress(ranges.astype(np.int64).tobytes())))
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=buckets)).tolist() if len(order) else []
    starts, ends = w.start[begin].tolist(), w.end[stop - 1].tolist()
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        own = order[a:b]
        own = own[np.argsort(row[own], kind="stable")]
        out.append((int(bucket[own[0]]), False, _pack(w.doc[row[own]], w.text[row[own]], begin[own] - w.first[row[own]], [data[starts[i] : ends[i]] for i in own.tolist()])))
    return out


def _ranges(doc: np.ndarray, text: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring window positions of a document, in the order given, as ranges of words: doc, text, first, n."""
    opens = np.ones(len(doc), dtype=bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (position[1:] != position[:-1] + 1)
    at = np.flatnonzero(opens)
    last = np.concatenate((at[1:], [len(doc)]))[: len(at)] - 1
    return doc[at], text[at], position[at], position[last] - position[at] + WINDOW


def _reduce(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of the repeated windows of one bucket."""
    parts = [_unpack(b) for b in blobs]
    doc, text, position, size = (np.concatenate([p[k] for p in parts]) for k in range(4))
    data = np.frombuffer(b"".join([*(p[4] for p in parts), bytes(8)]), dtype=np.uint8)
    rows = np.concatenate(([0], np.cumsum(size)))
    start, end, first = words(data, rows, ~SPACE)
    h = hashes(data, start, end)
    at = within(first, WINDOW)
    one = ngrams(h, WINDOW)[at]
    again = np.flatnonzero(pd.Series(one).duplicated(keep=False).to_numpy())
    if not len(again):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    at, one = at[again], one[again]
    two = ngrams(h, WINDOW, 1)[at]
    row = np.searchsorted(first, at, side="right") - 1
    own = doc[row]
    order = np.lexsort((own, two, one))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    repeat = np.zeros(len(order), dtype=bool)
    repeat[order] = own[order] > own[order[head]]
    return _ranges(own[repeat], text[row][repeat], (position[row] + at - first[row])[repeat])


def repeated_ranges(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_hash, first, n) for docs (doc_id, text_hash, text): ranges of words, by number, that repeat windows of documents with smaller ids; they may overlap."""
    hot, total = _hot_minimisers(docs, text)
    buckets = max(12, -(-total * _STRING_BYTES // BUCKET_BYTES))
    hot_sent = docs.sparkSession.sparkContext.broadcast(hot)

    def send(batches):
        for batch in batches:
            for part in slices(batch, text, RUN_BYTES):
                rows = _map(part, text, hot_sent.value, buckets)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.bool_(), pa.binary()))], ["bucket", "repeats", "blob"])

    def compare(batches):
        def result(*columns):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc_id", "text_hash", "first", "n"])

        now, held = None, []
        for batch in batches:
            for bucket, repeats, blob in zip(batch.column("bucket").to_pylist(), batch.column("repeats").to_pylist(), batch.column("blob")):
                if repeats:
                    yield result(*np.frombuffer(zstandard.decompress(blob.as_py()), dtype=np.int64).reshape(-1, 4).T)
                    continue
                if bucket != now and held:
                    yield result(*_reduce(held))
                    held = []
                now = bucket
                held.append(blob.as_py())
        if held:
            yield result(*_reduce(held))

    packed = docs.select("doc_id", "text_hash", text).mapInArrow(send, _BLOB_SCHEMA)
    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(compare, _RANGE_SCHEMA)


def _merged(ranges: DataFrame) -> DataFrame:
    """(doc_id, text_hash, ranges): the ranges of each document, those that touch put together."""

    def merge(batches):
        for batch in batches:
            out = []
            for own in batch.column("ranges").to_pylist():
                merged: list[dict] = []
                for x in sorted(own, key=lambda x: x["first"]):
                    if merged and x["first"] <= merged[-1]["first"] + merged[-1]["n"]:
                        merged[-1]["n"] = max(merged[-1]["n"], x["first"] + x["n"] - merged[-1]["first"])
                    else:
                        merged.append(x)
                out.append(merged)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(out, pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())])))], ["doc_id", "text_hash", "ranges"])

    return ranges.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "n")).alias("ranges")).mapInArrow(merge, "doc_id bigint, text_hash bigint, ranges array<struct<first: bigint, n: bigint>>")


def remove_repeats(docs: DataFrame, text: str = "text", with_text: bool = False) -> DataFrame:
    """docs without the text, with n_words, n_removed and kept_sha256, and with_text also kept_text: the kept words joined by spaces."""
    made = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()} | ({"kept_text": pa.string()} if with_text else {})
    others = [c for c in docs.columns if c not in (text, *made)]
    # the other columns travel as one, so that their names cannot meet those used here
    own = docs.select(F.struct(*others).alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    of_doc = keep(_merged(repeated_ranges(own)))
    n = of_doc.agg(F.sum(F.size("ranges"))).first()[0] or 0
    joined = own.join(F.broadcast(of_doc) if n <= BROADCAST_RANGES else of_doc.hint("merge"), ["doc_id", "text_hash"], "left").select("row", "text", "ranges")

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                data, rows = raw(part.column("text"))
                start, end, first = words(data, rows, ~SPACE)
                whole, removed, digests, texts = data.tobytes(), [], [], []
                for k, own_ranges in enumerate(part.column("ranges").to_pylist()):
                    a, b = int(first[k]), int(first[k + 1])
                    gone = np.zeros(b - a, dtype=bool)
                    for r in own_ranges or ():
                        gone[r["first"] : r["first"] + r["n"]] = True
                    left = np.flatnonzero(~gone) + a
                    kept = b" ".join([whole[x:y] for x, y in zip(start[left].tolist(), end[left].tolist())])
                    removed.append(int(gone.sum()))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    texts.append(kept.decode() if with_text else None)
                values = [np.diff(first), removed, digests, texts][: len(made)]
                yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(v, kind) for v, kind in zip(values, made.values()))], ["row", *made])

    schema = T.StructType([joined.schema["row"], *(T.StructField(c, T.LongType() if kind == pa.int64() else T.StringType()) for c, kind in made.items())])
    return joined.mapInArrow(cut, schema).select("row.*", *made)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def brute_force(docs: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256) by comparing lists of words; for tests."""
    split = [(i, (x or "").encode().split()) for i, x in docs]
    least: dict[tuple, int] = {}
    for i, w in split:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out
