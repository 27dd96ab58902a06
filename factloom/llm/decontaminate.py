"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of about 8 MB of text within one task. Its words become codes
of the benchmark's vocabulary; words outside it separate, and runs of known
words shorter than the shortest phrase are left out, as no phrase can lie in
them. All test phrases are then searched backwards at once, their occurrences
located by sampled suffix positions, and the covered words merged to spans.

The benchmark is a query set: it is read in blocks of at most BLOCK_BYTES of
text, and each block is one more pass over the rows in the same task, without a
shuffle. Nothing about the documents leaves their task.

Defined cases: null texts and texts without words have no hits; items without
words or with a null id are no phrases; an item of fewer words than the window
is one phrase; equal rows get equal results; an empty benchmark hits nothing;
other columns stay, but for those with the names of output columns; a very long text is a
shard of its own, at about 60 bytes of memory a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm._shared import table
from factloom.llm._text import hashes, lower, raw, slices, within, words
from factloom.llm.fm_index import FMIndex

WINDOW = 10
#: Benchmark text searched for, and broadcast, at a time: about 45 times as many bytes on the driver while a block is made, a third of that in a task.
BLOCK_BYTES = 8 << 20

#: Bytes of words in lower-cased text: digits, a to z, and all that is not ASCII.
INSIDE = np.zeros(256, dtype=bool)
INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_FOUND = {
    "n_words": (T.LongType(), pa.int64()),
    "n_hit": (T.LongType(), pa.int64()),
    "items": (T.ArrayType(T.StringType()), pa.list_(pa.string())),
    "spans": (T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    "clean_text": (T.StringType(), pa.string()),
}


class Phrases:
    """The distinct windows of a block of items, as codes of the block's vocabulary."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        data, rows = raw(pa.array(texts, pa.string()))
        start, end, first = words(lower(data), rows, INSIDE)
        h = hashes(data, start, end)
        self.vocabulary, code = np.unique(h, return_inverse=True)
        code = (code + 1).astype(np.int32)
        count = np.diff(first)
        # whole windows, and items of fewer words, filled up with zeros
        at = within(first, window)
        item = np.searchsorted(first, at, side="right") - 1
        few = np.flatnonzero((count > 0) & (count < window))
        short = np.zeros((len(few), window), dtype=np.int32)
        inside = np.arange(window)[None, :] < count[few][:, None]
        short[inside] = code[(first[few][:, None] + np.arange(window)[None, :])[inside]]
        rows_ = np.concatenate([code[at[:, None] + np.arange(window)[None, :]] if len(at) else short[:0], short])
        item = np.concatenate([item, few]).astype(np.int64)
        self.ids = ids
        _, one, k = np.unique(rows_.view([("", np.int32)] * window).ravel(), return_index=True, return_inverse=True)
        self.codes = rows_[one].astype(np.int64)
        self.lengths = (self.codes > 0).sum(axis=1)
        pairs = np.unique(k.ravel() * max(1, len(ids)) + item)
        self.owner = pairs % max(1, len(ids))
        self.owner_first = np.searchsorted(pairs // max(1, len(ids)), np.arange(len(one) + 1))
        self.shortest = int(self.lengths.min()) if len(one) else 0

    def find(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences in a shard: word positions, phrases and their lengths. h: word hashes; first: each row's first word."""
        none = np.zeros(0, dtype=np.int64)
        if not len(self.lengths) or not len(h):
            return none, none, none
        slot = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[slot] == h
        opens = known.copy()
        opens[1:] &= ~known[:-1]
        opens[first[:-1][first[1:] > first[:-1]]] = True
        opens &= known
        closes = known.copy()
        closes[:-1] &= ~known[1:] | opens[1:]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        enough = ends - starts >= self.shortest
        starts, size = starts[enough], (ends - starts)[enough]
        if not len(starts):
            return none, none, none
        at = np.cumsum(size + 1) - (size + 1)
        text = np.zeros(int(size.sum()) + len(size), dtype=np.int64)
        source = np.repeat(starts - at, size) + (np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size))
        target = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
        text[target] = slot[source] + 1
        index = FMIndex(text, len(self.vocabulary) + 1)
        low, high = index.search(self.codes, self.lengths)
        count = high - low
        phrase = np.repeat(np.arange(len(low)), count)
        row = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + low[phrase]
        where = index.locate(row)
        run = np.searchsorted(at, where, side="right") - 1
        return where - at[run] + starts[run], phrase, self.lengths[phrase]


def _search(phrases: Phrases, batch: pa.RecordBatch, text: str, with_text: bool, keep: list[str]) -> pa.RecordBatch:
    data, rows = raw(batch.column(text))
    start, end, first = words(lower(data), rows, INSIDE)
    where, phrase, length = phrases.find(hashes(data, start, end), first)
    n, names = batch.num_rows, batch.schema.names
    edge = np.zeros(len(start) + 1, dtype=np.int64)
    np.add.at(edge, where, 1)
    np.add.at(edge, where + length, -1)
    hit = np.cumsum(edge[:-1]) > 0
    doc = np.searchsorted(first, where, side="right") - 1
    owned = phrases.owner_first[phrase + 1] - phrases.owner_first[phrase] if len(phrase) else np.zeros(0, dtype=np.int64)
    item = phrases.owner[np.arange(int(owned.sum())) - np.repeat(np.cumsum(owned) - owned, owned) + np.repeat(phrases.owner_first[phrase], owned)] if len(phrase) else owned
    found = np.unique(np.stack([np.repeat(doc, owned), item], axis=1), axis=0)
    items: list[set] = [set() for _ in range(n)]
    for d, i in found.tolist():
        items[d].add(phrases.ids[i])
    earlier = batch.column("spans").to_pylist() if "spans" in names else None
    originals, spans, cleaned, n_hit = batch.column(text), [], [], []
    for d in range(n):
        a, b = first[d], first[d + 1]
        if earlier is not None:
            items[d] |= set(batch.column("items")[d].as_py())
        own = np.flatnonzero(hit[a:b]) + a
        if not len(own) and not (earlier and earlier[d]):
            spans.append([])
            n_hit.append(0)
            cleaned.append(None)
            continue
        whole = originals[d].as_py()
        begin = int(rows[d])
        to_chars = np.concatenate(([0], np.cumsum((data[begin : int(rows[d + 1])] & 0xC0) != 0x80)))
        marked = np.zeros(b - a, dtype=bool)
        marked[own - a] = True
        for x in earlier[d] if earlier else ():
            marked |= (to_chars[start[a:b] - begin] >= x["start"]) & (to_chars[end[a:b] - begin] <= x["end"])
        opens = np.flatnonzero(marked & ~np.concatenate(([False], marked[:-1])))
        closes = np.flatnonzero(marked & ~np.concatenate((marked[1:], [False])))
        merged = [(int(to_chars[start[a + i] - begin]), int(to_chars[end[a + j] - begin])) for i, j in zip(opens, closes)]
        spans.append([{"start": s, "end": e} for s, e in merged])
        n_hit.append(int(marked.sum()))
        if with_text:
            cuts = [0, *(x for s in merged for x in s), len(whole)]
            cleaned.append("".join(whole[x:y] for x, y in zip(cuts[::2], cuts[1::2])))
        else:
            cleaned.append(None)
    out = {k: batch.column(k) for k in keep}
    out |= {"n_words": pa.array(np.diff(first)), "n_hit": pa.array(n_hit, pa.int64()), "items": pa.array([sorted(x) for x in items], _FOUND["items"][1]), "spans": pa.array(spans, _FOUND["spans"][1])}
    if with_text:
        out["clean_text"] = pa.array([c if c is not None else o.as_py() for c, o in zip(cleaned, originals)], pa.string())
    return pa.RecordBatch.from_arrays(list(out.values()), list(out))


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[str], list[str]]]:
    ids, texts, size = [], [], 0
    for r in benchmark.toLocalIterator():
        if ids and size + len(r["text"]) > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"].encode())
    yield ids, texts


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, keep_text: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, items (sorted ids) and spans (code points, end exclusive) of benchmark phrases.

    With keep_text the text stays and `clean_text` has it without the spans; else the text column is dropped.
    """
    spark = docs.sparkSession
    wanted = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    docs = docs.drop(*[c for c in docs.columns if c in _FOUND and c != text])
    blocks = iter(_blocks(wanted, block_bytes))
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        phrases = spark.sparkContext.broadcast(Phrases(*block, window))
        last = following is None
        keep = [c for c in docs.columns if c not in _FOUND and (c != text or keep_text or not last)]
        with_text = keep_text and last
        added = [c for c in _FOUND if c != "clean_text" or with_text]
        schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, _FOUND[c][0]) for c in added])

        def run(batches, phrases=phrases, keep=keep, with_text=with_text):
            for batch in batches:
                for part in slices(batch, text):
                    yield _search(phrases.value, part, text, with_text, keep)

        docs = docs.mapInArrow(run, schema)
        block = following
    return docs


def digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def remove_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) without the benchmark's passages, n_chars following if it is there; a document of which no word stays is dropped."""
    others = [c for c in docs.columns if c != "text"]
    found = find_benchmark(docs.select(F.struct(*others).alias("__row"), "text"), benchmark, keep_text=True)
    cut = F.col("n_hit") > 0
    kept = found.where(~cut | (F.col("n_hit") < F.col("n_words"))).withColumn("text", F.when(cut, F.col("clean_text")).otherwise(F.col("text")))
    value = {c: F.col(f"__row.`{c}`") for c in others} | {"text": F.col("text")}
    if "n_chars" in others:
        value["n_chars"] = F.when(cut, F.length("text").cast("long")).otherwise(value["n_chars"])
    return kept.select(*[value[c].alias(c) for c in docs.columns])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(texts: list[str | None], items: dict[str, str | None], window: int = WINDOW) -> list[tuple]:
    """(n_words, n_hit, n_items, items_sha256, contaminated) of each text, by comparing lists of words; for tests."""
    import re

    def split(x: str | None) -> list[str]:
        x = "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x)

    out = []
    wanted = {k: split(v) for k, v in items.items()}
    for x in texts:
        w = split(x)
        hit, names = set(), set()
        for k, v in wanted.items():
            size = min(window, len(v))
            if not size:
                continue
            grams = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)}
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in grams:
                    hit.update(range(i, i + size))
                    names.add(k)
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out
