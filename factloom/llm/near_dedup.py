"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

1. One pass over the texts turns each document into the set of its five-word
   shingles (64-bit hashes) and, from that, LANES minima: FAMILIES one-permutation
   sketches of BINS bins each, empty bins filled by optimal densification (each
   borrows from the bin that a fixed hash sequence reaches first). BANDS bands of
   ROWS lanes are its bucket keys. At the threshold of 0.75 a pair shares no band
   with a probability of 1e-6. Sets of up to SMALL shingles, for which bins are few,
   have as keys the rarest shingles, as many as any similar set must share one of,
   which is exact.
2. Documents with equal sets become one representative; copies never meet.
3. In each bucket, two centres get an edge to each other member: at most two edges
   a row, however large the bucket. The first is the member of the least position and
   size, the second, in each part of PART members, the one whose lanes agree most with
   all others: the hub of a group of documents that are similar to it but not to one
   another. Edges are compared first by the lanes of both sketches, whose estimate lies
   far above the bound it is held against for any true link, then on the full sets.
4. Components of the confirmed edges are contracted. A bucket whose members lie in
   one component is done. In the others, members outside the main component (strays)
   are compared with the rest by their lanes, within tasks that hold a bounded part
   of a bucket, and only pairs that may be similar leave them; sets that small ones
   may be similar to are compared in full there, and a task sends on no more of their
   links than join its rows. Buckets of all sizes are compared whole, in parts of DIRECT
   strays and parts of PART members; in those of prefix keys, pairs whose positions rule
   them out are passed over: what two sets share from their first common shingle on is
   at most what follows it in either. That a pair at the threshold shares no band, with
   a probability of 1e-6, and that fewer lanes agree than are asked for, are the ways in
   which a link may be lost, and only between sets of more than SMALL shingles.

Nothing is collected but counts. Defined cases: null and empty texts have an empty
set and link with nothing; with fewer than five words the whole sequence is the one
shingle; a null doc_id links with nothing; rows that share a doc_id are repeats of
one document; other columns are not read, and drop_near_duplicates() leaves them as
they are; doc_id is a whole number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm._shared import keep, maybe_broadcast, table
from factloom.llm._text import SPACE, U64, hashes, lower, mix, ngrams, raw, slices, words
from factloom.llm.components import components

SHINGLE = 5
PERCENT = 75
FAMILIES, BINS = 4, 64
LANES = FAMILIES * BINS
ROWS = 5
BANDS = LANES // ROWS
SMALL = 48
#: Lanes of 256 that must agree; at a similarity of 0.75, 192 do on average, with a deviation of about 7 to 9.
AGREE = 158
#: Members outside its main component (strays) that one task holds of a bucket.
DIRECT = 2048
#: Members of a bucket that one task compares with its strays at a time.
PART = 4096

#: More lanes, of FINE further families, for documents that still have to be compared; of all 1024, 768 agree on average at 0.75, with a deviation of 14.
FINE = 12
FINE_AGREE = 700
_FAMILY = mix(np.arange(1, FAMILIES + FINE + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_ORDER = np.random.default_rng(7).permutation(LANES)
_BORROW = np.random.default_rng(11).integers(0, BINS, (4096, BINS))


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, rows = raw(column)
    start, end, first = words(lower(data), rows, ~SPACE)
    h = hashes(data, start, end)
    grams = ngrams(h, SHINGLE)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        x = np.sort(grams[a : b - SHINGLE + 1]) if b - a >= SHINGLE else ngrams(h[a:b], b - a) if b > a else grams[:0]
        out.append(x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) > 1 else x)
    return out


def sketches(sets: list[np.ndarray], families: range = range(FAMILIES)) -> np.ndarray:
    """BINS minima by each of the families for each set; sets must not be empty."""
    out = np.zeros((len(sets), len(families) * BINS), dtype=U64)
    filled = np.zeros(out.shape, dtype=bool)
    edges = np.arange(BINS, dtype=U64) << U64(58)
    lanes = np.arange(BINS, dtype=U64)
    for k, x in enumerate(sets):
        for f, family in enumerate(families):
            y = mix(x * _FAMILY[family])
            y.sort()
            at = np.searchsorted(y, edges)
            v = y[np.minimum(at, len(y) - 1)]
            out[k, f * BINS : (f + 1) * BINS] = v
            filled[k, f * BINS : (f + 1) * BINS] = (at < len(y)) & (v >> U64(58) == lanes)
    for f in range(len(families)):
        part, full = out[:, f * BINS : (f + 1) * BINS], filled[:, f * BINS : (f + 1) * BINS]
        todo = np.argwhere(~full)
        for borrow in _BORROW:
            if not len(todo):
                break
            source = borrow[todo[:, 1]]
            ok = full[todo[:, 0], source]
            part[todo[ok, 0], todo[ok, 1]] = part[todo[ok, 0], source[ok]]
            todo = todo[~ok]
    return out


def _lane_bytes(m: np.ndarray) -> np.ndarray:
    return (m >> U64(20)).astype(np.uint8)


def _keys(sets: list[np.ndarray]) -> tuple[list[np.ndarray], list[bytes | None], list[np.ndarray]]:
    """Band keys, one byte of each lane, and, of sets that small ones may be similar to, the set itself."""
    keys: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(sets)
    lanes: list[bytes | None] = [None] * len(sets)
    large = [k for k, x in enumerate(sets) if len(x) > SMALL]
    if large:
        m = sketches([sets[k] for k in large])
        bands = np.zeros((len(large), BANDS), dtype=U64)
        for b in range(BANDS):
            key = np.full(len(large), b, dtype=U64)
            for lane in _ORDER[b * ROWS : (b + 1) * ROWS]:
                key = mix(key * U64(31) ^ m[:, lane])
            bands[:, b] = key
        small_bytes = _lane_bytes(m)
        for row, k in enumerate(large):
            keys[k], lanes[k] = bands[row].view(np.int64), small_bytes[row].tobytes()
    none = np.zeros(0, dtype=np.int64)
    return keys, lanes, [x.view(np.int64) if len(x) <= SMALL * 100 // PERCENT else none for x in sets]


_SKETCH = "n_shingles bigint, s1 bigint, s2 bigint, lanes binary, keys array<bigint>, small array<bigint>"


def _sketch_table(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, n_shingles, s1 and s2: hashes of the set, lanes, keys, small)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                sets = shingle_sets(part.column(text))
                keys, lanes, small = _keys(sets)
                mark = np.array([[int(np.bitwise_xor.reduce(mix(x))) if len(x) else 0, int(np.add.reduce(mix(x + U64(99)))) if len(x) else 0] for x in sets], dtype=U64).reshape(-1, 2).view(np.int64)
                columns = [part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(mark[:, 0]), pa.array(mark[:, 1]), pa.array(lanes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(small, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "s1", "s2", "lanes", "keys", "small"])

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(_SKETCH).fields])
    return docs.select("doc_id", text).mapInArrow(run, schema)


def _prefix_rows(reps: DataFrame) -> DataFrame:
    """(key, node, p) for the rarest shingles of small sets, as many as any similar set must share one of; p: how many of the set are rarer."""
    rows = reps.where(F.size("small") > 0).select("node", "n", F.explode("small").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    ordered = rows.join(shared, "key", "left").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("m", F.lit(1)).alias("m"), "key"))).alias("x"))
    length = (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1).cast("int")
    return ordered.select(F.posexplode(F.slice("x", F.lit(1), length)).alias("p", "x"), "node").where("x.m > 1").select("x.key", "node", "p")


def _shared_buckets(reps: DataFrame) -> DataFrame:
    """(key, node, p, n) of the keys that two representatives or more have; most keys have one, and go here. p: the position of a shingle, null for bands."""
    rows = reps.select(F.explode("keys").alias("key"), "node")
    shared = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    bands = rows.join(shared, "key", "left_semi").dropDuplicates(["key", "node"]).withColumn("p", F.lit(None).cast("int"))
    return keep(bands.unionByName(_prefix_rows(reps)).join(reps.select("node", "n"), "node"))


def _stars(buckets: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges (a, b) from the centres of each bucket (key, node, p, n) to the other members, where sizes, positions and lanes allow a link."""
    centre = buckets.groupBy("key").agg(F.min(F.struct("p", "n", F.xxhash64("node", "key").alias("h"), "node")).alias("c"), F.count("*").alias("m")).where("m > 1").select("key", F.col("c.node").alias("centre"), F.ceil(F.col("m") / PART).cast("int").alias("parts"))
    wide = buckets.join(centre, "key").join(reps.select("node", "lanes"), "node").withColumn("centre", F.col("node") == F.col("centre"))
    salt = F.when(F.col("centre"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.hash("node"), "parts")))
    dealt = wide.select("key", F.explode(salt).alias("salt"), "centre", "node", "n", "p", "lanes").repartition("key", "salt").sortWithinPartitions("key", "salt", F.desc("centre"))

    def run(batches):
        for rows in _whole_groups(batches, ("key", "salt")):
            a, b = _star_edges(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _whole_groups(batches, columns: tuple[str, ...]):
    """Tables of whole groups, of rows that are sorted by the columns; a group is taken to be of bounded size."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        if held.num_rows >= 2 * PART:
            last = _cuts(held, columns)[-2]
            if last:
                yield held.slice(0, last).combine_chunks()
                held = held.slice(last)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _cuts(rows: pa.Table, columns: tuple[str, ...]) -> list[int]:
    cell = [rows[c].to_numpy() for c in columns]
    return [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in cell], axis=0)) + 1).tolist(), rows.num_rows]


def _lane_rows(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of bytes for each value, and which values are there."""
    has = column.is_valid().to_numpy()
    out = np.zeros((len(has), width), dtype=np.uint8)
    if has.any():
        out[has] = np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), dtype=np.uint8).reshape(-1, width)
    return out, has


def _hub(lanes: np.ndarray) -> int:
    """The row whose lanes agree with most of the others'."""
    if len(lanes) <= 16:
        return int((lanes[:, None, :] == lanes[None, :, :]).sum(axis=(1, 2)).argmax())
    cell = lanes + np.arange(lanes.shape[1]) * 256
    return int(np.bincount(cell.ravel(), minlength=lanes.shape[1] * 256)[cell].sum(axis=1).argmax())


def _star_edges(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Edges of groups (key, salt), each with its bucket's centre in front."""
    cuts = np.array(_cuts(rows, ("key", "salt")))
    node, n = rows["node"].to_numpy(), rows["n"].to_numpy()
    after = n - rows["p"].fill_null(0).to_numpy()
    lanes, has = _lane_rows(rows["lanes"], LANES)
    size = np.diff(cuts)
    centre = np.repeat(cuts[:-1], size)
    pairs = [np.stack([centre, np.arange(len(node))])]
    for k in np.flatnonzero(size > 2).tolist():
        own = np.arange(cuts[k], cuts[k + 1])
        own = own[has[own]]
        if len(own) > 2:
            pairs.append(np.stack([np.full(len(own), own[_hub(lanes[own])]), own]))
    a, b = np.concatenate(pairs, axis=1)
    ok = (node[a] != node[b]) & _fit(n[a], n[b], after[a], after[b])
    a, b = a[ok], b[ok]
    possible = ~(has[a] & has[b])
    at = np.flatnonzero(~possible)
    for k in range(0, len(at), 1 << 16):
        part = at[k : k + (1 << 16)]
        possible[part] = (lanes[a[part]] == lanes[b[part]]).sum(axis=1) >= AGREE
    return node[a[possible]], node[b[possible]]


def _fit(n: np.ndarray, m: np.ndarray, after_n: np.ndarray, after_m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles, that share no more than after_n of the one and after_m of the other, can be similar."""
    return (100 + PERCENT) * np.minimum(after_n, after_m) >= PERCENT * (n + m)


def _compare(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one stray and one row of a bucket that differ in component, fit in size and position and may be similar by their lanes; of rows with whole sets, links that join what is similar."""
    stray = rows["stray"].to_numpy()
    node, n, root = (rows[c].to_numpy() for c in ("node", "n", "root"))
    after = n - rows["p"].fill_null(0).to_numpy()
    lanes, has = _lane_rows(rows["lanes"], LANES)
    fine, _ = _lane_rows(rows["fine"], FINE * BINS)
    members = np.flatnonzero(~stray)
    # whole sets as rows of numbers, filled up with one that no set has
    sets = rows["small"].combine_chunks()
    edge, flat_set = sets.offsets.to_numpy(), sets.values.to_numpy()
    names, ids = np.unique(flat_set[edge[0] : edge[-1]], return_inverse=True)
    exact = np.diff(edge) > 0
    whole = np.full((len(node), max(1, int(np.diff(edge).max()))), len(names), dtype=np.int32)
    whole[np.arange(whole.shape[1])[None, :] < np.diff(edge)[:, None]] = ids
    mark = np.zeros(len(names) + 1, dtype=np.uint8)
    root = np.unique(root, return_inverse=True)[1]
    # a pair that shares several buckets leaves only that of the smallest key
    others = rows["keys"].combine_chunks()
    first, flat = others.offsets.to_numpy(), others.values.to_numpy()
    width = max(1, int(np.diff(first).max()))
    earlier = np.full((len(node), width), rows["key"][0].as_py(), dtype=np.int64)
    at = np.arange(width)[None, :] < np.diff(first)[:, None]
    earlier[at] = flat[first[0] : first[-1]]
    key = earlier.dtype.type(rows["key"][0].as_py())
    out = []
    for s in np.flatnonzero(stray):
        own = members[(root[members] != root[s]) & _fit(n[members], n[s], after[members], after[s])]
        if exact[s] and len(own):
            inner = own[exact[own]]
            own = own[~exact[own]]
            mark[whole[s]] = 1
            mark[-1] = 0
            same = mark[whole[inner]].sum(axis=1, dtype=np.int64)
            mark[whole[s]] = 0
            inner = inner[100 * same >= PERCENT * (n[inner] + n[s] - same)]
            if len(inner):
                linked, one = np.unique(root[inner], return_index=True)
                out.append((np.full(len(one), node[s]), node[inner[one]]))
                root[np.isin(root, linked)] = root[s]
        if has[s] and len(own):
            agree = (lanes[own] == lanes[s]).sum(axis=1)
            own, agree = own[~has[own] | (agree >= AGREE)], agree[~has[own] | (agree >= AGREE)]
            own = own[~has[own] | (agree + (fine[own] == fine[s]).sum(axis=1) >= FINE_AGREE)]
        if len(own):
            before = flat[first[s] : first[s + 1]]
            before = before[before < key]
            own = own[~np.isin(earlier[own], before).any(axis=1)] if len(before) else own
        out.append((np.full(len(own), node[s]), node[own]))
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, dtype=np.int64) for k in (0, 1))


def _pairs(buckets: DataFrame, lanes: DataFrame) -> DataFrame:
    """Candidate edges from members outside a bucket's main component to members of other components.

    buckets: (key, node, n, p, root, outside, stray, m). A bucket is dealt out in parts of
    PART members, each once with each part of DIRECT strays (rows marked outside, stray in
    all); pairs are compared within a task, and only those that may be similar leave it,
    from the first bucket they share.
    """
    keys = buckets.groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("keys"))  # at most BANDS and a prefix
    wide = buckets.join(lanes, "node").join(keys, "node")
    parts, stray_parts = (F.greatest(F.lit(1), F.ceil(F.col(c) / most)).cast("int") for c, most in (("m", PART), ("stray", DIRECT)))
    each = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    columns = ["node", "n", "p", "root", "lanes", "fine", "small", "keys"]
    members = wide.select("key", F.pmod(F.hash("node"), parts).alias("salt"), each(stray_parts).alias("part"), F.lit(False).alias("stray"), *columns)
    strays = wide.where("outside").select("key", each(parts).alias("salt"), F.pmod(F.xxhash64("node"), stray_parts).cast("int").alias("part"), F.lit(True).alias("stray"), *columns)
    cell = ("key", "salt", "part")

    def run(batches):
        for rows in _whole_groups(batches, cell):
            at = _cuts(rows, cell)
            found = [_compare(rows.slice(a, b - a)) for a, b in zip(at, at[1:])]
            a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    dealt = members.unionByName(strays).repartition(*cell).sortWithinPartitions(*cell)
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _chosen(docs: DataFrame, text: str, wanted: DataFrame, column: str, encode) -> DataFrame:
    """(doc_id, column): encode(sets of a run of rows) for the documents of wanted (doc_id), kept."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(encode(shingle_sets(part.column(text))), pa.binary())], ["doc_id", column])

    found = docs.select("doc_id", text).join(maybe_broadcast(keep(wanted)), "doc_id", "left_semi")
    return keep(found.mapInArrow(run, f"doc_id bigint, {column} binary").dropDuplicates(["doc_id"]))


def _all_lanes(nodes: DataFrame, reps: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(node, lanes, small, fine): one byte of each lane of the nodes' sketches, null for small sets, and the sets that small ones may be similar to."""

    def encode(sets):
        out = [None] * len(sets)
        large = [k for k, x in enumerate(sets) if len(x) > SMALL]
        if large:
            for k, row in zip(large, _lane_bytes(sketches([sets[k] for k in large], range(FAMILIES, FAMILIES + FINE)))):
                out[k] = row.tobytes()
        return out

    fine = _chosen(docs, text, nodes.select(F.col("node").alias("doc_id")), "fine", encode).withColumnRenamed("doc_id", "node")
    return keep(fine.join(reps.select("node", "lanes", "small"), "node"))


def _confirm(edges: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Edges whose full sets are similar enough."""
    edges = keep(edges)
    wanted = edges.select(F.col("a").alias("doc_id")).unionByName(edges.select(F.col("b").alias("doc_id"))).distinct()
    chosen = _chosen(docs, text, wanted, "set", lambda sets: [x.tobytes() for x in sets])
    own = lambda x: chosen.select(F.col("doc_id").alias(x), F.col("set").alias(f"set_{x}"))
    wide = edges.join(own("a"), "a").join(own("b"), "b").select("a", "b", "set_a", "set_b")

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(s.as_buffer(), dtype=U64) for s in (x, y))
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * same >= PERCENT * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return keep(wide.mapInArrow(run, edges.schema))


def _mixed(buckets: DataFrame) -> DataFrame:
    """(key, node, n, root, m, main, stray, outside) of the buckets with two components or more: members, the largest component, how many lie outside it, and whether this one does."""
    by_root = buckets.groupBy("key", "root").agg(F.count("*").alias("m"))
    by_key = by_root.groupBy("key").agg(F.max(F.struct("m", "root")).alias("top"), F.sum("m").alias("m")).where("m > top.m").select("key", "m", F.col("top.root").alias("main"), (F.col("m") - F.col("top.m")).alias("stray"))
    return buckets.join(by_key, "key").withColumn("outside", F.col("root") != F.col("main"))


def _open_buckets(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """What _mixed() gives for the components (node, root) of the links so far."""
    roots = maybe_broadcast(roots)
    return keep(_mixed(buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))))


def _candidates_of_rest(rest: DataFrame, reps: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Edges between members of different components, in the whole of each bucket, however many strays it has."""
    return _pairs(rest, _all_lanes(rest.select("node").distinct(), reps, docs, text))


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs; other columns are not read."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text)
    sketch = keep(_sketch_table(docs, text))
    alive = sketch.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    rep_of = keep(alive.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    rep_ids = maybe_broadcast(rep_of.select(F.col("rep").alias("doc_id"), "s1", "s2"))
    reps = keep(alive.join(rep_ids, ["doc_id", "s1", "s2"]).select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "lanes", "keys", "small").dropDuplicates(["node"]))
    buckets = _shared_buckets(reps)
    first = components(_confirm(_stars(buckets, reps), docs, text))
    rest = _candidates_of_rest(_open_buckets(buckets, first), reps, docs, text)
    # the first links go on as the stars of their components
    roots = components(first.toDF("a", "b").unionByName(_confirm(rest, docs, text)))
    of_rep = rep_of.join(roots, rep_of["rep"] == roots["node"], "left").select("s1", "s2", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    own = sketch.select("doc_id", "n_shingles", "s1", "s2").join(of_rep, ["s1", "s2", "n_shingles"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return own.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs of which one of each group stays, the one with the smallest doc_id."""
    gone = keep(near_duplicates(docs, text).where(~F.col("kept")).select("doc_id").distinct())
    return docs.join(maybe_broadcast(gone), "doc_id", "left_anti").select(*docs.columns)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
