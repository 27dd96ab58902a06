"""Nearest chunks by Euclidean distance to nine decimals; ties go to the smaller id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import round3

#: Rows of the base that one task holds.
BASE_ROWS = 100_000
#: Rows that are worth a task of their own.
LEAST_ROWS = 5_000
#: Distances held at once by a task.
_CELLS = 4_000_000
#: Rows of the base, and queries, that are near one another and are looked at together.
_LEAF, _ASKED = 64, 8


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double, to nine decimals, so that the order of additions cannot part equal ones."""
    wide = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x - y)
    return F.floor(F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x)) * 1e9 + 0.5) / 1e9


def relevance(d: Column) -> Column:
    """1 - d^2 / 2 within 0 and 1: the cosine of unit vectors."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d * d / 2))


def nearest(base: DataFrame, query: list[float], k: int, id_column: str = "chunk_id") -> DataFrame:
    """The k nearest rows (id, distance) to one vector: a top-k of Spark's own."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return base.select(F.col(id_column), distance(F.col("embedding"), q).alias("distance")).orderBy("distance", id_column).limit(k)


def _leaves(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Groups of at most `size` rows that are near one another: cut at the median of the widest dimension, again and again."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= size:
            out.append(own)
            continue
        v = x[own]
        order = np.argpartition(v[:, (v.max(0) - v.min(0)).argmax()], len(own) // 2)
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return out


class _Part:
    """Rows x (ids own) in leaves, with the box of each leaf."""

    def __init__(self, own: np.ndarray, x: np.ndarray):
        leaves = _leaves(x, _LEAF)
        order = np.concatenate(leaves)
        self.own, self.x, self.square = own[order], x[order], (x[order] ** 2).sum(1)
        self.size = np.array([len(o) for o in leaves])
        self.first = np.cumsum(self.size) - self.size
        self.low, self.high = np.minimum.reduceat(self.x, self.first), np.maximum.reduceat(self.x, self.first)

    def rows(self, leaves: np.ndarray) -> np.ndarray:
        size = self.size[leaves]
        return np.repeat(self.first[leaves] - np.cumsum(size) + size, size) + np.arange(size.sum())

    def best(self, ids: np.ndarray, q: np.ndarray, k: int):
        """(query, id, distance) of the k nearest rows to each row of q, exactly; leaves that are too far from all of a group of queries are passed over."""
        for group in _leaves(q, _ASKED):
            part = q[group]
            away = np.maximum(0.0, np.maximum(self.low - part.max(0), part.min(0) - self.high))
            away = (away * away).sum(1)
            near = np.argsort(away, kind="stable")
            some = near[: np.searchsorted(np.cumsum(self.size[near]), max(k, 4 * _LEAF)) + 1]
            bound = self._bound(part, self.rows(some), k)
            reach = np.flatnonzero(away <= bound.max() + 1e-7)
            step = max(1, _CELLS // max(1, int(self.size[reach].sum())))
            rows = self.rows(reach)
            for at in range(0, len(group), step):
                yield self._best(ids[group[at : at + step]], part[at : at + step], rows, k)

    def _squares(self, part: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return (part * part).sum(1)[:, None] - 2 * part @ self.x[rows].T + self.square[rows][None, :]

    def _bound(self, part: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        at = min(len(rows), k) - 1
        return np.partition(self._squares(part, rows), at, axis=1)[:, at] if len(rows) == len(self.x) or len(rows) >= k else np.full(len(part), np.inf)

    def _best(self, ids: np.ndarray, part: np.ndarray, rows: np.ndarray, k: int):
        square = self._squares(part, rows)
        at = min(len(rows), k) - 1
        bound = np.partition(square, at, axis=1)[:, at]
        # all rows up to a hair beyond the k-th, so that rounding cannot lose a tie; of those the k best by exact distance and id
        row, col = np.nonzero(square <= bound[:, None] + 1e-7)
        col = rows[col]
        exact = np.zeros(len(row))
        for c in range(part.shape[1]):
            exact += (self.x[col, c] - part[row, c]) ** 2
        exact = np.floor(np.sqrt(exact) * 1e9 + 0.5) / 1e9
        order = np.lexsort((self.own[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        best = np.arange(len(row)) - np.searchsorted(row, np.arange(len(part)))[row] < k
        return ids[row[best]], self.own[col[best]], exact[best]


def _few(own: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors only the k smallest ids can be among the nearest."""
    _, alike = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((own, alike.ravel()))
    group = alike.ravel()[order]
    few = np.sort(order[np.arange(len(order)) - np.searchsorted(group, group) < k])
    return own[few], x[few]


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(base: DataFrame, queries: DataFrame, k: int, id_column: str = "chunk_id") -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest base rows to each query (query_id, embedding).

    Of equal vectors of the base, only the k smallest ids are dealt out, in parts of at most about BASE_ROWS; each query
    travels to every part once. A task holds its part and streams the queries by, and keeps k rows a query, so neither
    side comes to the driver and what is shuffled does not grow with the number of pairs. base is counted first, so it
    should be a kept table.
    """

    def fewer(batches):
        for batch in batches:
            if batch.num_rows:
                own, x = _few(batch.column("id").to_numpy(), _vectors(batch.column("v")), k)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(list(x), pa.list_(pa.float64()))], ["id", "v"])

    wide = lambda df, name: df.select(F.col(name).cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("v IS NOT NULL")
    few = wide(base, id_column).mapInArrow(fewer, "id bigint, v array<double>")
    n = few.count()
    # a small base is dealt to all cores
    parts = max(1, -(-n // BASE_ROWS), min(base.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)))
    rows = few.select(F.pmod(F.xxhash64("v"), F.lit(parts)).cast("int").alias("part"), F.lit(False).alias("asks"), "id", "v")
    asked = wide(queries, "query_id").select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("asks"), "id", "v")

    def run(batches):
        part, held, rows = None, [], None
        for batch in batches:
            at = batch.column("part").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if at[a] != part:
                    part, held, rows = at[a], [], None
                ids, v = batch.column("id").slice(a, b - a).to_numpy(), _vectors(batch.column("v").slice(a, b - a))
                if not asks[a]:
                    held.append((ids, v))
                    continue
                if rows is None and held:
                    rows = _Part(*_few(np.concatenate([i for i, _ in held]), np.concatenate([w for _, w in held]), k))
                    held = []
                found = list(rows.best(ids, v, k)) if rows is not None else []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["query_id", id_column, "distance"])

    dealt = rows.unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", "asks")
    found = dealt.mapInArrow(run, T.StructType([T.StructField("query_id", T.LongType()), T.StructField(id_column, T.LongType()), T.StructField("distance", T.DoubleType())]))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", id_column))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits with the columns of their chunks and the relevance score; hits without a chunk go."""
    return hits.join(chunks.drop("embedding"), "chunk_id").withColumn("score", relevance(F.col("distance")))


def citations(scored: DataFrame) -> DataFrame:
    """What a search gives back: citation, score and quote."""
    return scored.select("query_id", "rank", F.concat("path", "anchor").alias("citation"), "path", "anchor", round3(F.col("score")).alias("score"), F.replace("text", F.lit("\r"), F.lit("")).alias("quote"))
