"""What the two classifiers share: tokens, folds, and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm._shared import BROADCAST_ROWS
from factloom.llm._text import hashes, lower, raw

#: Byte classes: 0 white space and controls, 1 letters, digits and all that is not ASCII, 2 marks.
CLASSES = np.full(256, 2, dtype=np.uint8)
CLASSES[:0x21] = 0
CLASSES[0x7F] = 0
CLASSES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one byte class, in lower case: hashes, first token of each row (one more at the end), class, and whether all letters are capitals."""
    data, rows = raw(column)
    n = int(rows[-1])
    kind = CLASSES[data[:n]]
    first = np.ones(n, dtype=bool)
    first[1:] = kind[1:] != kind[:-1]
    first[rows[:-1][rows[1:] > rows[:-1]]] = True
    start = np.flatnonzero(first)
    end = np.concatenate((start[1:], [n]))[: len(start)]
    solid = kind[start] > 0
    start, end = start[solid], end[solid]
    capital = (data[:n] >= 0x41) & (data[:n] <= 0x5A)
    runs = np.concatenate(([0], np.cumsum(capital)))
    capitals = (runs[end] - runs[start] == end - start) & (end - start > 1)
    return hashes(lower(data), start, end), np.searchsorted(start, rows), kind[start], capitals


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def with_labels(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """docs that have a label, with it as __label; of several labels of a document the largest counts."""
    chosen = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("__label"))
    small = labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(chosen) if small else chosen.hint("merge"), "doc_id")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights, the last one for the constant, by damped Newton steps; x is standardised inside."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge * len(x))
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + penalty * w
        step = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + np.diag(penalty), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    out = np.append(w[:-1] / scale, w[-1])
    out[-1] -= (mean * out[:-1]).sum()
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
