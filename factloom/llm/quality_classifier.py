"""A quality classifier: naive Bayes support vectors.

Features are indicators of token unigrams and bigrams, of capital tokens and of
the share (in steps) of marks, repeats and distinct tokens, hashed to DIMENSIONS.
They are scaled by the log-count ratios of the two classes and each row to length
1; a linear hinge-loss model is fitted by dual coordinate descent, drawn towards
naive Bayes by INTERPOLATION, and its margin turned into a probability by a
logistic fit on a quarter of the sample that the descent did not see.

The fit takes a bounded sample: at most about SAMPLE_DOCS labelled rows, chosen by
a hash of doc_id among those whose crc32(doc_id) modulo 5 is not 0; their feature
lists are all that reaches the driver. Scoring is one pass over all whole texts
with a weight table of fixed size. Label, language, source and id are no features.

Defined cases: a null text is an empty one and scores as any text without
features; without labels of both classes the score is the mean label, or 0.5;
null labels are none; repeated rows score alike; extra columns stay, but for
those with names of output columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm._labelled import fold, held_out, logistic, sigmoid, tokens, with_labels
from factloom.llm._shared import table
from factloom.llm._text import U64, mix, slices

DIMENSIONS = 1 << 20
SAMPLE_DOCS = 8000
INTERPOLATION = 0.5
COST = 1.0
PASSES = 12
#: Scores from here on predict label 1.
ACCEPT = 0.3


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of all rows in one array, and where each row's begin."""
    h, first, kind, capitals = tokens(column)
    n, size = len(first) - 1, np.diff(first)
    row = np.repeat(np.arange(n), size)
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    pair = np.flatnonzero(row[1:] == row[:-1])
    found = [(row, mix(h)), (row[pair], mix(h[pair] * U64(31) + h[pair + 1]))]
    each = np.flatnonzero(size)
    order = np.lexsort((h, row))
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    for k, flag in enumerate((kind == 2, same, capitals, fresh[np.argsort(order)])):
        share = np.bincount(row, weights=flag, minlength=n)[each] / size[each]
        found.append((each, mix((np.ceil(share * 20) + 1000 * (k + 1)).astype(U64))))
    found.append((each, mix((np.log2(size[each]).astype(np.int64) + 9000).astype(U64))))
    key = np.concatenate([r.astype(np.int64) * DIMENSIONS + (f >> U64(44)).astype(np.int64) for r, f in found]) if len(h) else np.zeros(0, dtype=np.int64)
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return key % DIMENSIONS, np.searchsorted(key // DIMENSIONS, np.arange(n + 1))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    slope: float
    constant: float

    def margins(self, column: pa.Array) -> np.ndarray:
        f, first = features(column)
        total = np.concatenate(([0.0], np.cumsum(self.weights[f], dtype=np.float64)))
        size = np.diff(first)
        return (total[first[1:]] - total[first[:-1]]) / np.sqrt(np.maximum(size, 1))

    def scores(self, column: pa.Array) -> np.ndarray:
        return sigmoid(self.slope * self.margins(column) + self.constant)


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The hinge-loss model by dual coordinate descent; rows are indicators scaled by ratio and to length 1."""
    w = np.zeros(len(ratio))
    values = [ratio[r] / max(1.0, np.sqrt(len(r))) for r in rows]
    norm = np.array([v @ v for v in values])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(5)
    active = np.flatnonzero(norm > 0)
    for turn in range(PASSES):
        keep = []
        for i in rng.permutation(active):
            gradient = y[i] * (w[rows[i]] @ values[i]) - 1
            old = alpha[i]
            new = min(max(old - gradient / norm[i], 0.0), cost[i])
            if new != old:
                alpha[i] = new
                w[rows[i]] += (new - old) * y[i] * values[i]
            if not (old == new == 0 and gradient > 1 or old == new == cost[i] and gradient < -1) or turn < 2:
                keep.append(i)
        active = np.array(keep, dtype=np.int64)
        if not len(active):
            break
    return w


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model from feature lists and labels 0 or 1."""
    labels = np.asarray(labels, dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        p = min(max(labels.mean(), 1e-3), 1 - 1e-3) if len(labels) else 0.5
        return Model(np.zeros(DIMENSIONS), 0.0, float(np.log(p / (1 - p))))
    check = np.arange(len(rows)) % 4 == 3
    if len(set(labels[check].tolist())) < 2 or len(set(labels[~check].tolist())) < 2:
        check[:] = False
    learn = np.flatnonzero(~check)
    count = np.ones((2, DIMENSIONS))
    for i in learn:
        count[labels[i], rows[i]] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    share = np.bincount(labels[learn], minlength=2) / len(learn)
    own = [rows[i] for i in learn]
    y = np.where(labels[learn] == 1, 1.0, -1.0)
    w = _descend(own, y, ratio, COST * 0.5 / share[labels[learn]])
    w = INTERPOLATION * w + (1 - INTERPOLATION) * np.abs(w[w != 0]).mean() if (w != 0).any() else np.ones(DIMENSIONS)
    raw_model = Model(w * ratio, 1.0, 0.0)
    test = np.flatnonzero(check) if check.any() else learn
    margins = np.array([raw_model.weights[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) for i in test])
    slope, constant = logistic(margins[:, None], labels[test])
    return Model(raw_model.weights, float(slope), float(constant))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", sample: int = SAMPLE_DOCS) -> Model:
    known = labels.where(F.col(label).isNotNull() & (fold(F.col("doc_id")) != 0))
    n = known.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(1, n)))
    own = with_labels(docs.select("doc_id", text), known.where(part), label)

    def extract(batches):
        for batch in batches:
            for rows in slices(batch, text):
                f, first = features(rows.column(text))
                packed = [f[a:b].astype(np.int32).tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("__label"), pa.array(packed, pa.binary())], ["doc_id", "label", "features"])

    got = own.select("doc_id", "__label", text).mapInArrow(extract, T.StructType([docs.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("features", T.BinaryType())])).toArrow().sort_by("doc_id")
    return fit([np.frombuffer(x.as_py(), dtype=np.int32) for x in got["features"]], got["label"].to_numpy())


def score(docs: DataFrame, model, text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """docs without the text, with held_out, score and predicted; model: anything with scores(column)."""
    others = [c for c in docs.columns if c not in (text, "held_out", "score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for rows in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in others), pa.array(sent.value.scores(rows.column(text)).astype(np.float64))], [*others, "score"])

    scored = docs.select(*others, text).mapInArrow(run, T.StructType([*(docs.schema[c] for c in others), T.StructField("score", T.DoubleType())]))
    return scored.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= accept).cast("int")})


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "held_out", "score", "predicted")
