"""Metrics over labelled claims, and the gates that they must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.config import EngineConfig

# Fixed values of the gates.
GATES = {"refusal_precision": 0.75, "grounding_precision": 1.0, "false_refusal_rate": 0.15, "refusal_recall": 0.90}


def ratio(hit: Column, of: Column) -> Column:
    """The share of rows with `of` that also have `hit`; 1 without any."""
    n = F.sum(F.when(of, 1).otherwise(0))
    return F.coalesce(F.sum(F.when(of & hit, 1).otherwise(0)) / F.nullif(n, F.lit(0)), F.lit(1.0))


def predicted(judged: DataFrame, keys: list[str], decisive: float = EngineConfig().decisive) -> DataFrame:
    """(keys, predicted) of judged passages (keys, passage_index, label, confidence): the first label that is not neutral and confident enough, else neutral."""
    strong = (F.col("label") != "neutral") & (F.col("confidence") >= decisive)
    first = F.min_by("label", F.when(strong, F.col("passage_index")))
    return judged.groupBy(*keys).agg(F.when(F.max(strong), first).otherwise("neutral").alias("predicted"))


def verifier_metrics(rows: DataFrame) -> DataFrame:
    """One row of metrics of (gold, predicted) labels: balanced accuracy and precisions."""
    gold, said = F.col("gold"), F.col("predicted")
    recall = [ratio(said == x, gold == x) for x in ("supported", "contradicted", "neutral")]
    refused = said != "supported"
    return rows.agg(
        F.count("*").alias("n"), ((recall[0] + recall[1] + recall[2]) / 3).alias("balanced_accuracy"), ratio(gold != "supported", refused).alias("refusal_precision"),
        ratio(gold == "supported", said == "supported").alias("grounding_precision"), ratio(gold == "contradicted", said == "contradicted").alias("contradiction_precision"),
    )


def outcome(verdict: Column) -> Column:
    """grounded or refused; flagged counts as grounded."""
    return F.when(verdict == "refused", "refused").otherwise("grounded")


def e2e_metrics(rows: DataFrame) -> DataFrame:
    """One row of metrics of (expected, verdict)."""
    want, got = F.col("expected"), outcome(F.col("verdict"))
    return rows.agg(
        F.count("*").alias("n"), ratio(got == "grounded", want == "grounded").alias("grounding_recall"), ratio(got == "refused", want == "refused").alias("refusal_recall"),
        ratio(want == "grounded", got == "grounded").alias("grounding_precision"), (1 - ratio(got == "grounded", want == "grounded")).alias("false_refusal_rate"),
    )


def by_mode(rows: DataFrame) -> DataFrame:
    """(mode, n, correct) of (mode, expected, verdict), in order of the mode."""
    right = F.sum(F.when(outcome(F.col("verdict")) == F.col("expected"), 1).otherwise(0))
    return rows.groupBy(F.coalesce("mode", F.lit("untagged")).alias("mode")).agg(F.count("*").alias("n"), right.alias("correct")).orderBy("mode")


def percentile(values: DataFrame, column: str, p: float) -> DataFrame:
    """(value): the element at floor(p * n) of the sorted values, the last at most; 0 without any.

    The place is found by a count and a sort that stays distributed, not in one list.
    """
    rows = values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("value"))
    n = rows.count()
    if not n:
        return values.sparkSession.createDataFrame([(0.0,)], "value double")
    at = min(n - 1, int(p * n))
    # equal values count together; what is summed up is one row a value of a narrow band around the place
    low, high = rows.approxQuantile("value", [max(0.0, at / n - 0.01), min(1.0, (at + 1) / n + 0.01)], 0.005)
    below = rows.where(F.col("value") < low).count()
    band = rows.where((F.col("value") >= low) & (F.col("value") <= high))
    return band.orderBy("value").offset(at - below).limit(1)


def gate_columns(metrics: DataFrame, gates: dict[str, float] = GATES) -> DataFrame:
    """The rule of passes() over rows of metrics: one boolean column for each gate that has its metric."""
    return metrics.select(*[(F.col(k) <= v if k == "false_refusal_rate" else F.col(k) >= v).alias(k) for k, v in gates.items() if k in metrics.columns])


def passes(metrics: dict[str, float], gates: dict[str, float] = GATES) -> dict[str, bool]:
    """Whether each gate among the metrics holds; the false refusal rate is an upper bound."""
    return {k: metrics[k] <= v if k == "false_refusal_rate" else metrics[k] >= v for k, v in gates.items() if k in metrics}
