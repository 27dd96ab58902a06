"""Labelled claims as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import trim


def read_jsonl(spark: SparkSession, path: str, schema: str, comments: bool = False) -> DataFrame:
    """Rows of a JSON-lines file; blank lines go, and with comments also lines that begin with //."""
    lines = spark.read.text(path).select(trim(F.col("value")).alias("line")).where("line <> ''")
    if comments:
        lines = lines.where(~F.col("line").startswith("//"))
    return lines.select(F.from_json("line", schema).alias("x")).select("x.*")
