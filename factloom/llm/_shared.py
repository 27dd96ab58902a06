"""Folders that all executors share, tables kept in them, and small helpers for the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a two-number side that may be broadcast; beyond it the operators shuffle both sides.
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder name in the folder of spark.checkpoint.dir, or, where that is unset and all tasks run on this machine, in a temporary one (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("factloom.shared.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("factloom.shared.dir", base)
    if "://" not in base:
        base = "file://" + base if base.startswith("/") else base
    return f"{base.rstrip('/')}/factloom-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows; df should be cheap to count (a kept table)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value worked out once a row."""
    return F.transform(F.array(value), body).getItem(0)
