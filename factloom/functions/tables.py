"""Tables that are used more than once."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids that may be broadcast.
BROADCAST_IDS = 1_000_000


def kept(df: DataFrame) -> DataFrame:
    """df worked out once: written to the folder of spark.checkpoint.dir, which all executors share, so that only the columns asked for are read again, or, where that is unset, persisted."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{'file://' * base.startswith('/')}{base.rstrip('/')}/factloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of df whose id is among the distinct ids (a kept table): few ids travel to the rows, so that the others are not shuffled."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids), column, "left_semi") if few else df
