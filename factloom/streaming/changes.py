"""The change feed of a vault as a stream: (path, op, ts, content) with op add, change or unlink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.index import ChunkIndex

DEBOUNCE = "250 milliseconds"


def relevant(log: DataFrame) -> DataFrame:
    """Events of notes; names with a dot in front and other files are left out."""
    return log.where(F.lower("path").endswith(".md") & ~F.col("path").rlike(r"(\A|/)\."))


def debounce(log: DataFrame, gap: str = DEBOUNCE, watermark: str | None = None) -> DataFrame:
    """One event for each run of events of a path with pauses of at most `gap`: the last one. Works on tables and, with a watermark, on streams."""
    if watermark is not None:
        log = log.withWatermark("ts", watermark)
    last = F.max_by(F.struct("op", "content"), "ts").alias("last")
    return log.groupBy("path", F.session_window("ts", gap).alias("w")).agg(last, F.max("ts").alias("ts"), F.count("*").alias("events")).select("path", F.col("last.op").alias("op"), "ts", F.col("last.content").alias("content"), "events")


def latest(log: DataFrame) -> DataFrame:
    """The last event of each path; a deletion in it cancels what was pending."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("op")))
    return log.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def follow(log: DataFrame, apply: Callable[[DataFrame, DataFrame], None], checkpoint: str, once: bool = False, settle: str | None = None):
    """Start a query over a streamed log: apply(upserts, deletes) gets the latest state of the paths in each batch.

    With settle, a watermark such as '300 milliseconds', events are debounced in the stream: a run of events of a path is
    passed on as its last one, once events that much later have been seen, so that a file still being written is left alone.
    """
    if settle is not None:
        log = debounce(relevant(log), watermark=settle)

    def batch(df: DataFrame, _: int) -> None:
        now = latest(relevant(df)).persist()
        try:
            apply(now.where("op <> 'unlink'").select("path", "content", "ts"), now.where("op = 'unlink'").select("path"))
        finally:
            now.unpersist()

    writer = log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def merge_into(index: ChunkIndex, embedder) -> Callable[[DataFrame, DataFrame], None]:
    """An apply() for follow(): changed notes replace their chunks in the index, deleted ones go, the rest stays."""

    def apply(upserts: DataFrame, deletes: DataFrame) -> None:
        index.merge(upserts.select("path", F.unix_millis("ts").alias("mtime_ms"), "content"), deletes, embedder)

    return apply
