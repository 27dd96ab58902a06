"""Reading a vault: a folder tree of Markdown notes."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that a walk leaves out, besides those with a dot in front.
SKIPPED_FOLDERS = ("node_modules",)


def walk(root: str) -> list[str]:
    """Vault-relative POSIX paths of the notes, by a listing on the driver; it also finds empty files and names with _ or . in front."""
    out = []
    for folder, folders, files in os.walk(root):
        folders[:] = [f for f in folders if not f.startswith(".") and f not in SKIPPED_FOLDERS]
        out += [Path(folder, f).relative_to(root).as_posix() for f in files if f.lower().endswith(".md")]
    return out


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime_ms, length, content) of the notes under root, which may be any path that Spark reads.

    Spark's listing leaves out empty files and names with _ or . in front; read_listed() does not.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]").load(root)
    base = root.split("://", 1)[-1].rstrip("/")
    path = F.regexp_replace(F.col("path"), r"\A[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")
    relative = path.substr(F.lit(len(base) + 2), F.length(path))
    hidden = "|".join(SKIPPED_FOLDERS)
    return raw.select(relative.alias("path"), F.unix_millis("modificationTime").alias("mtime_ms"), "length", "content").where(~F.col("path").rlike(rf"(\A|/)(\.[^/]*|{hidden})/"))


def read_listed(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """The same columns for exactly the files of walk(), or for some of them; the texts are read by the tasks, so root must be a folder that they share.

    A file that cannot be read has a null content, and the others are read nevertheless.
    """
    listed = spark.createDataFrame([(p,) for p in (walk(root) if paths is None else paths)], "path string")

    def one(name):
        try:
            file = Path(root, name)
            return int(file.stat().st_mtime * 1000), file.read_bytes()
        except OSError:
            return 0, None

    def read(batches):
        for pdf in batches:
            found = [one(p) for p in pdf["path"]]
            pdf["mtime_ms"], pdf["content"] = [m for m, _ in found], [c for _, c in found]
            pdf["length"] = [0 if c is None else len(c) for _, c in found]
            yield pdf[["path", "mtime_ms", "length", "content"]]

    return listed.mapInPandas(read, "path string, mtime_ms bigint, length bigint, content binary")


def unreadable(raw: DataFrame) -> DataFrame:
    """(path) of the files that could not be read."""
    return raw.where("content IS NULL").select("path")


def is_binary(content: Column) -> Column:
    """Whether any byte is 0."""
    return F.contains(content, F.lit(bytes([0])))


def decode(content: Column) -> Column:
    """Bytes as text; what is not UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def text_notes(raw: DataFrame) -> DataFrame:
    """(path, mtime_ms, content) with the text of the notes that could be read and are not binary."""
    return raw.where(~is_binary(F.col("content"))).select("path", "mtime_ms", decode(F.col("content")).alias("content"))
