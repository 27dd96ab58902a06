"""The chunk index: what changed since the last pass, and immutable snapshots behind a manifest."""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.functions.tables import kept
from factloom.operators.chunking import chunk_notes, link_table
from factloom.operators.embedding import Embedder

SCHEMA_VERSION = 1


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def classify(notes: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, op, content_hash): insert, update, unchanged or prune; both sides are (path, content_hash)."""
    new, old = notes.select("path", "content_hash"), indexed.select("path", F.col("content_hash").alias("old_hash"))
    op = F.when(F.col("old_hash").isNull(), "insert").when(F.col("content_hash").isNull(), "prune").when(F.col("content_hash") == F.col("old_hash"), "unchanged").otherwise("update")
    return new.join(old, "path", "full_outer").select("path", op.alias("op"), "content_hash")


def pruned(notes: DataFrame, indexed: DataFrame) -> DataFrame:
    """Paths that are in the index and no longer among the notes."""
    return indexed.select("path").join(notes.select("path"), "path", "left_anti")


def pass_stats(changes: DataFrame) -> DataFrame:
    """One row: notes (inserted or updated), skipped and pruned."""
    count = lambda *ops: F.coalesce(F.sum(F.when(F.col("op").isin(*ops), 1).otherwise(0)), F.lit(0)).cast("bigint")
    return changes.agg(count("insert", "update").alias("notes"), count("unchanged").alias("skipped"), count("prune").alias("pruned"))


def with_ids(chunks: DataFrame) -> DataFrame:
    """Chunks with deterministic ids of path and ordinal."""
    return chunks.withColumns({"note_id": F.xxhash64("path"), "chunk_id": F.xxhash64("path", "ordinal")})


class ChunkIndex:
    """A folder with snapshots (notes, chunks) in buckets of paths, and a manifest that names the snapshot of each bucket.

    A pass writes the buckets in which something changed into a new snapshot and then replaces the manifest, so
    readers see the old or the new state, and a small change rewrites little. Only changed notes are chunked and
    embedded. A change of the embedder or its width ignores what was there. The number of buckets follows the number
    of notes at the first pass, and once there are many more of them all are dealt anew. The folder must be local or
    mounted.
    """

    #: Notes of a bucket, about, and buckets at least.
    BUCKET_NOTES, LEAST_BUCKETS = 50_000, 8

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        os.makedirs(folder, exist_ok=True)

    @property
    def _manifest_path(self) -> str:
        return os.path.join(self.folder, "manifest.json")

    def manifest(self) -> dict | None:
        try:
            with open(self._manifest_path, encoding="utf-8") as f:
                found = json.load(f)
        except FileNotFoundError:
            return None
        return found if "buckets" in found else None  # one without is not of this layout

    def _table(self, name: str, only: set[str] | None = None) -> DataFrame | None:
        """The rows of a table, or those of some buckets."""
        m = self.manifest()
        if m is None:
            return None
        paths = [os.path.join(self.folder, snapshot, name, f"bucket={k}") for k, snapshot in m[name].items() if only is None or k in only]
        reader = self.spark.read.schema(StructType.fromJson(m["schemas"][name]))
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], StructType.fromJson(m["schemas"][name]))

    def notes(self) -> DataFrame | None:
        return self._table("notes")

    def chunks(self) -> DataFrame | None:
        return self._table("chunks")

    def note_id(self, path: str) -> int | None:
        """The id of a note, or none for an unknown path."""
        row = None if self.notes() is None else self.notes().where(F.col("path") == path).select("note_id").first()
        return row and row["note_id"]

    def note_chunks(self, path: str) -> DataFrame | None:
        """(chunk_id) of a note's chunks."""
        return None if self.chunks() is None else self.chunks().where(F.col("path") == path).select("chunk_id")

    def chunk(self, chunk_id: int) -> DataFrame | None:
        """The chunk of that id: one row, or none."""
        return None if self.chunks() is None else self.chunks().where(F.col("chunk_id") == chunk_id)

    def links(self) -> DataFrame | None:
        """(path, ordinal, target_note, target_anchor, alias) of all links."""
        return None if self.chunks() is None else link_table(self.chunks())

    def vector_count(self) -> int:
        chunks = self.chunks()
        return 0 if chunks is None else chunks.where("embedding is not null").count()

    def update(self, notes: DataFrame, embedder: Embedder, force: bool = False, unreadable: DataFrame | None = None) -> dict[str, int]:
        """One pass over all notes (path, mtime_ms, content); returns counts of notes, chunks, skipped, errored and pruned.

        Notes that could not be read (unreadable: path) are counted as errored and stay as they were.
        """
        hashed = kept(notes.withColumn("content_hash", content_hash(F.col("content"))))
        usable, errored = self._usable(embedder, force), 0
        changes = self._changes(hashed, self.notes() if usable else None)
        if unreadable is not None:
            errored = unreadable.count()
            marked = changes.join(unreadable.select("path").distinct().withColumn("__failed", F.lit(1)), "path", "left")
            changes = marked.withColumn("op", F.when(F.col("__failed").isNotNull() & (F.col("op") == "prune"), "kept").otherwise(F.col("op"))).drop("__failed")
        return self._write(hashed, changes, embedder, usable) | {"errored": errored}

    def merge(self, notes: DataFrame, gone: DataFrame, embedder: Embedder) -> dict[str, int]:
        """The same for some notes only: those of `gone` (path) are removed, all others stay; their buckets alone are read."""
        hashed = kept(notes.withColumn("content_hash", content_hash(F.col("content"))))
        usable = self._usable(embedder, False)
        indexed = None
        if usable:
            paths = hashed.select("path").unionByName(gone.select("path")).select(self._bucket(self.manifest()["buckets"]))
            indexed = self._table("notes", {str(r["bucket"]) for r in paths.distinct().collect()})
        changes = self._changes(hashed, indexed)
        stays = F.col("__gone").isNull() & (F.col("op") == "prune")
        changes = changes.join(gone.select("path").distinct().withColumn("__gone", F.lit(1)), "path", "left").withColumn("op", F.when(stays, "kept").otherwise(F.col("op"))).drop("__gone")
        return self._write(hashed, changes, embedder, usable)

    def _usable(self, embedder: Embedder, force: bool) -> bool:
        m = self.manifest()
        return m is not None and not force and (m["model"], m["dim"]) == (embedder.id, embedder.dim)

    def _changes(self, hashed: DataFrame, indexed: DataFrame | None) -> DataFrame:
        return classify(hashed, self.spark.createDataFrame([], "path string, content_hash string") if indexed is None else indexed)

    @staticmethod
    def _bucket(buckets: int) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket")

    def _write(self, hashed: DataFrame, changes: DataFrame, embedder: Embedder, usable: bool) -> dict[str, int]:
        snapshot = f"v-{uuid.uuid4().hex}"
        changes = kept(changes)
        stats, m = pass_stats(changes).first().asDict(), self.manifest()
        before = m["n_notes"] if usable else 0
        n_notes = before - stats["pruned"] + changes.where("op = 'insert'").count()
        wanted = max(self.LEAST_BUCKETS, -(-n_notes // self.BUCKET_NOTES))
        buckets = m["buckets"] if usable and wanted <= 4 * m["buckets"] else wanted
        anew = not usable or buckets != m["buckets"]
        changed = changes.where("op in ('insert', 'update')").select("path")
        touched = {str(r["bucket"]) for r in changes.where("op in ('insert', 'update', 'prune')").select(self._bucket(buckets)).distinct().collect()}
        fresh = {
            "chunks": embedder.embed(with_ids(chunk_notes(hashed.join(changed, "path", "left_semi").select("path", "content")))),
            "notes": hashed.join(changed, "path", "left_semi").select(F.xxhash64("path").alias("note_id"), "path", "mtime_ms", "content_hash", F.lit(int(time.time() * 1000)).alias("indexed_at")),
        }
        out = {"schema_version": SCHEMA_VERSION, "model": embedder.id, "dim": embedder.dim, "buckets": buckets, "n_notes": n_notes, "schemas": {}}
        replaced = changes.where("op in ('insert', 'update', 'prune')").select("path")
        for name, rows in fresh.items():
            place = os.path.join(self.folder, snapshot, name)
            save = lambda df, place=place: df.withColumn("bucket", self._bucket(buckets)).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(place)
            save(rows)
            if name == "chunks":
                stats["chunks"] = self.spark.read.schema(rows.schema).parquet(place).count()
            if usable and (anew or touched):
                save(self._table(name, None if anew else touched).join(replaced, "path", "left_anti"))
            # a bucket that was written anew and has no folder is empty
            stay = {} if anew else {k: v for k, v in m[name].items() if k not in touched}
            out[name] = stay | {f.removeprefix("bucket="): snapshot for f in sorted(os.listdir(place)) if f.startswith("bucket=")}
            out["schemas"][name] = m["schemas"][name] if usable else rows.schema.jsonValue()
        self._swap(out)
        return {"notes": stats["notes"], "chunks": stats["chunks"], "skipped": stats["skipped"], "errored": 0, "pruned": stats["pruned"]}

    def _swap(self, manifest: dict) -> None:
        temporary = f"{self._manifest_path}.{uuid.uuid4().hex}"
        with open(temporary, "w", encoding="utf-8") as f:
            json.dump(manifest, f)
        os.replace(temporary, self._manifest_path)

    def remove(self, path: str) -> None:
        """Drop one note; nothing happens if it is unknown."""
        m = self.manifest()
        if m is None:
            return
        one = self.spark.createDataFrame([(path,)], "path string")
        k = str(one.select(self._bucket(m["buckets"])).first()["bucket"])
        if self._table("notes", {k}).where(F.col("path") == path).isEmpty():
            return
        snapshot = f"v-{uuid.uuid4().hex}"
        for name in ("notes", "chunks"):
            place = os.path.join(self.folder, snapshot, name, f"bucket={k}")
            self._table(name, {k}).where(F.col("path") != path).write.parquet(place)
            m[name] = m[name] | {k: snapshot}
        self._swap(m | {"n_notes": m["n_notes"] - 1})
