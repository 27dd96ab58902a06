"""Queries that go through files: sources, the index, its passes, the stream that feeds it, edits and snapshots."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.engine import Engine
from factloom.functions.text import round3
from factloom.operators import index, revisions
from factloom.operators.embedding import FixedEmbedder
from factloom.plans import oracle
from factloom.plans.corpus import EMBEDDER, notes_of, table
from factloom.plans.registry import query
from factloom.sources import jsonl, vault
from factloom.streaming import changes

#: The corpus of the first and of the second pass, as SQL that both engines read.
FIRST = "SELECT * FROM documents WHERE doc_id % 13 <> 0"
SECOND = "SELECT doc_id, source, lang, CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0"
_HASHES = "SELECT path, sha256(content) AS content_hash FROM (SELECT {0} FROM ({1}))"


def scratch(spark: SparkSession) -> str:
    """A new folder in that of spark.checkpoint.dir, or, where that is unset, a temporary one. Vaults and manifests need a mounted folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp()
    base = base.removeprefix("file://").removeprefix("file:")
    if "://" in base:
        raise ValueError(f"vaults and indexes need a folder that is mounted on all machines, not {base}")
    folder = os.path.join(base, f"factloom-{uuid.uuid4().hex}")
    os.makedirs(folder)
    return folder


def _rows(spark: SparkSession, d: str, sql: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "text")
    if sql == SECOND:
        docs = docs.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    else:
        docs = docs.where("doc_id % 13 <> 0")
    return notes_of(docs).select("path", F.lit(0).cast("bigint").alias("mtime_ms"), "content")


def _built(spark: SparkSession, d: str) -> index.ChunkIndex:
    out = index.ChunkIndex(spark, scratch(spark))
    out.update(_rows(spark, d, FIRST), EMBEDDER)
    return out


def _stats(spark: SparkSession, stats: dict[str, int]) -> DataFrame:
    return spark.createDataFrame([stats], "notes bigint, chunks bigint, skipped bigint, errored bigint, pruned bigint")


# ---- the index


@query(_HASHES.format(oracle.CORPUS, FIRST))
def k1_insert_notes(spark, d):
    return _built(spark, d).notes().select("path", "content_hash")


@query(oracle.chunker(FIRST) + "SELECT path, ordinal, anchor, heading_path, block_id, char_start, text FROM chunks")
def k2_insert_chunks(spark, d):
    return _built(spark, d).chunks().select("path", "ordinal", "anchor", "heading_path", "block_id", "char_start", "text")


@query(oracle.chunker(FIRST) + "SELECT path, ordinal, target_note, target_anchor, alias FROM links")
def k3_insert_links(spark, d):
    return _built(spark, d).links()


@query(oracle.VECTORS.replace("FROM documents)", f"FROM ({FIRST}))", 1) + "SELECT path, ordinal, " + ", ".join(f"floor(e[{k + 1}] * 1000 + 0.5) / 1000 AS x{k}" for k in range(8)) + " FROM base")
def k4_insert_vectors(spark, d):
    return _built(spark, d).chunks().select("path", "ordinal", *[round3(F.col("embedding")[k]).alias(f"x{k}") for k in range(8)])


@query(_HASHES.format(oracle.CORPUS, SECOND))
def k5_delete_notes(spark, d):
    """Notes that went between two passes are gone, changed ones have their new hash."""
    built = _built(spark, d)
    built.update(_rows(spark, d, SECOND), EMBEDDER)
    return built.notes().select("path", "content_hash")


@query(oracle.chunker(SECOND) + "SELECT path, count(*) AS n_chunks, count(DISTINCT ordinal) AS n_vectors, sha256(string_agg(text, chr(1) ORDER BY ordinal)) AS text_hash FROM chunks GROUP BY path")
def k6_delete_vectors(spark, d):
    """No chunk or vector of an earlier text of a note is left after a second pass."""
    built = _built(spark, d)
    built.update(_rows(spark, d, SECOND), EMBEDDER)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\u0001")
    return built.chunks().groupBy("path").agg(F.count("*").alias("n_chunks"), F.countDistinct(F.when(F.col("embedding").isNotNull(), F.col("ordinal"))).alias("n_vectors"), F.sha2(texts, 256).alias("text_hash"))


@query("SELECT pass, 1 AS schema_version, model, dim FROM (VALUES (1, 'keywords:the,er,on,ti,ch,le,de,ou', 8), (2, 'fixed', 4)) t(pass, model, dim)")
def k7_meta(spark, d):
    built = _built(spark, d)
    first = built.manifest()
    built.update(_rows(spark, d, SECOND), FixedEmbedder())
    rows = [(k, m["schema_version"], m["model"], m["dim"]) for k, m in ((1, first), (2, built.manifest()))]
    return spark.createDataFrame(rows, "pass int, schema_version int, model string, dim int")


_ALL_NEW = oracle.chunker(SECOND) + "SELECT (SELECT count(*) FROM corpus) AS notes, (SELECT count(*) FROM chunks) AS chunks, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS errored, CAST(0 AS BIGINT) AS pruned"


@query(_ALL_NEW)
def k8_model_change(spark, d):
    """Another embedder: the old index does not count, all notes are new."""
    return _stats(spark, _built(spark, d).update(_rows(spark, d, SECOND), FixedEmbedder()))


@query(_ALL_NEW)
def k10_force(spark, d):
    return _stats(spark, _built(spark, d).update(_rows(spark, d, SECOND), EMBEDDER, force=True))


@query(_HASHES.format(oracle.CORPUS, FIRST) + " WHERE path <> (SELECT min(path) FROM (" + _HASHES.format(oracle.CORPUS, FIRST) + "))")
def k11_remove_note(spark, d):
    """One note is removed; the removal of an unknown one does nothing."""
    built = _built(spark, d)
    built.remove(built.notes().agg(F.min("path")).first()[0])
    built.remove("none/such.md")
    return built.notes().select("path", "content_hash")


@query(oracle.chunker(FIRST) + "SELECT ordinal, text FROM chunks WHERE path = (SELECT max(path) FROM chunks)")
def i6_note_chunks(spark, d):
    """The chunks of one note, by the ids that the index gives for it."""
    built = _built(spark, d)
    path = built.notes().agg(F.max("path")).first()[0]
    return built.chunks().join(built.note_chunks(path), "chunk_id").select("ordinal", "text")


@query(oracle.CHANGES.replace("'d' || doc_id AS path", oracle.CORPUS.split(", ", 1)[1].split(" AS path")[0] + " AS path") + "SELECT count(*) FILTER (op IN ('insert', 'update')) AS notes, count(*) FILTER (op = 'unchanged') AS skipped, (SELECT count(*) FROM documents WHERE doc_id % 17 = 0) AS errored, count(*) FILTER (op = 'prune') AS pruned FROM changes WHERE CAST(regexp_extract(path, '([0-9]+)\\.md$', 1) AS BIGINT) % 17 <> 0")
def i7_errored(spark, d):
    """Notes that cannot be read in the second pass are counted, and neither changed nor pruned."""
    built, of = _built(spark, d), F.regexp_extract("path", r"([0-9]+)\.md\z", 1).cast("bigint") % 17
    readable = _rows(spark, d, SECOND).where(of != 0)
    lost = notes_of(table(spark, d, "documents").where("doc_id % 17 = 0")).select("path")
    return _stats(spark, built.update(readable, EMBEDDER, unreadable=lost)).select("notes", "skipped", "errored", "pruned")


@query(oracle.chunker(FIRST) + "SELECT path, ordinal, anchor, text FROM chunks WHERE ordinal = 1 AND path IN (SELECT min(path) FROM chunks UNION ALL SELECT max(path) FROM chunks)")
def i9_lookup(spark, d):
    """Chunks by their ids, and no note of an unknown path."""
    built = _built(spark, d)
    paths = built.notes().agg(F.min("path"), F.max("path")).first()
    ids = [r["chunk_id"] for p in paths if built.note_id(p) is not None for r in built.note_chunks(p).join(built.chunks().where("ordinal = 1"), "chunk_id").select("chunk_id").collect()]
    if built.note_id("none/such.md") is not None:
        raise AssertionError("an unknown note has an id")
    return built.chunk(ids[0]).unionByName(built.chunk(ids[1])).select("path", "ordinal", "anchor", "text")


@query(oracle.chunker(FIRST) + "SELECT count(*) AS vectors FROM chunks")
def i10_vector_count(spark, d):
    return spark.createDataFrame([(_built(spark, d).vector_count(),)], "vectors bigint")


# ---- the change feed


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Every note is added, some are changed, some deleted, and files that are no notes come in between."""
    added = notes_of(table(spark, d, "documents").select("doc_id", "source", "lang", "text"))
    at = lambda k: (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.lit(k))).alias("ts")
    row = lambda df, path, op, k, content: df.select(path.alias("path"), F.lit(op).alias("op"), at(k), content.alias("content"))
    path, content = F.col("path"), F.col("content")
    parts = [
        row(added, path, "add", 0, content), row(added.where("doc_id % 11 = 0"), path, "change", 5, F.concat(content, F.lit("!"))), row(added.where("doc_id % 7 = 0"), path, "unlink", 9, F.lit(None).cast("string")),
        row(added.where("doc_id % 5 = 0"), F.concat(F.lit(".trash/"), path), "add", 1, content), row(added.where("doc_id % 3 = 0"), F.concat(path, F.lit(".bak")), "add", 2, content),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_EVENTS = f"WITH corpus AS (SELECT {oracle.CORPUS} FROM documents)"


@query(_EVENTS + "SELECT path, 'add' AS op FROM corpus UNION ALL SELECT path, 'change' FROM corpus WHERE doc_id % 11 = 0 UNION ALL SELECT path, 'unlink' FROM corpus WHERE doc_id % 7 = 0")
def r1_change_feed(spark, d):
    return changes.relevant(_log(spark, d)).select("path", "op")


@query(_EVENTS + "SELECT path, sha256(content || CASE WHEN doc_id % 11 = 0 THEN '!' ELSE '' END) AS content_hash FROM corpus WHERE doc_id % 7 <> 0")
def r5_stream_upsert(spark, d):
    """The log read as a stream; each batch brings the index up to date."""
    folder = scratch(spark)
    _log(spark, d).write.parquet(os.path.join(folder, "log"))
    built = index.ChunkIndex(spark, os.path.join(folder, "index"))
    stream = spark.readStream.schema("path string, op string, ts timestamp, content string").parquet(os.path.join(folder, "log"))
    changes.follow(stream, changes.merge_into(built, EMBEDDER), os.path.join(folder, "checkpoint"), once=True).awaitTermination()
    return built.notes().select("path", "content_hash")


# ---- files


def _vault(spark: SparkSession, d: str) -> str:
    """The corpus as files, written by the tasks: every third in upper case, some hidden, some no notes, some binary."""
    root = scratch(spark)
    rows = notes_of(table(spark, d, "documents").select("doc_id", "source", "lang", "text")).withColumn(
        "path", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("path", r"\.md\z", ".MD")).when(F.col("doc_id") % 5 == 0, F.concat(F.lit(".hidden/"), "path")).when(F.col("doc_id") % 7 == 0, F.concat("path", F.lit(".txt"))).otherwise(F.col("path"))
    )

    def write(batches):
        for pdf in batches:
            for doc, path, content in zip(pdf["doc_id"], pdf["path"], pdf["content"]):
                file = Path(root, path)
                file.parent.mkdir(parents=True, exist_ok=True)
                file.write_bytes(content.encode() + (b"\0" if doc % 4 == 0 else b""))
            yield pdf[["path"]]

    rows.mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()
    return root


_SEEN = f"WITH corpus AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(path, '\\.md$', '.MD') ELSE path END AS path, content FROM (SELECT {oracle.CORPUS} FROM documents) WHERE doc_id % 3 = 0 OR (doc_id % 5 <> 0 AND doc_id % 7 <> 0))"


@query(_SEEN + "SELECT path FROM corpus")
def s1_walk(spark, d):
    return spark.createDataFrame([(p,) for p in vault.walk(_vault(spark, d))], "path string")


@query(_SEEN + "SELECT path, strlen(content) + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS length, sha256(content || CASE WHEN doc_id % 4 = 0 THEN chr(0) ELSE '' END) AS hash FROM corpus")
def s2_read_notes(spark, d):
    return vault.read_notes(spark, _vault(spark, d)).select("path", "length", F.sha2("content", 256).alias("hash"))


@query(_SEEN + "SELECT path, sha256(content) AS hash FROM corpus WHERE doc_id % 4 <> 0")
def s4_text_notes(spark, d):
    """The notes as text, without the binary ones, read one by one in the tasks."""
    return vault.text_notes(vault.read_listed(spark, _vault(spark, d))).select("path", F.sha2("content", 256).alias("hash"))


@query(_SEEN + "SELECT path, sha256(content) AS content_hash FROM corpus WHERE doc_id % 4 <> 0")
def s5_index_open(spark, d):
    """An index that another engine has written is opened anew, and read."""
    root = _vault(spark, d)
    home = scratch(spark)
    Engine(spark, root, home, EMBEDDER).index_all()
    return Engine(spark, root, home, EMBEDDER).index.notes().select("path", "content_hash")


@query("SELECT doc_id, source, sha256(text) AS hash FROM documents WHERE doc_id % 10 <> 0")
def s7_jsonl(spark, d):
    """Documents as JSON lines, every tenth behind a comment sign, and blank lines between them."""
    folder = os.path.join(scratch(spark), "lines")
    line = F.to_json(F.struct("doc_id", "source", "text"))
    table(spark, d, "documents").select(F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("// "), line)).otherwise(F.concat(line, F.lit("\n  "))).alias("value")).write.text(folder)
    return jsonl.read_jsonl(spark, folder, "doc_id bigint, source string, text string", comments=True).select("doc_id", "source", F.sha2("text", 256).alias("hash"))


# ---- edits


@query("SELECT doc_id, '@@ -' || n || ',1 +' || n || ',1 @@' || chr(10) || array_to_string(list_concat(list_transform(a[greatest(1, n - 3):n - 1], lambda x: ' ' || x), ['-' || a[n]], ['+' || b[n]], list_transform(a[n + 1:n + 3], lambda x: ' ' || x)), chr(10)) AS diff FROM (SELECT doc_id, a, b, list_filter(range(1, len(a) + 1), lambda k: a[k] <> b[k])[1] AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS a, string_split(replace(text, ' the ', ' THE '), chr(10)) AS b FROM documents WHERE (length(text) - length(replace(text, ' the ', ''))) // 5 = 1))")
def w4_line_diff(spark, d):
    """The diff of each text that holds one " the " with what it becomes."""

    @F.pandas_udf("string")
    def diff(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([revisions.line_diff(a, b) for a, b in zip(old, new)], dtype=object)

    docs = table(spark, d, "documents").select("doc_id", "text", revisions.replace_unique(F.col("text"), F.lit(" the "), F.lit(" THE ")).alias("new"))
    return docs.where("new IS NOT NULL").select("doc_id", diff("text", "new").alias("diff"))


#: Edits of one note, more than snapshots are kept of.
EDITS = 25


@query(f"SELECT k AS rank, 'state ' || ({EDITS} - k) AS content FROM range(1, 21) t(k) UNION ALL SELECT 0, 'state {EDITS}'")
def w5_snapshots(spark, d):
    """A note after 25 confirmed edits (rank 0), and its snapshots, the newest first."""
    root = scratch(spark)
    Path(root, "note.md").write_text("state 0", encoding="utf-8")
    editor = revisions.NoteEditor(root, os.path.join(root, ".snapshots"))
    for k in range(EDITS):
        preview = editor.edit("note.md", f"state {k}", f"state {k + 1}")
        editor.edit("note.md", f"state {k}", f"state {k + 1}", preview.token)
    files = [str(Path(root, "note.md")), *editor.listing("note.md")]
    return spark.createDataFrame([(k, Path(f).read_text(encoding="utf-8")) for k, f in enumerate(files)], "rank bigint, content string")


@query("SELECT * FROM (VALUES ('edited', 'The north pier opens in May.'), ('restored', 'The north pier opens in June.')) t(step, text)")
def t5_edit_restore(spark, d):
    """What the index holds of a note after an edit through the engine, and after its restore."""
    root = scratch(spark)
    Path(root, "pier.md").write_text("The north pier opens in June.", encoding="utf-8")
    engine = Engine(spark, root, scratch(spark), EMBEDDER)
    engine.index_all()
    done = engine.safe_edit("pier.md", "June", "May", engine.safe_edit("pier.md", "June", "May").token)
    edited = engine.index.chunks().select(F.lit("edited").alias("step"), "text")
    engine.restore("pier.md", done.snapshot)
    return edited.unionByName(engine.index.chunks().select(F.lit("restored").alias("step"), "text"))
