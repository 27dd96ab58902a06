"""The engine's surface: index a vault, search, verify, cite, edit and restore."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.config import EngineConfig
from factloom.operators import claims as C
from factloom.operators import search as S
from factloom.operators import verdict as V
from factloom.functions.tables import kept, only
from factloom.operators.embedding import Embedder, choose_embedder
from factloom.operators.index import ChunkIndex
from factloom.operators.judge import Judge, choose_judge
from factloom.operators.revisions import NoteEditor
from factloom.sources.vault import read_listed, text_notes, unreadable

VERSION = "0.1.0"
#: Claims of one vector that a task judges.
CLAIMS = 1000
# Bounds of the inputs.
LIMITS = {"query": 1000, "results": 50, "claim": 8000, "sources": 50, "source_text": 50_000, "path": 1024, "edit": 50_000}


def verify(answers: DataFrame, chunks: DataFrame, embedder: Embedder, judge: Judge, config: EngineConfig = EngineConfig(), sources: DataFrame | None = None) -> DataFrame:
    """Results for answers (answer_id, text) against chunks with embeddings, or, where an answer has rows in sources
    (answer_id, path, anchor, text, and perhaps ordinal, else their order is that of path, anchor and text), against those alone."""
    found = kept(C.decompose(answers))
    searched = found if sources is None else found.join(sources.select("answer_id").distinct(), "answer_id", "left_anti")
    # equal claims are embedded once, and equal vectors searched once
    distinct = kept(embedder.embed(searched.groupBy("claim").agg(F.count("*").alias("n")), "claim").withColumn("query_id", F.xxhash64("embedding")))
    vectors = distinct.groupBy("query_id").agg(F.first("embedding").alias("embedding"), F.ceil(F.sum("n") / CLAIMS).cast("int").alias("parts"))
    hits = S.search(chunks, vectors, config.knn).withColumn("score", S.relevance(F.col("distance")))
    hits = kept(hits.where(F.col("score") >= config.evidence_min_score))
    note = ["path", "anchor", "block_id", "heading_path", "text"]
    near = only(chunks.select("chunk_id", *note), kept(hits.select("chunk_id").distinct()), "chunk_id").withColumn("passage", V.clean(F.col("text"))).join(hits, "chunk_id")
    # the claims of a vector that many have are dealt out, and its passages with each part
    parts = vectors.select("query_id", "parts")
    near = near.join(parts, "query_id").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    asking = searched.join(distinct.select("claim", "query_id").join(parts, "query_id"), "claim")
    asking = asking.withColumn("__part", F.pmod(F.xxhash64("answer_id", "claim_id"), "parts").cast("int"))
    columns = ["answer_id", "claim_id", "claim", "chunk_id", "distance", "score", *note, "passage", (F.col("rank") - 1).alias("passage_index")]
    passages = asking.join(near, ["query_id", "__part"]).select(*columns)
    if sources is not None:
        order = ["ordinal"] if "ordinal" in sources.columns else []
        given = sources.withColumn("rank", F.row_number().over(V.Window.partitionBy("answer_id").orderBy(*order, "path", "anchor", "text")))
        none = F.lit(None).cast("string")
        given = given.select("answer_id", "path", "anchor", "text", "rank", (-F.col("rank")).cast("bigint").alias("chunk_id"), F.lit(0.0).alias("distance"), F.lit(1.0).alias("score"), none.alias("block_id"), none.alias("heading_path"), V.clean(F.col("text")).alias("passage"))
        passages = passages.unionByName(found.join(given.where(F.col("score") >= config.evidence_min_score), "answer_id").select(*columns))
    judged = judge.judge(passages)
    return V.answers(answers, V.per_claim(found, judged, config), config)


class Engine:
    """One vault folder with its index.

    The embedder and the judge are those given, or those that the settings choose: remote ones need an API key
    (by default that of FACTLOOM_API_KEY) and a transport, post for embeddings and ask for judgements.
    """

    def __init__(self, spark: SparkSession, vault: str, index_dir: str | None = None, embedder: Embedder | None = None, judge: Judge | None = None, config: EngineConfig = EngineConfig(), api_key: str | None = None, post=None, ask=None):
        self.spark, self.vault, self.config = spark, vault, config
        api_key = api_key or os.environ.get("FACTLOOM_API_KEY")
        self.embedder = embedder or choose_embedder(config.embedding, api_key, post)
        self.judge = judge or choose_judge(config.verifier, api_key, ask, config.verify_timeout_ms)
        home = index_dir or os.path.join(vault, ".factloom")
        self.index = ChunkIndex(spark, os.path.join(home, "index"))
        self.editor = NoteEditor(vault, os.path.join(home, "snapshots"), lambda path: self._reindexed(path))

    def ping(self) -> dict[str, str]:
        return {"message": "pong", "server": "factloom", "version": VERSION}

    def index_all(self, force: bool = False) -> dict[str, int]:
        """Bring the index up to date; binary notes are left out, and notes that cannot be read stay as they were."""
        raw = kept(read_listed(self.spark, self.vault))
        return self.index.update(text_notes(raw), self.embedder, force or self.config.reindex, unreadable(raw))

    def _chunks(self) -> DataFrame:
        """The chunks of the index, after a first pass if there has been none."""
        if self.index.chunks() is None:
            self.index_all()
        return self.index.chunks()

    def _reindexed(self, path: str) -> int:
        """Bring one note up to date; returns its number of chunks."""
        if self.index.manifest() is None:
            self.index_all()
        else:
            note = text_notes(read_listed(self.spark, self.vault, [path]))
            self.index.merge(note, self.spark.createDataFrame([], "path string"), self.embedder)
        return self.index.chunks().where(F.col("path") == path).count()

    def _answers(self, text: str | DataFrame) -> DataFrame:
        if isinstance(text, DataFrame):
            return text
        if not 1 <= len(text) <= LIMITS["claim"]:
            raise ValueError("a claim has 1 to 8000 characters")
        return self.spark.createDataFrame([(0, text)], "answer_id bigint, text string")

    def search(self, query: str | DataFrame, limit: int | None = None) -> DataFrame:
        """Cited chunks for a text, or for queries (query_id, text)."""
        limit = self.config.knn if limit is None else limit
        if not 1 <= limit <= LIMITS["results"]:
            raise ValueError("limit is 1 to 50")
        if isinstance(query, str):
            if not 1 <= len(query) <= LIMITS["query"]:
                raise ValueError("a query has 1 to 1000 characters")
            query = self.spark.createDataFrame([(0, query)], "query_id bigint, text string")
        chunks = self._chunks()
        return S.citations(S.hydrate(S.search(chunks, self.embedder.embed(query), limit), chunks))

    def verify(self, text: str | DataFrame, sources: DataFrame | None = None) -> DataFrame:
        """Results for a text, or for answers (answer_id, text); sources (answer_id, path, anchor, text) take the place of the index."""
        if sources is not None:
            many = sources.groupBy("answer_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"))
            if not many.where((F.col("n") > LIMITS["sources"]) | (F.col("longest") > LIMITS["source_text"])).isEmpty():
                raise ValueError("an answer has at most 50 sources of at most 50000 characters")
        return verify(self._answers(text), self._chunks(), self.embedder, self.judge, self.config, sources)

    def cite(self, text: str | DataFrame) -> DataFrame:
        answers = self._answers(text)
        return answers.withColumnRenamed("text", "statement").join(V.cite(self.verify(answers)), "answer_id")

    def safe_edit(self, path: str, old: str, new: str, confirm: str | None = None):
        if len(path) > LIMITS["path"] or not 1 <= len(old) <= LIMITS["edit"] or len(new) > LIMITS["edit"]:
            raise ValueError("path, old or new text is too long, or old is empty")
        return self.editor.edit(path, old, new, confirm)

    def restore(self, path: str, snapshot: str):
        return self.editor.restore(path, snapshot)
