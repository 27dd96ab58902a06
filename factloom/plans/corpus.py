"""The corpus of the queries: notes made from documents, with the same SQL in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.chunking import chunk_notes
from factloom.operators.embedding import KeywordEmbedder

#: Notes with frontmatter, headings, blank-line blocks, a block id, a fence, a table and links.
CONTENT = (
    "'---'||chr(10)||'tags: ['||lang||']'||chr(10)||'---'||chr(10)||'# '||source||chr(10)||chr(10)||'## '||lang||chr(10)||chr(10)"
    "||replace(text,chr(10),chr(10)||chr(10))||' ^d'||doc_id||chr(10)||chr(10)"
    "||'```'||chr(10)||'# code'||chr(10)||chr(10)||'end'||chr(10)||'```'||chr(10)||chr(10)"
    "||'| Key | Value |'||chr(10)||'| --- | --- |'||chr(10)||'| id | '||doc_id||' |'||chr(10)||chr(10)"
    "||'### Links'||chr(10)||chr(10)||'See [[Notes/'||lang||'#Top|the '||source||' notes]] and [[d'||(doc_id % 10)||']].'||chr(10)"
)
PATH = "source||'/'||lang||'/d'||doc_id||'.md'"

#: Keywords that do occur in the corpus.
EMBEDDER = KeywordEmbedder(("the", "er", "on", "ti", "ch", "le", "de", "ou"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes_of(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("doc_id", f"{PATH} AS path", f"{CONTENT} AS content")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes_of(table(spark, sf_dir, "documents"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of the corpus; chunk_id = doc_id * 100000 + ordinal."""
    made = chunk_notes(notes(spark, sf_dir).select("path", "content"))
    doc = F.regexp_extract("path", r"/d([0-9]+)\.md\z", 1).cast("bigint")
    return made.withColumn("doc_id", doc).withColumn("chunk_id", F.col("doc_id") * 100_000 + F.col("ordinal"))
