"""A corpus pipeline: five operators of factloom.llm, one after the other over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns
of documents:

* quality_rules: documents that the rule table rejects go;
* near_dedup: of each group of near-duplicates the document with the smallest id stays;
* decontaminate: passages of the benchmark are cut out of the texts (n_chars follows);
  a document goes only if no word of it stays;
* mix: all documents, in the order of the Pfair schedule: file by file and row by row;
* tokens: token files in that order (or by doc_id, where docs does not come from files),
  read back: doc_id, start, n_tokens, ids_crc32.

Defined cases, for every stage: an empty table gives an empty result; other columns stay as
they are, whatever their names; very long texts are taken whole. quality_rules drops null,
empty and short texts, and judges repeated rows alike. near_dedup keeps rows without a
doc_id and texts without words, and every row of the smallest doc_id of a group: rows that
share a doc_id are repeats of one document. decontaminate keeps texts without words. mix
takes a null source as the source '', a null doc_id as '', and breaks ties by the digest of
the doc_id. tokens gives a null text its end id alone and writes repeated rows each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, mixing, near_dedup, quality_rules, token_files
from factloom.llm._shared import shared_dir, table

TOKENIZER = "word_bpe_49k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(docs.select(F.struct(*docs.columns).alias("row"), "text"))
    return judged.where("kept").select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("doc_id", "source", F.struct(*docs.columns).alias("row"))
    return mixing.in_order(mixing.mix(rows)).select("row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    order: tuple[str, ...] = ("doc_id",)
    if docs.inputFiles():
        # the mix is the order of files and rows; part files are numbered by partition
        part = F.regexp_extract("_metadata.file_name", r"part-([0-9]+)", 1).try_cast("bigint")
        docs, order = docs.select("doc_id", "text", part.alias("__part"), F.col("_metadata.row_index").alias("__row")), ("__part", "__row")
    shards = token_files.write_token_files(docs, shared_dir(spark), public_tokenizers.path(TOKENIZER), order)
    return token_files.read_digests(spark, shards)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("tokens", token_stage),
]

#: SQL can express neither the tokenizer nor the Java pattern of the rules; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
