"""Queries over plug-ins with made-up models and services, over choices, and over what is measured of judgements."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.config import EngineConfig
from factloom.functions.text import round3
from factloom.operators import embedding, evaluation, judge
from factloom.plans.corpus import table
from factloom.plans.registry import query


def _vector(text: str) -> list[float]:
    return [len(text) + 1.0, float(text.count("e")), float(text.count(" ")), 1.0]


_UNIT = ", ".join(f"floor(v[{k + 1}] / sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3] + 1) * 1000 + 0.5) / 1000 AS x{k}" for k in range(4))
_VECTORS = "SELECT doc_id, " + _UNIT + " FROM (SELECT doc_id, [length(t) + 1.0::DOUBLE, (length(t) - length(replace(t, 'e', '')))::DOUBLE, (length(t) - length(replace(t, ' ', '')))::DOUBLE, 1.0] AS v FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"


def _embedded(spark: SparkSession, d: str, embedder: embedding.Embedder) -> DataFrame:
    made = embedder.embed(table(spark, d, "documents").select("doc_id", "text"))
    return made.select("doc_id", *[round3(F.col("embedding")[k]).alias(f"x{k}") for k in range(4)])


@query(_VECTORS)
def e2_model_embed(spark, d):
    """A model loaded once a worker; the made-up one counts characters."""
    return _embedded(spark, d, embedding.ModelEmbedder("counts", 4, lambda: lambda texts: [_vector(t) for t in texts]))


@query(_VECTORS)
def e3_remote_embed(spark, d):
    """A made-up service that gives the same vectors in reverse order, each with its index."""

    def post(request: dict) -> tuple[int, dict]:
        return 200, {"data": [{"index": k, "embedding": _vector(t)} for k, t in reversed(list(enumerate(request["input"])))]}

    return _embedded(spark, d, embedding.ModelEmbedder("remote", 4, embedding.remote_loader(post, "counts"), batch=128))


@query("SELECT * FROM (VALUES ('local', false, 'keywords'), ('local', true, 'keywords'), ('remote', false, 'error'), ('remote', true, 'remote')) t(name, has_key, chosen)")
def e7_choose_embedder(spark, d):
    def chosen(name: str, key: str | None) -> str:
        try:
            return embedding.choose_embedder(name, key, lambda request: (200, {})).id.split(":")[0]
        except ValueError:
            return "error"

    return spark.createDataFrame([(n, k is not None, chosen(n, k)) for n in ("local", "remote") for k in (None, "key")], "name string, has_key boolean, chosen string")


@query("SELECT * FROM (VALUES ('auto', false, 'lexical'), ('auto', true, 'remote'), ('local', false, 'lexical'), ('local', true, 'lexical')) t(name, has_key, chosen)")
def v21_choose_judge(spark, d):
    rows = [(n, k is not None, judge.choose_judge(n, k, lambda claim, passages: "{}").id) for n in ("auto", "local") for k in (None, "key")]
    return spark.createDataFrame(rows, "name string, has_key boolean, chosen string")


@query("SELECT 0.9 AS grounded, 5 AS knn, 'remote' AS embedding, 'local' AS verifier, true AS reindex, 0.5 AS refuse, 0.5 AS decisive")
def s9_settings(spark, d):
    """Flags over environment over defaults; unknown and ill-formed flags do not count."""
    c = EngineConfig.from_args(["--grounded-threshold", "0.9", "--knn=5", "--reindex", "--refuse", "much", "--decisive=0.1", "--none=1"], {"FACTLOOM_EMBEDDING": "remote", "FACTLOOM_VERIFIER": "local"})
    return spark.createDataFrame([(c.grounded, c.knn, c.embedding, c.verifier, c.reindex, c.refuse, c.decisive)], "grounded double, knn int, embedding string, verifier string, reindex boolean, refuse double, decisive double")


# ---- judges that ask a model or a service: pairs of a conversation's turn and those up to four turns after it

_PAIRS = """
WITH pairs AS (SELECT a.conv_id AS answer_id, a.turn AS claim_id, a.text AS claim, b.text AS passage, b.turn - a.turn - 1 AS passage_index FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn + 1 AND a.turn + 4)
"""
_LENGTHS = "CASE WHEN length(passage) > length(claim) THEN 'supported' WHEN length(passage) < length(claim) THEN 'contradicted' ELSE 'neutral' END"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "conversations")
    first = said.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("claim_id"), F.col("text").alias("claim"))
    later = first.withColumn("passage_index", F.explode(F.sequence(F.lit(0), F.lit(3))))
    passages = said.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("__turn"), F.col("text").alias("passage"))
    at = F.col("claim_id") + F.col("passage_index") + 1
    return later.withColumn("__turn", at).join(passages, ["answer_id", "__turn"]).drop("__turn")


def _label(claim: str, passage: str) -> str:
    return "supported" if len(passage) > len(claim) else "contradicted" if len(passage) < len(claim) else "neutral"


@query(_PAIRS + f"SELECT answer_id, claim_id, passage_index, {_LENGTHS} AS label, floor(exp(2) / (exp(2) + 2) * 1000 + 0.5) / 1000 AS confidence FROM pairs")
def v7_model_judge(spark, d):
    """A model whose labels stand in an order of their own; the made-up one compares lengths."""
    places = ("contradicted", "supported", "neutral")
    model = judge.ModelJudge("lengths", lambda: lambda passage, claim: [2.0 if x == _label(claim, passage) else 0.0 for x in places], ("CONTRADICTION", "ENTAILMENT", "NEUTRAL"))
    return model.judge(_pairs(spark, d)).select("answer_id", "claim_id", "passage_index", "label", round3(F.col("confidence")).alias("confidence"))


_REMOTE = _PAIRS + f"SELECT answer_id, claim_id, passage_index, CASE WHEN {{0}} THEN 'neutral' ELSE {_LENGTHS} END AS label, CASE WHEN {{0}} THEN 0.0 ELSE least(1.0, (length(passage) % 13) / 10) END AS confidence FROM pairs"


def _asked(pairs: DataFrame, ask, timeout_ms: int = 30_000) -> DataFrame:
    return judge.RemoteJudge("lengths", ask, timeout_ms).judge(pairs).select("answer_id", "claim_id", "passage_index", "label", "confidence")


def _reply(claim: str, passages: list[str]) -> str:
    items = [{"passageIndex": k, "label": _label(claim, p), "confidence": len(p) % 13 / 10} for k, p in enumerate(passages)]
    return json.dumps({"judgements": [*items[::-1], {"passageIndex": 99, "label": "supported", "confidence": 1}, {"passageIndex": 0, "label": "maybe"}]})


@query(_REMOTE.format("length(claim) % 5 = 0"))
def v8_remote_judge(spark, d):
    """A service asked once a claim; where it fails, the claim's passages are neutral with 0."""

    def ask(claim: str, passages: list[str]) -> str:
        if len(claim) % 5 == 0:
            raise ConnectionError("no answer")
        return _reply(claim, passages)

    return _asked(_pairs(spark, d), ask)


@query(_REMOTE.format("answer_id % 29 = 0 AND claim_id = 0"))
def v10_timeout(spark, d):
    """A service that answers too late for the first turn of some conversations, whatever its text; the first character of a claim says whether it does."""

    def ask(claim: str, passages: list[str]) -> str:
        if claim[0] == "1":
            time.sleep(1.5)
        return _reply(claim[1:], passages)

    late = F.when((F.col("answer_id") % 29 == 0) & (F.col("claim_id") == 0), "1").otherwise("0")
    return _asked(_pairs(spark, d).withColumn("claim", F.concat(late, "claim")), ask, 1000)


# ---- measures


@query(_PAIRS + f", decisive AS (SELECT answer_id, claim_id, label FROM (SELECT *, {_LENGTHS} AS label, (length(passage) % 13) / 10 AS confidence FROM pairs) WHERE label <> 'neutral' AND confidence >= 0.5 QUALIFY row_number() OVER (PARTITION BY answer_id, claim_id ORDER BY passage_index) = 1) SELECT answer_id, claim_id, coalesce(label, 'neutral') AS predicted FROM (SELECT DISTINCT answer_id, claim_id FROM pairs) LEFT JOIN decisive USING (answer_id, claim_id)")
def m1_predicted(spark, d):
    long, short = F.length("passage") > F.length("claim"), F.length("passage") < F.length("claim")
    judged = _pairs(spark, d).withColumns({"label": F.when(long, "supported").when(short, "contradicted").otherwise("neutral"), "confidence": F.length("passage") % 13 / 10})
    return evaluation.predicted(judged, ["answer_id", "claim_id"])
