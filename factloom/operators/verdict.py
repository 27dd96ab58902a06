"""Judged passages to verdicts of claims and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.config import EngineConfig
from factloom.functions.text import round3, trim

EVIDENCE_MIN_CONFIDENCE = 0.4
EVIDENCE_TOP = 3

# Summary and notes as clients see them; the parts of summary() and "Supported by ..." in cite() are such values too.
NO_CLAIMS = "No verifiable claims were found in the text."
CONTRADICTED = "Your notes contradict this — do not state it as fact."
UNSUPPORTED = "No supporting notes found — do not state this as fact."


def gate(scored: DataFrame, least: float, ties: str = "chunk_id") -> DataFrame:
    """Passages relevant enough, numbered from 0 within their claim; (answer_id, claim_id, chunk_id, distance, score, ...)."""
    order = Window.partitionBy("answer_id", "claim_id").orderBy("distance", ties)
    return scored.where(F.col("score") >= least).withColumn("passage_index", F.row_number().over(order) - 1)


def clean(text: Column) -> Column:
    """A passage as a judge sees it: without carriage returns and a block id at its end."""
    return trim(F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("")), r"\s*\^[A-Za-z0-9-]+\s*\z", ""))


def salient_terms(claim: Column) -> Column:
    """Numbers, names and codes of a claim, which a passage must hold."""
    tokens = F.transform(F.regexp_extract_all(claim, F.lit(r"[A-Za-z0-9][A-Za-z0-9.$:%+/-]*"), F.lit(0)), lambda t: F.regexp_replace(t, r"[.$:%+/-]+\z", ""))
    kept = F.transform(tokens, lambda t, i: F.when((t != "") & (t.rlike("[0-9]") | t.rlike("[A-Z][a-z]*[A-Z]") | t.rlike(r"\A[A-Z]{2,}\z") | ((i > 0) & t.rlike(r"\A[A-Z][a-z]{2,}\z"))), t))
    return F.array_compact(kept)


def holds_terms(terms: Column, passage: Column) -> Column:
    """Whether every term stands in the passage, or, from five letters on, holds a word of the passage of at least four."""
    low = F.lower(passage)
    words = F.regexp_extract_all(low, F.lit(r"[a-z0-9]{4,}"), F.lit(0))
    return F.forall(terms, lambda t: F.contains(low, F.lower(t)) | ((F.length(t) >= 5) & F.exists(words, lambda w: F.contains(F.lower(t), w))))


def per_claim(claims: DataFrame, judged: DataFrame, config: EngineConfig = EngineConfig(), guard: bool = True) -> DataFrame:
    """(answer_id, claim_id, claim, verdict, score, evidence) for every claim, with or without passages.

    judged: (answer_id, claim_id, passage_index, path, anchor, block_id, heading_path, text, label, confidence).
    The decisive judgement is the first one, in order of relevance, that is not neutral and confident enough.
    """
    strong = (F.col("label") != "neutral") & (F.col("confidence") >= config.decisive)
    one = F.struct("passage_index", "label", "confidence", "text")
    # claims have a handful of passages each, so the lists are small
    passage = F.struct("passage_index", "label", "confidence", "path", "anchor", "block_id", F.col("heading_path").alias("heading"), F.replace("text", F.lit("\r"), F.lit("")).alias("quote"))
    # what cannot be evidence of any verdict does not travel
    may = (F.col("label") != "neutral") & (F.col("confidence") >= EVIDENCE_MIN_CONFIDENCE)
    found = judged.groupBy("answer_id", "claim_id").agg(F.min(F.when(strong, one)).alias("decisive"), F.min(F.struct("passage_index", "confidence")).alias("first"), F.array_sort(F.collect_list(F.when(may, passage))).alias("passages"))
    out = claims.join(found, ["answer_id", "claim_id"], "left")
    label = F.coalesce(F.col("decisive.label"), F.lit("neutral"))
    confidence = F.coalesce(F.col("decisive.confidence"), F.col("first.confidence"), F.lit(0.0))
    if guard:
        fails = (label == "supported") & ~holds_terms(salient_terms(F.col("claim")), clean(F.col("decisive.text")))
        label, confidence = F.when(fails, "neutral").otherwise(label), F.when(fails, 0.0).otherwise(confidence)
    out = out.withColumns({"verdict": label, "__confidence": confidence})
    same = F.filter("passages", lambda p: (p["label"] == F.col("verdict")) & (p["confidence"] >= EVIDENCE_MIN_CONFIDENCE))
    ranked = F.transform(F.array_sort(F.transform(same, lambda p: F.struct((-p["confidence"]).alias("c"), p["passage_index"].alias("i"), p.alias("p")))), lambda x: x["p"])
    shown = F.transform(F.slice(ranked, 1, EVIDENCE_TOP), lambda p: F.struct(p["path"].alias("path"), p["anchor"].alias("anchor"), p["block_id"].alias("block_id"), p["heading"].alias("heading"), p["quote"].alias("quote"), round3(p["confidence"]).alias("score")))
    none = F.array().cast("array<struct<path: string, anchor: string, block_id: string, heading: string, quote: string, score: double>>")
    evidence = F.when((F.col("verdict") == "neutral") | F.col("passages").isNull(), none).otherwise(shown)
    return out.select("answer_id", "claim_id", "claim", "verdict", F.when(F.col("verdict") == "supported", F.col("__confidence")).otherwise(F.lit(0.0)).alias("score"), evidence.alias("evidence"))


def answers(ids: DataFrame, claims: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(answer_id, grounded, score, verdict, summary, n_claims, per_claim, refused_claims) for every id, with or without claims."""
    row = F.struct("claim_id", "claim", "verdict", "score", "evidence")
    rows = ids.select("answer_id").distinct().join(claims.groupBy("answer_id").agg(F.array_sort(F.collect_list(row)).alias("per_claim")), "answer_id", "left")
    own = F.coalesce(F.col("per_claim"), F.array().cast(claims.select(F.array(row)).schema[0].dataType))
    rows = rows.withColumn("per_claim", own)
    n = F.size("per_claim")
    # left to right in claim order, so that the mean does not depend on the partitioning
    mean = F.aggregate("per_claim", F.lit(0.0), lambda s, c: s + c["score"]) / n
    contradiction = F.exists("per_claim", lambda c: c["verdict"] == "contradicted")
    grounded = F.forall("per_claim", lambda c: (c["verdict"] == "supported") & (c["score"] >= config.grounded))
    verdict = F.when(n == 0, "refused").when(grounded & ~contradiction, "grounded").when(contradiction | (mean < config.refuse), "refused").otherwise("flagged")
    refused = F.transform(F.filter("per_claim", lambda c: (c["verdict"] == "contradicted") | (c["score"] < config.refuse)), lambda c: c["claim"])
    out = rows.withColumns({"verdict": verdict, "score": F.when(n == 0, 0.0).otherwise(round3(mean)), "summary": summary(F.col("per_claim")), "n_claims": n, "refused_claims": refused})
    return out.select("answer_id", (F.col("verdict") == "grounded").alias("grounded"), "score", "verdict", "summary", "n_claims", "per_claim", "refused_claims")


def summary(claims: Column) -> Column:
    count = lambda v: F.size(F.filter(claims, lambda c: c["verdict"] == v))
    part = lambda v, name: F.when(count(v) > 0, F.concat(count(v).cast("string"), F.lit(f" {name}")))
    first = F.concat(count("supported").cast("string"), F.lit("/"), F.size(claims).cast("string"), F.lit(" claim(s) supported by your notes"))
    return F.when(F.size(claims) == 0, NO_CLAIMS).otherwise(F.concat(F.concat_ws("; ", first, part("contradicted", "contradicted"), part("neutral", "unsupported")), F.lit(".")))


def cite(results: DataFrame) -> DataFrame:
    """(answer_id, cited, citations, note) of answers(): the evidence of the supported claims."""
    supported = F.flatten(F.transform(F.filter("per_claim", lambda c: c["verdict"] == "supported"), lambda c: c["evidence"]))
    shown = F.transform(supported, lambda e: F.struct(F.concat(e["path"], e["anchor"]).alias("citation"), e["path"].alias("path"), e["anchor"].alias("anchor"), e["quote"].alias("quote"), e["score"].alias("score")))
    cited = (F.size("citations") > 0) & (F.col("verdict") != "refused")
    contradicted = F.exists("per_claim", lambda c: c["verdict"] == "contradicted")
    note = F.when(cited, F.concat(F.lit("Supported by "), F.size("citations").cast("string"), F.lit(" note passage(s)."))).when(contradicted, CONTRADICTED).otherwise(UNSUPPORTED)
    return results.withColumn("citations", shown).select("answer_id", cited.alias("cited"), "citations", note.alias("note"))
