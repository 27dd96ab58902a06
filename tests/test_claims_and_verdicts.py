import time

import pytest
from pyspark.sql import functions as F

from factloom.engine import verify
from factloom.operators import claims, judge, verdict
from factloom.operators.chunking import chunk_notes
from factloom.operators.embedding import FixedEmbedder
from factloom.operators.index import with_ids


class WordJudge:
    """A deterministic judge: a shared name supports, a delay speaks against an opening."""

    id = "words"

    def judge(self, pairs):
        claim, passage = F.lower("claim"), F.lower("passage")
        against = claim.contains("opened") & passage.contains("delayed")
        known = claim.contains("meridian") & passage.contains("meridian")
        return pairs.withColumns({"label": F.when(against, "contradicted").when(known, "supported").otherwise("neutral"), "confidence": F.when(against, 0.95).when(known, 0.9).otherwise(0.8)})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("We built ferries. The dock is steel. Who knows? ", ["We built ferries.", "The dock is steel."]),
        ("Ferries", ["Ferries"]),
        ("We use cranes for loading and pilots for docking.", ["We use cranes for loading", "We use pilots for docking."]),
        ("The north pier is in May and the south pier is in June.", ["The north pier is in May", "the south pier is in June."]),
        ("Tabs and spaces.", ["Tabs and spaces."]),
        ("Who knows?", ["Who knows?"]),
        ("  ", []),
        (None, []),
    ],
)
def test_decompose(spark, text, want):
    rows = claims.decompose(spark.createDataFrame([(1, text)], "answer_id bigint, text string")).orderBy("claim_id").collect()
    assert [r["claim"] for r in rows] == want and [r["claim_id"] for r in rows] == list(range(len(want)))
    assert len(claims.VERBS) == 101


def outcome(spark, text, passages, judge_=WordJudge(), given=False):
    notes = [(f"n{k}.md", f"# N\n\n{p}\n") for k, p in enumerate(passages)]
    chunks = FixedEmbedder().embed(with_ids(chunk_notes(spark.createDataFrame(notes, "path string, content string"))))
    sources = spark.createDataFrame([(1, "s.md", "#S", p) for p in passages], "answer_id bigint, path string, anchor string, text string") if given else None
    return verify(spark.createDataFrame([(1, text)], "answer_id bigint, text string"), chunks, FixedEmbedder(), judge_, sources=sources).first()


def test_supported(spark):
    for given in (False, True):
        r = outcome(spark, "We run Meridian ferries daily.", ["Meridian ferries cross every day. ^m7p2"], given=given)
        assert r["verdict"] == "grounded" and r["grounded"] and r["score"] == 0.9
        assert r["per_claim"][0]["evidence"][0]["anchor"] == ("#S" if given else "#^m7p2")


def test_contradicted(spark):
    r = outcome(spark, "The south pier opened in June.", ["The south pier is delayed to autumn and closed until then. ^q5r8"])
    assert r["verdict"] == "refused" and r["per_claim"][0]["verdict"] == "contradicted" and r["refused_claims"] == ["The south pier opened in June."]
    assert verdict.cite(outcome_frame(spark, r)).first()["note"] == verdict.CONTRADICTED


def outcome_frame(spark, row):
    return spark.createDataFrame([row])


def test_guard(spark):
    r = outcome(spark, "We run Meridian ferries at Halvorsen.", ["Meridian ferries cross every day."])
    assert r["verdict"] == "refused" and r["per_claim"][0]["verdict"] == "neutral"


@pytest.mark.parametrize(("claim", "passage", "holds"), [("We like MeridianLine", "meridian it is", True), ("It is 87.25% full", "87.2% full", False), ("It seats 40", "it seats 400", True), ("We use Tromso", "Bergen only", False), ("We use Ox.no", "nothing", True)])
def test_salient_terms(spark, claim, passage, holds):
    assert spark.range(1).select(verdict.holds_terms(verdict.salient_terms(F.lit(claim)), F.lit(passage))).first()[0] == holds


def judged(spark, rows):
    made = spark.createDataFrame([(1, 0, i, "p", "#a", None, None, "t", label, c) for i, label, c in rows], "answer_id bigint, claim_id int, passage_index int, path string, anchor string, block_id string, heading_path string, text string, label string, confidence double")
    return verdict.per_claim(spark.createDataFrame([(1, 0, "x"), (1, 1, "no passages")], "answer_id bigint, claim_id int, claim string"), made, guard=False)


def test_first_strong_judgement_wins(spark):
    got = {r["claim_id"]: r for r in judged(spark, [(0, "neutral", 0.9), (1, "supported", 0.6), (2, "contradicted", 0.99)]).collect()}
    assert (got[0]["verdict"], got[0]["score"]) == ("supported", 0.6) and got[1]["verdict"] == "neutral" and got[1]["evidence"] == []
    weak = judged(spark, [(0, "supported", 0.3)]).where("claim_id = 0").first()
    assert weak["verdict"] == "neutral" and weak["score"] == 0


def test_evidence_by_confidence(spark):
    r = judged(spark, [(0, "supported", 0.6), (1, "supported", 0.95), (2, "supported", 0.45), (3, "supported", 0.41), (4, "supported", 0.39)]).where("claim_id = 0").first()
    assert [e["score"] for e in r["evidence"]] == [0.95, 0.6, 0.45] and r["score"] == 0.6


def aggregate(spark, rows):
    none = F.array().cast("array<struct<path: string, anchor: string, block_id: string, heading: string, quote: string, score: double>>")
    per = spark.createDataFrame([(1, i, c, v, s) for i, (c, v, s) in enumerate(rows)], "answer_id bigint, claim_id int, claim string, verdict string, score double").withColumn("evidence", none)
    return verdict.answers(spark.createDataFrame([(1,)], "answer_id bigint"), per).first()


def test_answers(spark):
    r = aggregate(spark, [("a", "supported", 0.9), ("b", "contradicted", 0.0)])
    assert r["verdict"] == "refused" and r["refused_claims"] == ["b"] and r["summary"] == "1/2 claim(s) supported by your notes; 1 contradicted."
    assert aggregate(spark, [("a", "supported", 0.9)])["verdict"] == "grounded"
    assert aggregate(spark, [("a", "neutral", 0.0)])["refused_claims"] == ["a"]
    assert aggregate(spark, [("a", "supported", 0.6)])["verdict"] == "flagged"
    assert aggregate(spark, [])["summary"] == verdict.NO_CLAIMS


def test_parse_judgements():
    assert judge.parse_judgements('{"judgements": [{"passageIndex": 0, "label": "supported", "confidence": 0.95}, {"passageIndex": 1, "label": "neutral", "confidence": 0.8}]}', 2) == [("supported", 0.95), ("neutral", 0.8)]
    assert judge.parse_judgements('{"judgements": [{"passageIndex": 0, "label": "contradicted", "confidence": 1.5}, {"passageIndex": "1", "label": "supported"}, {"passageIndex": 0, "label": "odd"}]}', 2) == [("contradicted", 1.0), ("neutral", 0.0)]
    assert judge.parse_judgements("{}", 0) == []
    with pytest.raises(ValueError):
        judge.parse_judgements("no json", 1)
    assert judge.label_places({0: "CONTRADICTION", 1: "entailment", 2: "NEUTRAL"}) == (1, 0, 2)
    with pytest.raises(ValueError):
        judge.label_places({0: "yes", 1: "no"})


def slow(claim, passages):
    time.sleep(2)
    return "{}"


def broken(claim, passages):
    raise RuntimeError("down")


def fine(claim, passages):
    return '{"judgements": [{"passageIndex": 0, "label": "supported", "confidence": 0.9}]}'


def test_remote_judge(spark):
    passage = ["Meridian ferries cross every day."]
    assert outcome(spark, "We run Meridian ferries.", passage, judge.RemoteJudge("r", fine))["verdict"] == "grounded"
    assert outcome(spark, "We run Meridian ferries.", passage, judge.RemoteJudge("r", broken))["per_claim"][0]["verdict"] == "neutral"
    assert outcome(spark, "We run Meridian ferries.", passage, judge.RemoteJudge("r", slow, timeout_ms=50))["per_claim"][0]["verdict"] == "neutral"
    assert isinstance(judge.choose_judge("auto"), judge.LexicalJudge) and isinstance(judge.choose_judge("auto", "key", fine), judge.RemoteJudge) and isinstance(judge.choose_judge("local", "key", fine), judge.LexicalJudge)


def load_model():
    return lambda premise, hypothesis: [3.0, 1.0, 0.0] if "Meridian" in premise else [0.0, 2.0, 0.0]


def test_model_judge(spark):
    r = outcome(spark, "We run Meridian ferries.", ["Meridian ferries cross every day."], judge.ModelJudge("m", load_model))
    assert r["verdict"] == "grounded" and 0.8 < r["score"] < 0.9


def test_lexical_judge(spark):
    rows = [("The hull is steel", "The outer hull is steel today"), ("The hull is steel", "The hull is not steel"), ("The crew counts 12", "The crew counts 15"), ("Gulls cry loudly", "Ferries need a dock")]
    got = judge.LexicalJudge().judge(spark.createDataFrame(rows, "claim string, passage string")).select("label").collect()
    assert [r[0] for r in got] == ["supported", "contradicted", "contradicted", "neutral"]
