"""The query catalogue: one query an operator over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom import engine
from factloom.functions.tables import kept
from factloom.functions.text import round3
from factloom.operators import chunking, claims, embedding, evaluation, index, judge, revisions, search, verdict
from factloom.plans import judging, oracle, storage  # noqa: F401  two of them register queries of their own
from factloom.plans.corpus import EMBEDDER, chunks, notes, table
from factloom.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401  the catalogue is asked for both tables
from factloom.sources.vault import decode, is_binary
from factloom.streaming import changes


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


# ---- sources and the incremental diff


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def i1_content_hash(spark, d):
    return _docs(spark, d).select("doc_id", index.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, doc_id % 5 = 0 AS is_binary, length(text) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS n_chars FROM documents")
def s3_binary_sniff(spark, d):
    content = F.concat(F.encode("text", "UTF-8"), F.when(F.col("doc_id") % 5 == 0, F.lit(bytes([0]))).otherwise(F.lit(b"")))
    return _docs(spark, d).select("doc_id", is_binary(content).alias("is_binary"), F.length(decode(content)).cast("long").alias("n_chars"))


def _two_passes(spark, d):
    docs = _docs(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "text")
    now = docs.where("doc_id % 7 <> 0").select("path", index.content_hash(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))
    return now, docs.where("doc_id % 13 <> 0").select("path", index.content_hash(F.col("text")).alias("content_hash"))


@query(oracle.CHANGES + "SELECT path, op, content_hash FROM changes")
def i3_change_classify(spark, d):
    return index.classify(*_two_passes(spark, d))


@query(oracle.CHANGES + "SELECT path FROM changes WHERE op = 'prune'")
def i4_prune(spark, d):
    return index.pruned(*_two_passes(spark, d))


@query(oracle.CHANGES + "SELECT count(*) FILTER (op IN ('insert', 'update')) AS notes, count(*) FILTER (op = 'unchanged') AS skipped, count(*) FILTER (op = 'prune') AS pruned FROM changes")
def i8_pass_stats(spark, d):
    return index.pass_stats(index.classify(*_two_passes(spark, d)))


# ---- the chunker


def _lines(spark, d):
    return chunking.structure(notes(spark, d))


@query(oracle.CHUNKER + "SELECT path, i, pos AS char_start, length(line) AS n_chars FROM lines")
def c3_line_offsets(spark, d):
    return _lines(spark, d).select("path", "i", F.col("at").alias("char_start"), F.length("line").alias("n_chars"))


@query(oracle.CHUNKER + "SELECT path, i, marker, in_fence FROM g")
def c4_fence_state(spark, d):
    return _lines(spark, d).select("path", "i", "marker", "in_fence")


@query(oracle.CHUNKER + "SELECT path, i, level FROM g WHERE level > 0")
def c5_headings(spark, d):
    return _lines(spark, d).where("level > 0").select("path", "i", "level")


@query(oracle.CHUNKER + "SELECT path, i, array_to_string(heads, ' > ') AS heading_path FROM b")
def c6_breadcrumb(spark, d):
    return _lines(spark, d).select("path", "i", F.array_join("headings", " > ").alias("heading_path"))


@query(oracle.CHUNKER + "SELECT path, len(ls) AS n_lines, ps[1] AS char_start, array_to_string(ls, chr(10)) AS text FROM blocks")
def c7_blocks(spark, d):
    found = chunking.blocks(notes(spark, d))
    return found.select("path", F.size("lines").cast("long").alias("n_lines"), F.expr("lines[0].at").alias("char_start"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


@query("WITH corpus AS (SELECT " + oracle.CORPUS + " FROM documents) SELECT path, regexp_extract(content, '^---\\r?\\n[\\s\\S]*?\\r?\\n---\\r?\\n?') AS front FROM corpus")
def c1_frontmatter(spark, d):
    return notes(spark, d).select("path", chunking.frontmatter(F.col("content")).alias("front"))


@query(oracle.CHUNKER + "SELECT path, char_start, text FROM pieces_all WHERE kind = 'row'")
def c10_table_rows(spark, d):
    found = chunking.blocks(notes(spark, d)).where(chunking.is_table(F.col("lines")))
    return found.select("path", F.explode(chunking.block_pieces(F.col("lines"))).alias("p")).select("path", F.col("p.at").alias("char_start"), "p.text")


@query(oracle.SPLIT + "SELECT doc_id, piece_at AS char_start, piece AS text FROM pieces WHERE regexp_matches(piece, '\\S')")
def c11_oversize_split(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(chunking.split_oversize(F.col("text"))).alias("p")).select("doc_id", F.col("p.at").alias("char_start"), "p.text")


@query(oracle.CHUNKER + "SELECT path, ordinal, block_id FROM chunks WHERE block_id IS NOT NULL")
def c12_block_ids(spark, d):
    return chunks(spark, d).where("block_id IS NOT NULL").select("path", "ordinal", "block_id")


@query(oracle.CHUNKER + "SELECT path, ordinal, anchor, heading_path, char_start, char_start + length(text) AS char_end, text FROM chunks")
def c13_anchors(spark, d):
    return chunks(spark, d).select("path", "ordinal", "anchor", "heading_path", "char_start", "char_end", "text")


@query(oracle.CHUNKER + "SELECT path, ordinal, target_note, target_anchor, alias FROM links")
def c14_wikilinks(spark, d):
    return chunking.link_table(chunks(spark, d))


@query(oracle.CHUNKER + "SELECT target_note, count(*) AS n FROM links GROUP BY target_note")
def c14_link_indegree(spark, d):
    return chunking.link_table(chunks(spark, d)).groupBy("target_note").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS INTEGER) AS token_est FROM documents")
def c15_token_est(spark, d):
    return _docs(spark, d).select("doc_id", chunking.token_estimate(F.col("text")).alias("token_est"))


@query(oracle.CHUNKER + "SELECT count(*) AS n_chunks, 0 AS n_wrong FROM chunks")
def c16_offset_invariant(spark, d):
    both = chunks(spark, d).join(notes(spark, d).select("path", "content"), "path")
    wrong = F.expr("substring(content, char_start + 1, char_end - char_start) <> text")
    return both.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum(wrong.cast("int")), F.lit(0)).cast("int").alias("n_wrong"))


# ---- embeddings and search


@query("SELECT vec_id, " + ", ".join(f"floor(v[{k + 1}] / n * 1000 + 0.5) / 1000 AS x{k}" for k in range(4)) + " FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS v FROM embeddings))")
def e4_normalise(spark, d):
    v = embedding.normalise(F.transform("embedding", lambda x: x.cast("double") * 3))
    return table(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", *[round3(F.col("v")[k]).alias(f"x{k}") for k in range(4)])


@query(oracle.KEYWORDS + "SELECT doc_id, " + ", ".join(f"floor(e[{k + 1}] * 1000 + 0.5) / 1000 AS x{k}" for k in range(8)) + " FROM embedded")
def e5_keyword_embed(spark, d):
    made = EMBEDDER.embed(_docs(spark, d).select("doc_id", "text"))
    return made.select("doc_id", *[round3(F.col("embedding")[k]).alias(f"x{k}") for k in range(8)])


@query("SELECT DISTINCT len(embedding) AS dim, 1.0 AS x0 FROM embeddings")
def e6_fixed_embed(spark, d):
    made = embedding.FixedEmbedder((1.0, *[0.0] * 63)).embed(table(spark, d, "embeddings").select("vec_id"))
    return made.select(F.size("embedding").cast("long").alias("dim"), F.col("embedding")[0].alias("x0")).distinct()


def _base(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def _hits(spark, d, k=6):
    base = _base(spark, d)
    return search.search(base, base.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id"), k)


@query(oracle.HITS + "SELECT chunk_id, floor(distance * 1000 + 0.5) / 1000 AS distance FROM hits WHERE query_id = 0")
def q1_knn_single(spark, d):
    vector = table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]
    return search.nearest(_base(spark, d), vector, 6).select("chunk_id", round3(F.col("distance")).alias("distance"))


@query(oracle.HITS + "SELECT query_id, chunk_id, rank, floor(distance * 1000 + 0.5) / 1000 AS distance FROM hits")
def q1_knn_batch(spark, d):
    return _hits(spark, d).select("query_id", "chunk_id", "rank", round3(F.col("distance")).alias("distance"))


@query(oracle.HITS + "SELECT query_id, chunk_id, floor(greatest(0.0, least(1.0, 1 - distance * distance / 2)) * 1000 + 0.5) / 1000 AS score FROM hits")
def q3_score(spark, d):
    return _hits(spark, d).select("query_id", "chunk_id", round3(search.relevance(F.col("distance"))).alias("score"))


@query(oracle.HITS + "SELECT query_id, rank, doc_id, source, n_chars FROM hits JOIN documents ON chunk_id = doc_id")
def q4_hydrate(spark, d):
    docs = _docs(spark, d).select(F.col("doc_id").alias("chunk_id"), "source", "n_chars")
    return search.hydrate(_hits(spark, d), docs).select("query_id", "rank", F.col("chunk_id").alias("doc_id"), "source", "n_chars")


@query(oracle.SEARCH + "SELECT query_id, rank, path || anchor AS citation, path, anchor, floor(score * 1000 + 0.5) / 1000 AS score, replace(text, chr(13), '') AS quote FROM found")
def q6_search_projection(spark, d):
    base = kept(EMBEDDER.embed(chunks(spark, d)))
    asked = EMBEDDER.embed(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    return search.citations(search.hydrate(search.search(base, asked, 3), base))


# ---- claims


def _turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "text")


@query(oracle.CLAIMS + "SELECT conv_id, turn, i, s AS sentence FROM sentences")
def x2_sentences(spark, d):
    return _turns(spark, d).select("conv_id", "turn", F.posexplode(claims.sentences(F.col("text"))).alias("i", "sentence"))


@query(oracle.CLAIMS + "SELECT conv_id, turn, i, length(s) >= 3 AND NOT ends_with(s, '?') AND len(regexp_split_to_array(s, '\\s+')) >= 2 AS verifiable FROM sentences")
def x3_verifiable(spark, d):
    rows = x2_sentences(spark, d)
    return rows.select("conv_id", "turn", "i", claims.is_verifiable(F.col("sentence")).alias("verifiable"))


@query(oracle.CLAIMS + f"SELECT conv_id, turn, i, len(list_filter(regexp_extract_all(s, '[A-Za-z''-]+'), lambda w: list_contains({oracle.VERB_LIST}, lower(w)))) > 0 AS has_verb FROM sentences")
def x5_has_verb(spark, d):
    return x2_sentences(spark, d).select("conv_id", "turn", "i", claims.has_verb(F.col("sentence")).alias("has_verb"))


@query(oracle.CLAIMS + "SELECT conv_id, turn, i, array_to_string(conjuncts, ' & ') AS parts FROM split_sentences")
def x7_conjunctions(spark, d):
    return x2_sentences(spark, d).select("conv_id", "turn", "i", F.array_join(claims.conjuncts(F.col("sentence")), " & ").alias("parts"))


@query(oracle.CLAIMS + "SELECT conv_id, turn, claim_id, claim FROM claims")
def x1_decompose(spark, d):
    return _turns(spark, d).select("conv_id", "turn", F.posexplode(claims.claims(F.col("text"))).alias("claim_id", "claim"))


# ---- judgements and verdicts, over made-up judgements of the nearest vectors


def _gated(spark, d):
    scored = _hits(spark, d).select((F.col("query_id") % 700).alias("answer_id"), F.col("query_id").cast("int").alias("claim_id"), "chunk_id", "distance", search.relevance(F.col("distance")).alias("score"))
    return verdict.gate(scored, 0.35)


def _judged(spark, d):
    made = _gated(spark, d).withColumns({
        "label": F.expr("element_at(array('supported', 'neutral', 'contradicted', 'supported'), cast((chunk_id * 7 + claim_id div 100) % 4 AS int) + 1)"),
        "confidence": F.expr("((chunk_id * 37 + claim_id) % 101) / 100"),
        "path": F.concat(F.lit("v"), F.col("chunk_id").cast("string"), F.lit(".md")), "anchor": F.lit("#L0"), "block_id": F.lit(None).cast("string"), "heading_path": F.lit(None).cast("string"), "text": F.concat(F.lit("Vector "), F.col("chunk_id").cast("string")),
    })
    asked = table(spark, d, "embeddings").where("vec_id % 100 = 0").select((F.col("vec_id") % 700).alias("answer_id"), F.col("vec_id").cast("int").alias("claim_id"), F.concat(F.lit("claim "), F.col("vec_id").cast("string")).alias("claim"))
    return asked, made


def _per_claim(spark, d):
    return verdict.per_claim(*_judged(spark, d), guard=False)


def _answers(spark, d):
    asked, _ = _judged(spark, d)
    without = table(spark, d, "embeddings").where("vec_id < 3").select((F.col("vec_id") + 100_000).alias("answer_id"))
    return verdict.answers(asked.select("answer_id").unionByName(without), _per_claim(spark, d))


@query(oracle.JUDGED + "SELECT answer_id, claim_id, chunk_id, passage_index FROM gated")
def v2_gate(spark, d):
    return _gated(spark, d).select("answer_id", "claim_id", "chunk_id", "passage_index")


@query(oracle.JUDGED + "SELECT answer_id, claim_id, max(passage_index) + 1 AS n_passages FROM gated GROUP BY ALL")
def v3_passage_rank(spark, d):
    return _gated(spark, d).groupBy("answer_id", "claim_id").agg((F.max("passage_index") + 1).alias("n_passages"))


@query("SELECT conv_id, turn, regexp_replace(regexp_replace(replace(text || ' ^b' || turn, chr(13), ''), '\\s*\\^[A-Za-z0-9-]+\\s*$', ''), '^\\s+|\\s+$', '', 'g') AS passage FROM conversations")
def v4_clean_text(spark, d):
    marked = F.concat("text", F.lit(" ^b"), F.col("turn").cast("string"))
    return _turns(spark, d).select("conv_id", "turn", verdict.clean(marked).alias("passage"))


@query("SELECT vec_id, CASE WHEN p0 >= greatest(p1, p2) THEN 'supported' WHEN p1 >= p2 THEN 'contradicted' ELSE 'neutral' END AS label, floor(greatest(p0, p1, p2) * 1000 + 0.5) / 1000 AS confidence FROM (SELECT vec_id, exp(a) / (exp(a) + exp(b) + exp(c)) AS p0, exp(c) / (exp(a) + exp(b) + exp(c)) AS p1, exp(b) / (exp(a) + exp(b) + exp(c)) AS p2 FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 5 AS a, CAST(embedding[2] AS DOUBLE) * 5 AS b, CAST(embedding[3] AS DOUBLE) * 5 AS c FROM embeddings))")
def v6_softmax(spark, d):
    logits = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 5)
    found = judge.softmax_label(logits, judge.label_places({0: "entailment", 1: "neutral", 2: "contradiction"}))
    return table(spark, d, "embeddings").select("vec_id", found.alias("x")).select("vec_id", "x.label", round3(F.col("x.confidence")).alias("confidence"))


@query("SELECT event_id, CAST(0 AS INTEGER) AS passage_index, CASE event_id % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'contradicted' ELSE 'neutral' END AS label, floor(greatest(0.0, least(1.0, value / 50)) * 1000 + 0.5) / 1000 AS confidence FROM events WHERE event_id % 4 <> 3")
def v9_parse_judgements(spark, d):
    label = F.when(F.col("event_id") % 4 == 3, "unknown").otherwise(F.element_at(F.array(F.lit("supported"), F.lit("contradicted"), F.lit("neutral")), (F.col("event_id") % 3 + 1).cast("int")))
    raw = F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("passageIndex"), label.alias("label"), (F.col("value") / 50).alias("confidence"))).alias("judgements")))
    rows = table(spark, d, "events").select("event_id", F.explode(judge.judgements_from_json(raw)).alias("x"))
    return rows.select("event_id", "x.passage_index", "x.label", round3(F.col("x.confidence")).alias("confidence"))


@query(oracle.JUDGED + "SELECT answer_id, claim_id, verdict, floor(score * 1000 + 0.5) / 1000 AS score FROM per_claim")
def v11_decisive(spark, d):
    return _per_claim(spark, d).select("answer_id", "claim_id", "verdict", round3(F.col("score")).alias("score"))


@query(oracle.TERMS + "SELECT conv_id, turn, array_to_string(terms, '|') AS terms FROM terms")
def v12_salient_terms(spark, d):
    return _turns(spark, d).select("conv_id", "turn", F.array_join(verdict.salient_terms(F.col("text")), "|").alias("terms"))


@query(oracle.TERMS + f"SELECT conv_id, turn, {oracle.HOLDS} AS holds FROM following")
def v13_guard(spark, d):
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    both = _turns(spark, d).withColumn("passage", after).where("passage IS NOT NULL")
    return both.select("conv_id", "turn", verdict.holds_terms(verdict.salient_terms(F.col("text")), F.col("passage")).alias("holds"))


@query(oracle.JUDGED + "SELECT answer_id, claim_id, rank, chunk_id, floor(confidence * 1000 + 0.5) / 1000 AS score FROM evidence")
def v15_evidence_top3(spark, d):
    rows = _per_claim(spark, d).select("answer_id", "claim_id", F.posexplode("evidence").alias("i", "e"))
    return rows.select("answer_id", "claim_id", (F.col("i") + 1).cast("long").alias("rank"), F.regexp_extract("e.path", "v([0-9]+)", 1).cast("long").alias("chunk_id"), F.col("e.score").alias("score"))


@query(oracle.JUDGED + "SELECT answer_id, verdict = 'grounded' AS grounded, verdict, score, n_claims FROM answers")
def v16_answer_verdict(spark, d):
    return _answers(spark, d).select("answer_id", "grounded", "verdict", "score", F.col("n_claims").cast("long").alias("n_claims"))


@query(oracle.JUDGED + "SELECT answer_id, refused FROM answers")
def v17_refused(spark, d):
    return _answers(spark, d).select("answer_id", F.array_join("refused_claims", ";").alias("refused"))


@query(oracle.JUDGED + "SELECT answer_id, summary FROM answers")
def v18_summary(spark, d):
    return _answers(spark, d).select("answer_id", "summary")


@query("SELECT event_id, floor(value * 1000 + 0.5) / 1000 AS value FROM events")
def v19_round(spark, d):
    return table(spark, d, "events").select("event_id", round3(F.col("value")).alias("value"))


@query(oracle.JUDGED + oracle.CITED)
def v20_cite(spark, d):
    return verdict.cite(_answers(spark, d)).select("answer_id", "cited", F.size("citations").cast("long").alias("n_citations"), "note")


# ---- evaluation


def _labelled(spark, d):
    gold = F.when(F.col("toxic") == 1, "contradicted").when(F.col("quality") == 1, "supported").otherwise("neutral")
    said = F.when(F.col("doc_id") % 10 == 0, "neutral").when(F.col("doc_id") % 17 == 0, "contradicted").otherwise(gold)
    return table(spark, d, "labels").select("doc_id", gold.alias("gold"), said.alias("predicted"))


@query(oracle.LABELLED + "SELECT n, floor((r1 + r2 + r3) / 3 * 1000 + 0.5) / 1000 AS balanced_accuracy FROM metrics")
def m2_recall(spark, d):
    return evaluation.verifier_metrics(_labelled(spark, d)).select("n", round3(F.col("balanced_accuracy")).alias("balanced_accuracy"))


@query(oracle.LABELLED + "SELECT floor(p1 * 1000 + 0.5) / 1000 AS refusal_precision, floor(p2 * 1000 + 0.5) / 1000 AS grounding_precision, floor(p3 * 1000 + 0.5) / 1000 AS contradiction_precision FROM metrics")
def m3_precision(spark, d):
    return evaluation.verifier_metrics(_labelled(spark, d)).select(*[round3(F.col(c)).alias(c) for c in ("refusal_precision", "grounding_precision", "contradiction_precision")])


@query("SELECT p, list_sort(list(value))[least(count(*) - 1, CAST(floor(p * count(*)) AS BIGINT)) + 1] AS value FROM events, (VALUES (0.5), (0.95)) t(p) WHERE value IS NOT NULL GROUP BY p")
def m4_percentile(spark, d):
    events = table(spark, d, "events")
    return evaluation.percentile(events, "value", 0.5).withColumn("p", F.lit(0.5)).unionByName(evaluation.percentile(events, "value", 0.95).withColumn("p", F.lit(0.95)))


def _expected(spark, d):
    rows = _labelled(spark, d).join(_docs(spark, d).select("doc_id", "source"), "doc_id")
    word = lambda x: F.when(x == "supported", "grounded").otherwise("refused")
    said = F.when(F.col("predicted") == "neutral", "flagged").otherwise(word(F.col("predicted")))
    return rows.select(F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("mode"), word(F.col("gold")).alias("expected"), said.alias("verdict"))


@query(oracle.LABELLED + "SELECT n, floor(gr * 1000 + 0.5) / 1000 AS grounding_recall, floor(rr * 1000 + 0.5) / 1000 AS refusal_recall, floor(gp * 1000 + 0.5) / 1000 AS grounding_precision FROM e2e")
def m6_e2e(spark, d):
    return evaluation.e2e_metrics(_expected(spark, d)).select("n", *[round3(F.col(c)).alias(c) for c in ("grounding_recall", "refusal_recall", "grounding_precision")])


@query(oracle.LABELLED + "SELECT coalesce(mode, 'untagged') AS mode, count(*) AS n, count(*) FILTER (got = expected) AS correct FROM expected GROUP BY 1")
def m7_by_mode(spark, d):
    return evaluation.by_mode(_expected(spark, d))


@query(oracle.LABELLED + "SELECT p1 >= 0.75 AS refusal_precision, p2 >= 1 AS grounding_precision FROM metrics")
def m8_gates(spark, d):
    return evaluation.gate_columns(evaluation.verifier_metrics(_labelled(spark, d)))


@query(oracle.LABELLED + "SELECT gp >= 1 AS grounding_precision, 1 - gr <= 0.15 AS false_refusal_rate, rr >= 0.9 AS refusal_recall FROM e2e")
def m8_e2e_gates(spark, d):
    return evaluation.gate_columns(evaluation.e2e_metrics(_expected(spark, d)))


# ---- changes, edits and revisions


def _log(spark, d):
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("op"), "ts", F.col("event_id").cast("string").alias("content"))


@query("SELECT path, count(*) AS events, max(ts) AS ts FROM (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts) AS session FROM (SELECT CAST(user_id AS VARCHAR) AS path, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY path, session")
def r2_debounce(spark, d):
    return changes.debounce(_log(spark, d), "10 minutes").select("path", "events", "ts")


@query("SELECT CAST(user_id AS VARCHAR) AS path, event_type AS op, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) = 1")
def r4_latest_op(spark, d):
    return changes.latest(_log(spark, d)).select("path", "op", "ts")


@query("SELECT doc_id, CAST((length(text) - length(replace(text, ' the ', ''))) // 5 AS INTEGER) AS n, CASE WHEN (length(text) - length(replace(text, ' the ', ''))) // 5 = 1 THEN sha256(replace(text, ' the ', ' THE ')) END AS edited FROM documents")
def w2_replace(spark, d):
    old = F.lit(" the ")
    return _docs(spark, d).select("doc_id", revisions.match_count(F.col("text"), old).alias("n"), F.sha2(revisions.replace_unique(F.col("text"), old, F.lit(" THE ")), 256).alias("edited"))


@query("SELECT doc_id, substr(sha256('d' || doc_id || chr(10) || text || chr(10) || text || '!'), 1, 16) AS token FROM documents")
def w3_token(spark, d):
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return _docs(spark, d).select("doc_id", revisions.confirm_token(path, F.col("text"), F.concat("text", F.lit("!"))).alias("token"))


@query("SELECT CAST(user_id AS VARCHAR) AS path, epoch_us(ts) AS ts_ms FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 20")
def w6_retention(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return revisions.retained(rows)


# ---- all together


_ASKED = "SELECT conv_id * 1000 + turn AS answer_id, text FROM conversations WHERE role = 'assistant'"


@query(oracle.verified(_ASKED) + "SELECT answer_id, verdict, score, summary, n_claims FROM answers")
def flagship_verify(spark, d):
    """Claims of the assistant's turns, searched in the corpus, judged by words, and brought to a verdict a turn."""
    turns = table(spark, d, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "text")
    results = engine.verify(turns, kept(EMBEDDER.embed(chunks(spark, d))), EMBEDDER, judge.LexicalJudge())
    return results.select("answer_id", "verdict", "score", "summary", F.col("n_claims").cast("long").alias("n_claims"))


@query(oracle.verified("SELECT item_id AS answer_id, text FROM benchmark") + oracle.CITED)
def flagship_cite(spark, d):
    """What could be cited for the benchmark's items, judged by words."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("answer_id"), "text")
    results = engine.verify(asked, kept(EMBEDDER.embed(chunks(spark, d))), EMBEDDER, judge.LexicalJudge())
    return verdict.cite(results).select("answer_id", "cited", F.size("citations").cast("long").alias("n_citations"), "note")


@query(oracle.verified(_ASKED, "SELECT b.conv_id * 1000 + b.turn AS answer_id, 'c' || a.conv_id AS path, '#t' || a.turn AS anchor, a.text, -a.turn AS ordinal FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn BETWEEN b.turn - 20 AND b.turn WHERE b.role = 'assistant' AND b.conv_id % 2 = 0") + "SELECT a.answer_id, verdict, score, n_claims, n_citations FROM answers a LEFT JOIN cited USING (answer_id)")
def s6_sources(spark, d):
    """The same, where every second conversation's turns are judged by that turn and the 20 before it, the last one first."""
    said = table(spark, d, "conversations")
    turns = said.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "conv_id", "turn", "text")
    given = turns.where("conv_id % 2 = 0").select("answer_id", "conv_id", F.explode(F.sequence(F.greatest(F.lit(0), F.col("turn") - 20), F.col("turn"))).alias("turn")).join(said.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    sources = given.select("answer_id", F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path"), F.concat(F.lit("#t"), F.col("turn").cast("string")).alias("anchor"), "text", (-F.col("turn")).alias("ordinal"))
    results = engine.verify(turns.select("answer_id", "text"), kept(EMBEDDER.embed(chunks(spark, d))), EMBEDDER, judge.LexicalJudge(), sources=sources)
    cited = verdict.cite(results).select("answer_id", F.size("citations").cast("long").alias("n_citations"))
    return results.select("answer_id", "verdict", "score", F.col("n_claims").cast("long").alias("n_claims")).join(cited, "answer_id")
