"""SQL (DuckDB) that restates the operators, for comparison; shared parts end where a query's own SELECT begins."""

from factloom.operators.claims import VERBS
from factloom.operators.judge import NEGATIONS, STOP
from factloom.plans.corpus import CONTENT, EMBEDDER, PATH

CORPUS = f"doc_id, {PATH} AS path, {CONTENT} AS content"

CHANGES = """
WITH new AS (SELECT 'd' || doc_id AS path, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0),
old AS (SELECT 'd' || doc_id AS path, sha256(text) AS o FROM documents WHERE doc_id % 13 <> 0),
changes AS (SELECT coalesce(new.path, old.path) AS path, h AS content_hash,
    CASE WHEN o IS NULL THEN 'insert' WHEN h IS NULL THEN 'prune' WHEN h = o THEN 'unchanged' ELSE 'update' END AS op FROM new FULL JOIN old ON new.path = old.path)
"""

# the cut of an oversize text: behind the last line break past the middle, else the last space, else hard
_CUT = """CASE WHEN length(rest) <= 1000 THEN length(rest) ELSE CASE WHEN (CASE WHEN nl > 500 THEN nl ELSE sp END) > 0 THEN (CASE WHEN nl > 500 THEN nl ELSE sp END) + 1 ELSE 1000 END END"""
_LAST = "CASE WHEN strpos(reverse(substr(rest, 1, 1000)), {0}) = 0 THEN -1 ELSE length(substr(rest, 1, 1000)) - strpos(reverse(substr(rest, 1, 1000)), {0}) END"


def _pieces(keys: str, start: str) -> str:
    return f"""
pieces AS ({start}
    UNION ALL
    SELECT {keys}, pos + cut, substr(rest, cut + 1), substr(rest, 1, cut), pos
    FROM (SELECT *, {_CUT} AS cut FROM (SELECT *, {_LAST.format("chr(10)")} AS nl, {_LAST.format("' '")} AS sp FROM pieces WHERE rest <> '')))
"""


SPLIT = "WITH RECURSIVE " + _pieces("doc_id", "SELECT doc_id, CAST(0 AS BIGINT) AS pos, text AS rest, CAST(NULL AS VARCHAR) AS piece, CAST(NULL AS BIGINT) AS piece_at FROM documents")

_OVER = "OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_HEADS = ", ".join(
    f"last_value(CASE WHEN level = {k} THEN i END IGNORE NULLS) {_OVER} AS h{k}, last_value(CASE WHEN level = {k} THEN title END IGNORE NULLS) {_OVER} AS t{k}" for k in range(1, 7)
)
_ACTIVE = ", ".join(f"CASE WHEN h{k} > greatest(-1{''.join(f', coalesce(h{j}, -1)' for j in range(1, k))}) THEN t{k} END" for k in range(1, 7))

CHUNKER = rf"""
WITH RECURSIVE corpus AS (SELECT {CORPUS} FROM documents),
fm AS (SELECT *, regexp_extract(content, '^---\r?\n[\s\S]*?\r?\n---\r?\n?') AS front FROM corpus),
body AS (SELECT path, length(front) AS base, string_split(substr(content, length(front) + 1), chr(10)) AS ls FROM fm),
numbered AS (SELECT path, base, ls, unnest(range(1, len(ls) + 1)) AS k FROM body),
lines AS (SELECT path, CAST(k - 1 AS BIGINT) AS i, ls[k] AS line, CAST(base + coalesce(sum(length(ls[k]) + 1) OVER (PARTITION BY path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM numbered),
m AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS marker FROM lines),
f AS (SELECT *, sum(CAST(marker AS INT)) OVER (PARTITION BY path ORDER BY i) AS fences FROM m),
g AS (SELECT *, NOT marker AND fences % 2 = 1 AS in_fence, CASE WHEN marker OR fences % 2 = 1 THEN 0 ELSE length(regexp_extract(line, '^(#{{1,6}})\s+(.*\S)\s*$', 1)) END AS level, regexp_extract(line, '^(#{{1,6}})\s+(.*\S)\s*$', 2) AS title FROM f),
h AS (SELECT *, level > 0 OR (NOT regexp_matches(line, '\S') AND NOT in_fence AND NOT marker) AS outside FROM g),
o AS (SELECT *, (marker AND fences % 2 = 1) OR coalesce(lag(outside OR (marker AND fences % 2 = 0)) OVER (PARTITION BY path ORDER BY i), true) AS opens, {_HEADS} FROM h),
b AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY path ORDER BY i) AS block, list_filter([{_ACTIVE}], lambda x: x IS NOT NULL) AS heads FROM o),
blocks AS (SELECT path, block, list(line ORDER BY i) AS ls, list(pos ORDER BY i) AS ps, arg_min(heads, i) AS heads FROM b WHERE NOT outside GROUP BY path, block HAVING bool_or(regexp_matches(line, '\S'))),
shaped AS (SELECT *, full_ >= 2 AND pipes >= 2 AND pipes >= full_ - 1 AS is_table FROM (SELECT *, len(list_filter(ls, lambda x: regexp_matches(x, '\S'))) AS full_, len(list_filter(ls, lambda x: regexp_matches(x, '^\s*\|'))) AS pipes FROM blocks)),
{_pieces("path, heads", "SELECT path, heads, ps[1] AS pos, array_to_string(ls, chr(10)) AS rest, CAST(NULL AS VARCHAR) AS piece, CAST(NULL AS BIGINT) AS piece_at FROM shaped WHERE NOT is_table")},
table_lines AS (SELECT path, heads, ls, ps, unnest(range(1, len(ls) + 1)) AS k FROM shaped WHERE is_table),
pieces_all AS (
    SELECT path, heads, ps[k] AS char_start, ls[k] AS text, 'row' AS kind FROM table_lines WHERE regexp_matches(ls[k], '^\s*\|') AND NOT regexp_matches(ls[k], '^\s*\|[\s:|-]+\|?\s*$')
    UNION ALL SELECT path, heads, piece_at, piece, 'text' FROM pieces WHERE regexp_matches(piece, '\S')
    UNION ALL SELECT path, CAST([] AS VARCHAR[]), 0, front, 'front' FROM fm WHERE regexp_matches(front, '(?i)(^|\n)(aliases|tags)\s*:')
),
placed AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY char_start) - 1 AS ordinal, nullif(regexp_extract(regexp_replace(text, '\s+$', ''), '(?:^|\s)\^([A-Za-z0-9-]+)$', 1), '') AS block_id FROM pieces_all),
chunks AS (SELECT path, ordinal, char_start, text, block_id, CASE WHEN len(heads) > 0 THEN array_to_string(heads, ' > ') END AS heading_path, coalesce('#^' || block_id, '#' || heads[-1], '#L' || ordinal) AS anchor FROM placed),
found_links AS (SELECT path, ordinal, unnest(regexp_extract_all(text, '\[\[([^\]|#]+)(#[^\]|]+)?(\|[^\]]+)?\]\]')) AS m FROM chunks),
links AS (SELECT path, ordinal, trim(regexp_extract(m, '\[\[([^\]|#]+)(#[^\]|]+)?(\|[^\]]+)?\]\]', 1)) AS target_note, nullif(regexp_extract(m, '\[\[([^\]|#]+)(#[^\]|]+)?(\|[^\]]+)?\]\]', 2), '') AS target_anchor,
    substr(nullif(regexp_extract(m, '\[\[([^\]|#]+)(#[^\]|]+)?(\|[^\]]+)?\]\]', 3), ''), 2) AS alias FROM found_links)
"""


def chunker(docs: str) -> str:
    """CHUNKER over notes made from other rows of the columns of documents."""
    return CHUNKER.replace("FROM documents)", f"FROM ({docs}))", 1)


def _embedded(text: str) -> str:
    """The keyword embedding of an expression, as a list of doubles."""
    counts = ", ".join(f"CAST((length(lower({text})) - length(replace(lower({text}), '{k}', ''))) / {len(k)} AS DOUBLE)" for k in EMBEDDER.keywords)
    return f"[{counts}]"


_UNIT = "list_transform(c, lambda x: x / coalesce(nullif(sqrt(list_sum(list_transform(c, lambda y: y * y))), 0), 1))"
KEYWORDS = f"WITH counted AS (SELECT doc_id, {_embedded('text')} AS c FROM documents), embedded AS (SELECT doc_id, {_UNIT} AS e FROM counted)"


def _distance(a: str, b: str, n: int) -> str:
    return f"floor(sqrt({' + '.join(f'({a}[{k}] - {b}[{k}]) * ({a}[{k}] - {b}[{k}])' for k in range(1, n + 1))}) * 1000000000 + 0.5) / 1000000000"


HITS = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
hits AS (SELECT query_id, chunk_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank
    FROM (SELECT q.vec_id AS query_id, b.vec_id AS chunk_id, {_distance("q.e", "b.e", 64)} AS distance FROM v q, v b WHERE q.vec_id % 100 = 0)) WHERE rank <= 6)
"""

_BASE = f"""
, counted AS (SELECT *, CAST(regexp_extract(path, '/d([0-9]+)\\.md$', 1) AS BIGINT) * 100000 + ordinal AS chunk_id, {_embedded('text')} AS c FROM chunks),
base AS MATERIALIZED (SELECT *, {_UNIT} AS e FROM counted)
"""

VECTORS = CHUNKER + _BASE

SEARCH = CHUNKER + _BASE + f"""
, asked AS MATERIALIZED (SELECT item_id, {_UNIT} AS e FROM (SELECT item_id, {_embedded('text')} AS c FROM benchmark)),
found AS (SELECT *, greatest(0.0, least(1.0, 1 - distance * distance / 2)) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank
    FROM (SELECT item_id AS query_id, chunk_id, path, anchor, text, {_distance("asked.e", "base.e", 8)} AS distance FROM asked, base)) WHERE rank <= 3)
"""

VERB_LIST = "[" + ", ".join(f"'{v}'" for v in VERBS) + "]"
_HAS_VERB = f"len(list_filter(regexp_extract_all({{0}}, '[A-Za-z''-]+'), lambda w: list_contains({VERB_LIST}, lower(w)))) > 0"
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _claims(keys: str, texts: str) -> str:
    return rf"""
marked AS (SELECT {keys}, {_TRIM.format("text")} AS t, regexp_replace(regexp_replace(text, '([.!?]["'')\]]*)\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g') AS marks FROM {texts}),
listed AS (SELECT {keys}, t, list_filter(list_transform(string_split(marks, chr(1)), lambda s: {_TRIM.format("s")}), lambda s: s <> '') AS ss FROM marked),
sentences AS (SELECT {keys}, i - 1 AS i, ss[i] AS s FROM (SELECT {keys}, ss, unnest(range(1, len(ss) + 1)) AS i FROM listed)),
parted AS (SELECT *, list_filter(list_transform(regexp_split_to_array(s, '(?i)\s*,?\s+and\s+'), lambda p: {_TRIM.format("p")}), lambda p: p <> '') AS parts FROM sentences),
worded AS (SELECT *, list_filter(regexp_split_to_array(coalesce(parts[1], ''), '\s+'), lambda w: w <> '') AS ws FROM parted),
prefixed AS (SELECT *, list_filter(range(1, len(ws) + 1), lambda k: list_contains({VERB_LIST}, lower(regexp_replace(ws[k], '[^A-Za-z]', '', 'g'))))[1] AS at_verb FROM worded),
filled AS (SELECT *, list_transform(range(1, len(parts) + 1), lambda k: CASE WHEN k = 1 OR ({_HAS_VERB.format("parts[k]")}) OR at_verb IS NULL THEN parts[k] ELSE array_to_string(ws[1:at_verb], ' ') || ' ' || parts[k] END) AS filled_parts FROM prefixed),
split_sentences AS (SELECT *, CASE WHEN len(parts) >= 2 AND len(list_filter(filled_parts, lambda x: NOT ({_HAS_VERB.format("x")}))) = 0 THEN filled_parts ELSE [s] END AS conjuncts FROM filled),
all_parts AS (SELECT {keys}, list_filter(list_transform(flatten(list(conjuncts ORDER BY i)), lambda x: {_TRIM.format("x")}), lambda x: length(x) >= 3 AND NOT ends_with(x, '?') AND len(regexp_split_to_array(x, '\s+')) >= 2) AS cs FROM split_sentences GROUP BY {keys}),
whole AS (SELECT {keys}, t, CASE WHEN t = '' THEN CAST([] AS VARCHAR[]) WHEN len(coalesce(cs, CAST([] AS VARCHAR[]))) > 0 THEN cs ELSE [t] END AS cs FROM listed LEFT JOIN all_parts USING ({keys})),
claims AS (SELECT {keys}, k - 1 AS claim_id, cs[k] AS claim FROM (SELECT {keys}, cs, unnest(range(1, len(cs) + 1)) AS k FROM whole))
"""


CLAIMS = "WITH" + _claims("conv_id, turn", "conversations")

_TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9.$:%+/-]*'), lambda t: regexp_replace(t, '[.$:%+/-]+$', '')) AS ts"
_SALIENT = "list_transform(list_filter(range(1, len(ts) + 1), lambda k: ts[k] <> '' AND (regexp_matches(ts[k], '[0-9]') OR regexp_matches(ts[k], '[A-Z][a-z]*[A-Z]') OR regexp_matches(ts[k], '^[A-Z]{2,}$') OR (k > 1 AND regexp_matches(ts[k], '^[A-Z][a-z]{2,}$')))), lambda k: ts[k]) AS terms"
#: Over terms, the words ws and the lower-cased text low of a passage.
HOLDS = "len(list_filter(terms, lambda t: NOT (contains(low, lower(t)) OR (length(t) >= 5 AND len(list_filter(ws, lambda w: contains(lower(t), w))) > 0)))) = 0"

TERMS = f"""
WITH tokens AS (SELECT conv_id, turn, text, {_TOKENS.format("text")} FROM conversations),
terms AS (SELECT conv_id, turn, text, {_SALIENT} FROM tokens),
following AS (SELECT *, regexp_extract_all(low, '[a-z0-9]{{4,}}') AS ws FROM (SELECT *, lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS low FROM terms) WHERE low IS NOT NULL)
"""


def _answers(without: str) -> str:
    """Evidence, answers and numbers of citations, of judged, per_claim and the answers without claims."""
    return f"""
evidence AS (SELECT answer_id, claim_id, chunk_id, confidence, verdict, rank FROM (SELECT judged.answer_id, judged.claim_id, chunk_id, confidence, verdict, row_number() OVER (PARTITION BY judged.answer_id, judged.claim_id ORDER BY confidence DESC, passage_index) AS rank
    FROM judged JOIN per_claim ON judged.answer_id = per_claim.answer_id AND judged.claim_id = per_claim.claim_id AND label = verdict WHERE verdict <> 'neutral' AND confidence >= 0.4) WHERE rank <= 3),
totals AS (SELECT answer_id, count(*) AS n, list_sum(list(score ORDER BY claim_id)) / count(*) AS mean, count(*) FILTER (verdict = 'supported') AS s, count(*) FILTER (verdict = 'contradicted') AS c, count(*) FILTER (verdict = 'neutral') AS u,
    bool_and(verdict = 'supported' AND score >= 0.8) AS solid, string_agg(CASE WHEN verdict = 'contradicted' OR score < 0.5 THEN claim END, ';' ORDER BY claim_id) AS refused FROM per_claim GROUP BY answer_id),
answers AS (SELECT answer_id, n AS n_claims, floor(mean * 1000 + 0.5) / 1000 AS score, c AS against, CASE WHEN solid AND c = 0 THEN 'grounded' WHEN c > 0 OR mean < 0.5 THEN 'refused' ELSE 'flagged' END AS verdict, coalesce(refused, '') AS refused,
        s || '/' || n || ' claim(s) supported by your notes' || CASE WHEN c > 0 THEN '; ' || c || ' contradicted' ELSE '' END || CASE WHEN u > 0 THEN '; ' || u || ' unsupported' ELSE '' END || '.' AS summary FROM totals
    UNION ALL SELECT answer_id, 0, 0.0, 0, 'refused', '', 'No verifiable claims were found in the text.' FROM ({without})),
cited AS (SELECT a.answer_id, count(e.chunk_id) AS n_citations FROM answers a LEFT JOIN evidence e ON a.answer_id = e.answer_id AND e.verdict = 'supported' GROUP BY a.answer_id)
"""


JUDGED = HITS + """
, scored AS (SELECT query_id % 700 AS answer_id, query_id AS claim_id, chunk_id, distance, greatest(0.0, least(1.0, 1 - distance * distance / 2)) AS score FROM hits),
gated AS (SELECT *, row_number() OVER (PARTITION BY answer_id, claim_id ORDER BY distance, chunk_id) - 1 AS passage_index FROM scored WHERE score >= 0.35),
judged AS (SELECT *, ['supported', 'neutral', 'contradicted', 'supported'][(chunk_id * 7 + claim_id // 100) % 4 + 1] AS label, ((chunk_id * 37 + claim_id) % 101) / 100 AS confidence FROM gated),
first_strong AS (SELECT answer_id, claim_id, arg_min(label, passage_index) AS label, arg_min(confidence, passage_index) AS confidence FROM judged WHERE label <> 'neutral' AND confidence >= 0.5 GROUP BY answer_id, claim_id),
per_claim AS (SELECT vec_id % 700 AS answer_id, vec_id AS claim_id, 'claim ' || vec_id AS claim, coalesce(first_strong.label, 'neutral') AS verdict, CASE WHEN first_strong.label = 'supported' THEN confidence ELSE 0.0 END AS score
    FROM embeddings LEFT JOIN first_strong ON answer_id = vec_id % 700 AND claim_id = vec_id WHERE vec_id % 100 = 0),
""" + _answers("SELECT vec_id + 100000 AS answer_id FROM embeddings WHERE vec_id < 3")

CITED = "SELECT answer_id, n_citations > 0 AND verdict <> 'refused' AS cited, n_citations, CASE WHEN n_citations > 0 AND verdict <> 'refused' THEN 'Supported by ' || n_citations || ' note passage(s).' WHEN against > 0 THEN 'Your notes contradict this — do not state it as fact.' ELSE 'No supporting notes found — do not state this as fact.' END AS note FROM answers LEFT JOIN cited USING (answer_id)"

#: A passage as a judge sees it.
CLEAN = r"regexp_replace(regexp_replace(replace({0}, chr(13), ''), '\s*\^[A-Za-z0-9-]+\s*$', ''), '^\s+|\s+$', '', 'g')"


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9à-ÿ'']+'))"
_NUMBERS = "list_filter({0}, lambda x: regexp_full_match(x, '[0-9]+'))"


def verified(answers: str, sources: str = "SELECT NULL AS answer_id, NULL AS path, NULL AS anchor, NULL AS text, NULL AS ordinal WHERE false") -> str:
    """answers and cited for answers (answer_id, text), by search, or by sources (answer_id, path, anchor, text, ordinal) where an answer has some."""
    return CHUNKER + _BASE + f"""
, texts AS MATERIALIZED ({answers}), sources AS MATERIALIZED ({sources}), {_claims("answer_id", "texts")},
claimed AS MATERIALIZED (SELECT answer_id, claim_id, claim FROM claims),
asked AS MATERIALIZED (SELECT claim, {_UNIT} AS e FROM (SELECT claim, {_embedded("claim")} AS c FROM (SELECT DISTINCT claim FROM claimed WHERE answer_id NOT IN (SELECT answer_id FROM sources)))),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY distance, chunk_id) AS rank FROM (SELECT claim, chunk_id, text, {_distance("asked.e", "base.e", 8)} AS distance FROM asked, base)) WHERE rank <= 6),
scored AS (SELECT answer_id, claim_id, claim, chunk_id, text, distance, rank, greatest(0.0, least(1.0, 1 - distance * distance / 2)) AS score FROM claimed JOIN near USING (claim) WHERE answer_id NOT IN (SELECT answer_id FROM sources)
    UNION ALL SELECT answer_id, claim_id, claim, -i, text, 0, i, 1.0 FROM claimed JOIN (SELECT answer_id, text, row_number() OVER (PARTITION BY answer_id ORDER BY ordinal, path, anchor, text) AS i FROM sources) USING (answer_id)),
gated AS MATERIALIZED (SELECT *, {CLEAN.format("text")} AS passage, row_number() OVER (PARTITION BY answer_id, claim_id ORDER BY distance, rank) - 1 AS passage_index FROM scored WHERE score >= 0.35),
compared AS (SELECT *, len(list_intersect(content, p)) / greatest(len(content), 1) AS o, list_has_any(c, {_sql_list(NEGATIONS)}) <> list_has_any(p, {_sql_list(NEGATIONS)}) AS one_negated, {_NUMBERS.format("c")} AS cn, {_NUMBERS.format("p")} AS pn
    FROM (SELECT *, list_filter(c, lambda x: NOT list_contains({_sql_list(STOP)}, x)) AS content FROM (SELECT *, {_WORDS.format("claim")} AS c, {_WORDS.format("passage")} AS p FROM gated))),
against AS (SELECT *, o >= 0.5 AND (one_negated OR (len(cn) > 0 AND len(pn) > 0 AND NOT list_has_any(cn, pn))) AS no FROM compared),
judged AS MATERIALIZED (SELECT *, CASE WHEN no THEN 'contradicted' WHEN o >= 0.6 THEN 'supported' ELSE 'neutral' END AS label, CASE WHEN no THEN 0.5 + o / 2 WHEN o >= 0.6 THEN o ELSE 1 - o END AS confidence FROM against),
decisive AS (SELECT * FROM judged WHERE label <> 'neutral' AND confidence >= 0.5 QUALIFY row_number() OVER (PARTITION BY answer_id, claim_id ORDER BY passage_index) = 1),
guarded AS (SELECT answer_id, claim_id, CASE WHEN label = 'supported' AND NOT ({HOLDS}) THEN 'neutral' ELSE label END AS label, confidence
    FROM (SELECT *, lower(passage) AS low, regexp_extract_all(lower(passage), '[a-z0-9]{{4,}}') AS ws, {_SALIENT} FROM (SELECT *, {_TOKENS.format("claim")} FROM decisive))),
per_claim AS MATERIALIZED (SELECT answer_id, claim_id, claim, coalesce(label, 'neutral') AS verdict, CASE WHEN label = 'supported' THEN confidence ELSE 0.0 END AS score FROM claimed LEFT JOIN guarded USING (answer_id, claim_id)),
""" + _answers("SELECT DISTINCT answer_id FROM texts WHERE answer_id NOT IN (SELECT answer_id FROM claimed)")


LABELLED = """
WITH gold AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'contradicted' WHEN quality = 1 THEN 'supported' ELSE 'neutral' END AS gold FROM labels),
labelled AS (SELECT doc_id, gold, CASE WHEN doc_id % 10 = 0 THEN 'neutral' WHEN doc_id % 17 = 0 THEN 'contradicted' ELSE gold END AS said FROM gold),
metrics AS (SELECT count(*) AS n,
    coalesce(count(*) FILTER (gold = 'supported' AND said = gold) / nullif(count(*) FILTER (gold = 'supported'), 0), 1) AS r1,
    coalesce(count(*) FILTER (gold = 'contradicted' AND said = gold) / nullif(count(*) FILTER (gold = 'contradicted'), 0), 1) AS r2,
    coalesce(count(*) FILTER (gold = 'neutral' AND said = gold) / nullif(count(*) FILTER (gold = 'neutral'), 0), 1) AS r3,
    coalesce(count(*) FILTER (said <> 'supported' AND gold <> 'supported') / nullif(count(*) FILTER (said <> 'supported'), 0), 1) AS p1,
    coalesce(count(*) FILTER (said = 'supported' AND gold = said) / nullif(count(*) FILTER (said = 'supported'), 0), 1) AS p2,
    coalesce(count(*) FILTER (said = 'contradicted' AND gold = said) / nullif(count(*) FILTER (said = 'contradicted'), 0), 1) AS p3 FROM labelled),
expected AS (SELECT CASE WHEN doc_id % 3 <> 0 THEN source END AS mode, CASE WHEN gold = 'supported' THEN 'grounded' ELSE 'refused' END AS expected, CASE WHEN said = 'contradicted' THEN 'refused' ELSE 'grounded' END AS got FROM labelled JOIN documents USING (doc_id)),
e2e AS (SELECT count(*) AS n,
    coalesce(count(*) FILTER (expected = 'grounded' AND got = expected) / nullif(count(*) FILTER (expected = 'grounded'), 0), 1) AS gr,
    coalesce(count(*) FILTER (expected = 'refused' AND got = expected) / nullif(count(*) FILTER (expected = 'refused'), 0), 1) AS rr,
    coalesce(count(*) FILTER (got = 'grounded' AND expected = got) / nullif(count(*) FILTER (got = 'grounded'), 0), 1) AS gp FROM expected)
"""
