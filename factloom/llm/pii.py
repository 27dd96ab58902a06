"""Personal data by weak supervision.

One pass over the texts finds candidates: the base patterns of four kinds, and
looser forms of more kinds, credentials among them. Five labelers (format, gazetteer, context words,
boundaries, digit patterns) vote -1, 0 or 1 on each. The votes are counted over
all candidates of the corpus; expectation-maximisation estimates, from these
counts, how often each labeler votes which way on true and on false candidates,
and so how likely each vote pattern is a true one. A logistic span classifier is
then trained on those soft labels and decides which loose candidates are added.
It sees the votes and, hashed, the span's characters, its length, the words and
signs around it. Base spans always stay.

What reaches the driver is one count for each pattern of kind and votes, at most
kinds * 3^5 rows, and for the classifier about SAMPLE distinct candidates (as
their hash has it) with their numbers. The candidates, without texts, are kept in
the shared folder between the two passes.

Defined cases: a null text is an empty one; equal rows get equal results; a
corpus without candidates trains nothing and adds nothing; other columns stay,
but for those with the names of output columns. Offsets are code points, the
end exclusive.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm._shared import keep, table
from factloom.llm._text import slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "email_text", "phone_local", "national_id", "iban", "card_digits", "secret")
LABELERS = ("format", "gazetteer", "context", "boundary", "digits")
#: A loose candidate is added from this probability on.
ACCEPT = 0.5
#: Distinct candidates that the classifier is trained on, about, and places of its hashed features.
SAMPLE, PLACES = 20_000, 1 << 14

# Gazetteers of the labelers.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co de fr es it nl be ch at uk us ca au eu pt br mx ar jp kr cn ru pl se no dk fi ie nz".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98", "212", "213", "216", "351", "352", "353", "354", "358", "359", "370", "371", "372", "380", "420", "421", "852", "886", "966", "971", "972")
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "2221", "34", "37", "36", "6011", "65", "35")
IBAN_LENGTHS = {"DE": 22, "FR": 27, "ES": 24, "IT": 27, "NL": 18, "BE": 16, "AT": 20, "CH": 21, "GB": 22, "IE": 22, "PT": 25, "LU": 20, "DK": 18, "SE": 24, "NO": 15, "FI": 18, "PL": 28}
CUES = {
    "mail": ("mail", "contact", "kontakt", "correo", "courriel", "write", "reach"),
    "net": ("ip", "host", "server", "address", "login", "from"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"),
    "tel": ("tel", "phone", "call", "fax", "mobile", "cell", "anruf", "contact", "telefon", "móvil", "portable"),
    "id": ("ssn", "social", "security", "insurance", "id"),
    "bank": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "secret": ("password", "passwd", "pwd", "passwort", "secret", "token", "key", "auth", "credential", "bearer"),
}
SECRET_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xoxb-", "xoxp-", "sk-", "AIza")
PLACEHOLDERS = ("example", "changeme", "your", "placeholder", "xxxx", "dummy", "sample")
CONTRA_CUES = frozenset("version v release isbn issn order figure fig table page chapter section build model no nr ref".split())
_GROUP = {"email": "mail", "email_text": "mail", "ip": "net", "card": "card", "phone": "tel", "phone_local": "tel", "national_id": "id", "iban": "bank", "card_digits": "card", "secret": "secret"}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = {
    "email_text": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)|\[AT\]|\(AT\)| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\[DOT\]|\(DOT\)| dot ) ?[A-Za-z0-9-]{1,63}){1,4}"),
    "phone_local": re.compile(r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    # a number that the base pattern has run together with digits in front or behind
    "card_digits": re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    # keys with a known beginning, and what is assigned to a name of a secret; of the latter the value alone is the span
    "secret": re.compile(
        r"(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])|(?:gh[opsru]_|xox[bp]-|sk-|AIza)(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{16,})"
        r"|(?:(?i:passwor[dt]|passwd|pwd|secret|token|(?:api|access|auth)[_-]?key)[\"']? ?[:=] ?|(?i:bearer) )[\"']?(?=[A-Za-z+/_.~-]*[0-9])([A-Za-z0-9+/_.~-]{12,})",
        re.ASCII,
    ),
}
#: Texts without a match hold no candidate of any kind.
_MAY_HOLD = r"[0-9@]|[\[(](?:at|AT|dot|DOT)[\])]| dot |A[KS]IA"


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_matches(text: str):
    """(kind, start, end, valid) of the base patterns, leftmost and not overlapping within a kind; linear in the text."""
    stop, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > stop and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        stop = found.end() if found else at + 1
        if found:
            yield "email", begin, stop, True
        at = text.find("@", at + 1)
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        ends = [x.span() for x in re.finditer("[0-9]+", m.group())]
        for k in range(0, len(ends) - 3, 4):
            a, b = m.start() + ends[k][0], m.start() + ends[k + 3][1]
            yield "ip", a, b, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text[a:b].split("."))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        yield "card", m.start(), m.end(), 13 <= len(d) <= 19 and luhn(d)
    for m in _PHONE.finditer(text):
        yield "phone", m.start(), m.end(), 9 <= len(_digits(m.group())) <= 15


def _format(kind: str, value: str, valid: bool) -> int:
    if kind == "iban":
        flat = value.replace(" ", "")
        number = "".join(str(int(c, 36)) for c in flat[4:] + flat[:4])
        return 1 if int(number) % 97 == 1 else -1
    if kind == "card_digits":
        return 1 if luhn(value) else -1
    if kind == "secret":
        return 1 if len(set(value)) >= 8 and any(c.isalpha() for c in value) else -1
    if kind == "national_id":
        return 1 if value[4:6] != "00" and value[7:] != "0000" else -1
    if kind == "phone_local":
        d = _digits(value)
        return 1 if d[0] in "23456789" and d[3] in "23456789" else -1
    return 1 if valid else -1


def _gazetteer(kind: str, value: str) -> int:
    d = _digits(value)
    if kind in ("email", "email_text"):
        return 1 if re.split(r"[^A-Za-z0-9-]+", value)[-1].lower() in TOP_DOMAINS else -1
    if kind == "ip":
        first = value.split(".")[0].lstrip("0")
        return 1 if first and len(first) <= 3 and int(first) < 224 else -1
    if kind in ("card", "card_digits"):
        return 1 if d.startswith(CARD_PREFIXES) else -1
    if kind == "phone":
        return 1 if d.startswith(CALLING_CODES) else -1
    if kind == "phone_local":
        return 1 if d[:3] not in ("800", "900", "911") else 0
    if kind == "national_id":
        return 1 if d[:3] not in ("000", "666") and d[0] != "9" else -1
    if kind == "secret":
        return 1 if value.startswith(SECRET_PREFIXES) else -1 if any(p in value.lower() for p in PLACEHOLDERS) else 0
    return 1 if IBAN_LENGTHS.get(value[:2]) == len(value.replace(" ", "")) else -1


def _context(kind: str, before: str) -> int:
    near = re.findall(r"[^\W\d_]+", before.lower())[-4:]
    if any(w.startswith(cue) if len(cue) > 2 else w == cue for w in near for cue in CUES[_GROUP[kind]]):
        return 1
    return -1 if near and near[-1] in CONTRA_CUES else 0


def _boundary(before: str, after: str) -> int:
    odd = lambda c: c.isalnum() or c in "_@/+="
    return -1 if (before and odd(before[-1])) or (after and odd(after[0])) else 1


def _digit_pattern(value: str) -> int:
    d = _digits(value)
    if len(d) < 6:
        return 0
    return -1 if len(set(d)) <= 2 or d in "01234567890123456789" or d in "98765432109876543210" else 1


def _outline(value: str) -> str:
    """The kinds of characters of a span, each run as one."""
    return re.sub(r"([9aA])\1+", r"\1", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", value))))[:24]


def _features(kind: int, votes: str, value: str, before: str, after: str) -> list[int]:
    """Places of the weights of a candidate: its kind, its votes, and hashes of what it and its surroundings look like."""
    words, following = re.findall(r"[^\W\d_]+", before.lower())[-2:], re.search(r"[^\W\d_]+", after.lower())
    seen = [_outline(value), str(min(15, len(value) // 3)), "".join(words[-1:]), "".join(words[:-1]), following.group() if following else "", _outline(before[-1:]), _outline(after[:1])]
    own = len(KINDS) + 3 * len(LABELERS)
    return [kind, *(len(KINDS) + 3 * j + "-0+".index(v) for j, v in enumerate(votes)), *(own + zlib.crc32(f"{kind}:{j}:{x}".encode()) % PLACES for j, x in enumerate(seen))]


def candidates(text: str) -> list[tuple[int, int, int, bool, str, list[int]]]:
    """(kind, start, end, base, votes, features) of all candidates of a text."""
    found = [(k, a, b, ok, ok) for k, a, b, ok in base_matches(text) if ok or b - a >= 7]
    found += [(k, *m.span(m.lastindex or 0), False, True) for k, p in _LOOSE.items() for m in p.finditer(text)]
    out = []
    for kind, a, b, base, valid in found:
        value, before, after = text[a:b], text[max(0, a - 48) : a], text[b : b + 48]
        votes = "".join("-0+"[v + 1] for v in (_format(kind, value, valid), _gazetteer(kind, value), _context(kind, before), _boundary(before, after), _digit_pattern(value)))
        k = KINDS.index(kind)
        out.append((k, a, b, base, votes, _features(k, votes, value, before, after)))
    return sorted(out)


def estimate(counts: list[tuple[int, str, int]], rounds: int = 50) -> tuple[dict[str, tuple[float, ...]], dict[tuple[int, str], float]]:
    """EM over counted (kind, votes, n) patterns: how the labelers vote on false and on true candidates, and how likely each pattern is a true one."""
    if not counts:
        return {}, {}
    counts = sorted(counts)
    kind = np.array([c[0] for c in counts])
    vote = np.array([["-0+".index(v) for v in c[1]] for c in counts])
    n = np.array([c[2] for c in counts], dtype=float)
    one_hot = np.eye(3)[vote]  # pattern, labeler, vote
    p = 1 / (1 + np.exp(-1.5 * (vote - 1).sum(axis=1)))
    prior = np.full(len(KINDS), 0.5)
    # pseudo-counts: labelers are taken to be right more often than wrong until the counts say otherwise
    hope = np.array([[1.0, 1.0, 4.0], [4.0, 1.0, 1.0]])
    chance = None
    for _ in range(rounds):
        for k in range(len(KINDS)):
            own = kind == k
            prior[k] = (1 + (n * p)[own].sum()) / (2 + n[own].sum())
        table_ = np.stack([np.einsum("i,ijk->jk", n * q, one_hot) + h for q, h in ((p, hope[0]), (1 - p, hope[1]))])
        chance = table_ / table_.sum(axis=2, keepdims=True)
        logs = np.log(chance)
        yes = np.log(prior[kind]) + np.einsum("ijk,jk->i", one_hot, logs[0])
        no = np.log1p(-prior[kind]) + np.einsum("ijk,jk->i", one_hot, logs[1])
        p = 1 / (1 + np.exp(np.clip(no - yes, -30, 30)))
    reliability = {name: tuple(chance[c, j, v] for c in (0, 1) for v in range(3)) for j, name in enumerate(LABELERS)}
    return reliability, {(c[0], c[1]): float(x) for c, x in zip(counts, p)}


def train(sample: list[tuple[list[int], float, int]], rounds: int = 400) -> np.ndarray:
    """Weights of the logistic span classifier from (features, soft label, n), by accelerated descent with a bound of the curvature a place; ridge 1."""
    w = np.zeros(len(KINDS) + 3 * len(LABELERS) + PLACES)
    if not sample:
        return w
    sample = sorted(sample)  # the sums of floats must not depend on the order of tasks
    at = np.array([x[0] for x in sample])
    target, n = np.array([x[1] for x in sample]), np.array([x[2] for x in sample], dtype=float)
    weight = n / n.sum() * min(n.sum(), 1e4)
    flat, each = at.ravel(), at.shape[1]
    bound = 1 + np.bincount(flat, np.repeat(weight, each), len(w)) * each / 4
    ahead, t = w, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-ahead[at].sum(axis=1)))
        new = ahead - (np.bincount(flat, np.repeat(weight * (p - target), each), len(w)) + ahead) / bound
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, w = new + (last - 1) / t * (new - w), new
    return w


_CANDIDATE = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()), T.StructField("votes", T.StringType()), T.StructField("features", T.ArrayType(T.IntegerType()))]))
_CANDIDATE_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))
_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("probability", T.DoubleType())]))
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("probability", pa.float64())]))


def choose(found: list[dict], weights: np.ndarray) -> list[dict]:
    """The base spans, and the loose ones that the classifier accepts and that overlap neither those nor a likelier one."""
    for x, score in zip(found, weights[np.array([x["features"] for x in found])].sum(axis=1)):
        x["probability"] = float(1 / (1 + np.exp(-score)))
    probability = lambda x: x["probability"]
    out = [x for x in found if x["base"]]
    taken = [(x["start"], x["end"]) for x in out]
    for x in sorted((x for x in found if x["kind"] >= len(BASE_KINDS)), key=lambda x: (-probability(x), x["start"], x["kind"])):
        if probability(x) >= ACCEPT and all(x["end"] <= a or x["start"] >= b for a, b in taken):
            out.append(x)
            taken.append((x["start"], x["end"]))
    out.sort(key=lambda x: (x["kind"], x["start"]))
    return [{"kind": KINDS[x["kind"]], "start": x["start"], "end": x["end"], "base": x["base"], "probability": probability(x)} for x in out]


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, and with pii_spans: array of (kind, start, end, base, probability)."""
    # the other columns travel as one, so that their names cannot meet those used here
    docs = docs.select(F.struct(*[c for c in docs.columns if c not in (text, "pii_spans")]).alias("row"), text)
    others, fields = ["row"], [docs.schema["row"]]

    def find(batches):
        for batch in batches:
            for part in slices(batch, text):
                column = part.column(text)
                may = pc.fill_null(pc.match_substring_regex(column, _MAY_HOLD), False).to_pylist()
                found = [candidates(column[k].as_py()) if ok else [] for k, ok in enumerate(may)]
                rows = [[dict(zip(("kind", "start", "end", "base", "votes", "features"), x)) for x in row] for row in found]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(rows, _CANDIDATE_ARROW)], [*others, "__found"])

    found = keep(docs.mapInArrow(find, T.StructType([*fields, T.StructField("__found", _CANDIDATE)])))
    # equal candidates travel once a task, and the features hold kind and votes
    patterns = keep(found.select(F.explode("__found").alias("x")).groupBy("x.kind", "x.votes", "x.features").count())
    counts = patterns.groupBy("kind", "votes").agg(F.sum("count"), F.count("*")).collect()
    _, likely = estimate([(r[0], r[1], r[2]) for r in counts])
    share = min(1.0, SAMPLE / max(1, sum(r[3] for r in counts)))
    chosen = patterns.where(F.pmod(F.xxhash64("features"), F.lit(1_000_000)) < int(1_000_000 * share)).collect()
    weights = train([(list(r["features"]), likely[r["kind"], r["votes"]], r["count"]) for r in chosen])

    def pick(batches):
        for batch in batches:
            rows = [choose(x, weights) if x else [] for x in batch.column("__found").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(rows, _SPAN_ARROW)], [*others, "pii_spans"])

    return found.mapInArrow(pick, T.StructType([*fields, T.StructField("pii_spans", _SPAN)])).select("row.*", "pii_spans")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("pii_spans")
    written = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(written(F.filter(spans, lambda s: s["base"])), 256).alias("base_sha256"), written(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"))
