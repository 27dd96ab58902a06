"""Texts to atomic claims: sentences, then conjuncts, then what can be verified. All columns, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import let, trim

# Words that make a clause of a fragment.
VERBS = (
    "is are was were be been being do does did use uses used using have has had run runs ran running "
    "deploy deploys deployed cost costs lead leads led support supports supported require requires required "
    "include includes included offer offers offered generate generates generated schedule schedules scheduled "
    "send sends sent work works worked choose chooses chose chosen add adds added hash hashes hashed store stores stored "
    "expire expires expired encrypt encrypts encrypted slip slips slipped ship ships shipped build builds built "
    "handle handles handled process processes processed collect collects collected limit limits limited "
    "make makes made provide provides provided lives live"
).split()

_MARK = "\u0001"


def sentences(text: Column) -> Column:
    """Sentences by a rule: a break behind . ! ? (and closing quotes or brackets) before white space, and at line ends."""
    marked = F.regexp_replace(F.regexp_replace(text, r"""([.!?]["')\]]*)\s+""", "$1" + _MARK), r"\n+", _MARK)
    return F.filter(F.transform(F.split(marked, _MARK), trim), lambda s: s != "")


def is_verifiable(s: Column) -> Column:
    """At least three characters and two words, and no question."""
    return (F.length(s) >= 3) & ~s.endswith("?") & (F.size(F.split(trim(s), r"\s+")) >= 2)


def has_verb(s: Column) -> Column:
    return F.exists(F.regexp_extract_all(s, F.lit(r"[A-Za-z'-]+"), F.lit(0)), lambda w: F.lower(w).isin(VERBS))


def subject_prefix(s: Column) -> Column:
    """The words up to and with the first verb, or ''."""

    def cut(words: Column) -> Column:
        at = F.array_position(F.transform(words, lambda w: F.lower(F.regexp_replace(w, "[^A-Za-z]", "")).isin(VERBS)), True)
        return F.when(at > 0, F.array_join(F.slice(words, F.lit(1), at.cast("int")), " ")).otherwise(F.lit(""))

    return let(F.filter(F.split(s, r"\s+"), lambda w: w != ""), cut)


def conjuncts(s: Column) -> Column:
    """The parts around "and"; parts without a verb get the first one's subject and verb. The whole sentence, if a part still has none."""

    def of_parts(parts: Column) -> Column:
        def with_prefix(prefix: Column) -> Column:
            filled = F.transform(parts, lambda p, i: F.when((i == 0) | has_verb(p), p).otherwise(F.when(prefix == "", p).otherwise(F.concat(prefix, F.lit(" "), p))))
            return let(filled, lambda x: F.when(F.forall(x, has_verb), x).otherwise(F.array(s)))

        return F.when(F.size(parts) < 2, F.array(s)).otherwise(let(subject_prefix(parts[0]), with_prefix))

    return let(F.filter(F.transform(F.split(s, r"(?i)\s*,?\s+and\s+"), trim), lambda p: p != ""), of_parts)


def claims(text: Column) -> Column:
    """The claims of a text; if none can be verified, the whole text; none of an empty text."""

    def of_text(t: Column) -> Column:
        found = F.filter(F.transform(F.flatten(F.transform(sentences(t), conjuncts)), trim), is_verifiable)
        return let(found, lambda x: F.when(t == "", F.array().cast("array<string>")).when(F.size(x) > 0, x).otherwise(F.array(t)))

    return let(trim(F.coalesce(text, F.lit(""))), of_text)


def decompose(answers: DataFrame, text: str = "text") -> DataFrame:
    """(answer_id, claim_id, claim) of answers (answer_id, text)."""
    return answers.select("answer_id", F.posexplode(claims(F.col(text))).alias("claim_id", "claim"))
