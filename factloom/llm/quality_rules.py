"""Quality rules: a table of thresholds compiled into one Spark projection.

`metrics()` gives the counts of a text as Spark columns, `RULES` compares ratios
of them with bounds, and `apply_rules()` puts both into one projection: no user
function, no shuffle, and every ratio is worked out from the whole text.

Defined cases: a null text has no words; texts with fewer than 50 words fail the
base rule; ratios over no words count as 0; repeated rows are judged alike; an empty
table gives an empty result; a very long text is judged whole, at about 200 bytes of
memory a word; other columns of the input stay as they are unless they have the name of
an output column, which is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm._shared import let, table

# Frequent function words of the corpus languages (English, French, German, Spanish).
STOP_WORDS = (
    "a all also an and are as at be been but by can do for from had has have he her his i if in is it its "
    "no not of on or our she so that the their they this to was we were what which will with you "
    "au aux avec ce ces dans de des du elle en est et eux il la le les leur ne nous on ou par pas pour que qui sa se ses son sur un une "
    "als am auf aus bei das dem den der des die ein eine einer er es für ich im ist mit nicht sich sie sind und von war zu zum zur "
    "al como con del el ella en era es esta la las lo los más no para pero por que se si sin su sus un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """Texts whose `metric` is outside [low, high] fail."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are explained in ratios().
RULES = (
    Rule("mean_word_chars", low=2.0, high=16.0),
    Rule("symbols_per_word", high=0.15),
    Rule("bangs_per_word", high=0.15),
    Rule("stop_word_ratio", low=0.004),
    Rule("dup_line_ratio", high=0.4),
    Rule("ellipsis_line_ratio", high=0.3),
)

_WORD_SEP = r"[\x20\x09-\x0D]+"


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _WORD_SEP), "")


def _repeated(words: Column) -> Column:
    """Words covered by a three-word window that the text holds twice or more."""

    def of_windows(windows: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            n = F.size(s)
            pairs = F.zip_with(F.slice(s, F.lit(1), n - 1), F.slice(s, F.lit(2), n - 1), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])))
            return F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))

        def covered(at: Column) -> Column:
            n = F.size(at)
            steps = F.zip_with(F.slice(at, F.lit(1), n - 1), F.slice(at, F.lit(2), n - 1), lambda a, b: F.least(F.lit(3), b - a))
            return F.when(n > 0, F.aggregate(steps, F.lit(3), lambda x, y: x + y)).otherwise(F.lit(0))

        ordered = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(let(ordered, of_sorted), covered))

    n = F.size(words) - 2
    two = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    three = F.zip_with(two, F.slice(words, F.lit(3), n), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n < 2, F.lit(0)).otherwise(let(three, of_windows)).cast("long")


def metrics(text: Column) -> Column:
    """Counts of a text as one struct."""
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        line_counts = let(
            lines,
            lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(F.filter(x, lambda y: y.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*\z"))).cast("long").alias("dots")),
        )
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            line_counts.alias("lines"),
            _repeated(words).alias("n_repeat_words"),
            F.regexp_count(text, F.lit("!")).cast("long").alias("n_bangs"),
            _stop_count(words).alias("n_stops"),
        )

    return let(word_array(text), of_words)


def stop_forms() -> list[str]:
    """The stop words in small, capital and title case, bare and with a mark behind."""
    return sorted({form + mark for w in STOP_WORDS for form in (w, w.title(), w.upper()) for mark in ("", ",", ".", ";", ":", "!", "?")})


def _stop_count(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(stop_forms()))).cast("long")


def ratios(m: Column) -> dict[str, Column]:
    """The ratios that RULES names: word length; symbols, exclamation marks and stop words a word; repeated and ellipsis lines a line."""

    def per(x: Column, n: Column) -> Column:
        return F.when(n > 0, x / n).otherwise(F.lit(0.0))

    return {
        "mean_word_chars": per(m["word_chars"], m["n_words"]),
        "symbols_per_word": per(m["n_symbols"], m["n_words"]),
        "bangs_per_word": per(m["n_bangs"], m["n_words"]),
        "stop_word_ratio": per(m["n_stops"], m["n_words"]),
        "dup_line_ratio": per(m["lines"]["dup"], m["lines"]["all"]),
        "ellipsis_line_ratio": per(m["lines"]["dots"], m["lines"]["all"]),
    }


def judge(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Counts and verdict of a text as one struct.

    The counts are bound to a variable of the expression, so that a filter on the verdict,
    which Spark moves below the projection, works them out once and not once a rule.
    """

    def of_counts(m: Column) -> Column:
        value = ratios(m)
        bad = lambda r: (F.lit(False) if r.low is None else value[r.metric] < r.low) | (F.lit(False) if r.high is None else value[r.metric] > r.high)
        failed = F.array_compact(F.array(*[F.when(bad(r), F.lit(r.metric)) for r in rules])) if rules else F.array().cast("array<string>")
        base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        counts = [m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words")]
        return let(failed, lambda x: F.struct(*counts, m["lines"]["dup"].alias("n_dup_lines"), base.alias("base_failed"), x.alias("failed_rules"), (~base & (F.size(x) == 0)).alias("kept")))

    return let(metrics(text), of_counts)


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with the counts, `base_failed`, `failed_rules` (names) and `kept`."""
    out = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", "kept")
    # the other columns travel as one, so that their names cannot meet the one used here
    others = [c for c in df.columns if c not in out]
    judged = df.select(F.struct(*others).alias("row"), judge(F.col(text), rules).alias("judged"))
    return judged.select(*[F.col("row")[c].alias(c) for c in others], *[F.col("judged")[k].alias(k) for k in out])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))
