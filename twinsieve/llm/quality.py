"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.text import let
from twinsieve.llm.common import WORD, text_of, words


class Rule(NamedTuple):
    """Keep documents whose measure lies between the bounds (inclusive)."""

    measure: str
    low: float | None
    high: float | None


#: Frequent function words of the languages in the corpus. Fixed values.
STOP_WORDS = ("the", "of", "and", "to", "in", "de", "la", "le", "et", "les", "der", "die", "und", "das", "el", "los", "que", "en", "y")

RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.30),
    Rule("dup_line_ratio", None, 0.50),
    Rule("stop_word_ratio", 0.005, None),
)

GRAM = 5


def _covered(starts: Column) -> Column:
    """Words covered by windows at these ascending starts."""
    return let(starts, lambda p: F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(GRAM), F.coalesce(F.get(p, j + 1) - x, F.lit(GRAM)))), F.lit(0), lambda a, b: a + b))


def _twins(entries: Column) -> Column:
    """Ascending places ``i`` of the entries ``(g, i)`` whose ``g`` comes twice or more."""
    def places(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["g"] == x["g"], F.lit(False))
        return F.filter(F.transform(s, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"])), lambda i: i.isNotNull())

    return F.sort_array(let(F.sort_array(entries), places))


def _repeat_words(ws: Column) -> Column:
    """Words in windows found twice or more.

    Hashes tell which windows may come twice, in most texts none; the words of those alone are compared.
    """
    def by_words(places: Column) -> Column:
        gram = lambda i: F.concat_ws(" ", *[F.get(ws, i + j) for j in range(GRAM)])
        return _covered(_twins(F.transform(places, lambda i: F.struct(gram(i).alias("g"), i.alias("i")))))

    def by_hash(h: Column) -> Column:
        places = _twins(F.transform(h, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(places, by_words))

    last = F.size(ws) - GRAM
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(GRAM)]))
    return F.when(last < 0, 0).otherwise(let(hashes, by_hash))


def _lines(t: Column) -> Column:
    """\\n-split lines that hold a word and equal an earlier line, and all lines that hold a word."""
    full = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    return let(full, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))


def measures(t: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """One struct with the counts of a text. Words are split once per row."""
    stops = r"(?<![^\x20\x09-\x0D])(?i:" + "|".join(stop_words) + r")(?![^\x20\x09-\x0D.,;:!?])"
    return let(words(t), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _lines(t).alias("lines"),
        _repeat_words(ws).cast("long").alias("n_repeat_words"),
        F.regexp_count(t, F.lit(stops)).cast("long").alias("n_stop_words"),
    ))


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, stop_words: Sequence[str] = STOP_WORDS, carry: str | None = None) -> DataFrame:
    """Counts, ratios and verdict of every document, in one projection of the scan without a shuffle.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``, one
    column for each measure that the rules name, and the column named in ``carry``. ``base_failed``: fewer than 10 words, or more than
    20% of the words in repeated windows. ``kept`` is false if ``base_failed`` or a rule's bound is passed. A
    null text has no words and fails; ratios of an empty text are 0. Rows are judged one by one, so repeated
    rows give repeated verdicts and null ids stay null. Other columns are ignored.
    """
    m = docs.select(F.col("doc_id"), *([F.col(carry).alias("_carry")] if carry else []), measures(text_of(), stop_words).alias("_m"))
    n, n_lines = F.col("_m.n_words"), F.col("_m.lines.n_lines")
    per_word = lambda c: F.when(n > 0, F.col(f"_m.{c}") / n).otherwise(F.lit(0.0))
    ratios = {
        "n_words": n, "mean_word_chars": per_word("word_chars"), "symbol_ratio": per_word("n_symbols"),
        # one stop word more than found, so that a short text is not judged by chance
        "stop_word_ratio": F.when(n > 0, (F.col("_m.n_stop_words") + 1) / n).otherwise(F.lit(0.0)),
        "dup_line_ratio": F.when(n_lines > 0, F.col("_m.lines.n_dup_lines") / n_lines).otherwise(F.lit(0.0)),
        "repeat_ratio": per_word("n_repeat_words"),
    }
    failed = (n < 10) | (F.col("_m.n_repeat_words") * 100 > n * 20)
    verdict = ~failed
    for rule in rules:
        if rule.low is not None:
            verdict = verdict & (ratios[rule.measure] >= rule.low)
        if rule.high is not None:
            verdict = verdict & (ratios[rule.measure] <= rule.high)
    return m.select(
        "doc_id", n.alias("n_words"), F.col("_m.word_chars").alias("word_chars"), F.col("_m.n_symbols").alias("n_symbols"),
        F.col("_m.lines.n_dup_lines").cast("long").alias("n_dup_lines"), F.col("_m.n_repeat_words").alias("n_repeat_words"),
        failed.alias("base_failed"), verdict.alias("kept"),
        *[ratios[r].alias(r) for r in dict.fromkeys(rule.measure for rule in rules) if r != "n_words"],
        *([F.col("_carry").alias(carry)] if carry else []),
    )
