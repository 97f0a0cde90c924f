"""Quality rules: a threshold table compiled into one projection, without user functions.

Each rule is a ratio of two text statistics with a lower and an upper bound.
`RULES` is the table; `compile_rules` turns any such table into one boolean per
rule, and `quality_rules` adds statistics, failed rules and the verdict in a
single map-only pass: no shuffle, one scan of `text`.

Defined cases: a null or empty text has no words, no lines with a word, and fails
the base rule; a text of any length is judged whole (arrays of its own words
only); equal rows get equal verdicts; a null or unlisted language, or no such column, is exempt from the share of function
words; an empty table stays empty; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import SPACE_RUN, SPACES, gram_hashes, split_words, whole

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Frequent function words by language.
STOP_WORDS = {
    "en": "the of and to in is that it for on was be with as this by are a".split(),
    "de": "der die das und in den von zu mit ist auf ein eine für im dem".split(),
    "fr": "le la les de et des un une est en que du pour dans qui sur".split(),
    "es": "el los las que y en un una por con para del se no su lo".split(),
}
STOP_TEXT_WORDS = 40      # shorter texts need no function words
PUNCTUATION = ".,;:!?\"'()[]{}-"


@dataclass(frozen=True)
class Rule:
    """`low <= top / bottom <= high`; an open side is None."""

    name: str
    top: str
    bottom: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 1.5, 25.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.3),
    Rule("bangs_per_word", "n_bangs", "n_words", None, 0.3),
    Rule("stop_words", "n_stop_or_exempt", "n_words", 0.02, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
)


def compile_rules(rules: tuple[Rule, ...], stats: dict[str, Column]) -> Column:
    """Names of the rules that the statistics break, as an array."""
    broken = []
    for rule in rules:
        ratio = stats[rule.top] / F.greatest(stats[rule.bottom], F.lit(1))
        sides = []
        if rule.low is not None:
            sides.append(ratio < F.lit(float(rule.low)))
        if rule.high is not None:
            sides.append(ratio > F.lit(float(rule.high)))
        test = sides[0] if len(sides) == 1 else sides[0] | sides[1]
        broken.append(F.when(test, F.lit(rule.name)))
    return F.array_compact(F.array(*broken))


def _count_of(text: Column, kept: str) -> Column:
    """How many characters of the class `kept` (given as the class of all others) the text has."""
    return F.char_length(F.regexp_replace(text, kept, "")).cast("long")


def stop_list(lang: Column) -> Column:
    """The function words of a language, null if there is no list."""
    lists = F.lit(None).cast("array<string>")
    for name, words in STOP_WORDS.items():
        lists = F.when(lang == name, F.array(*[F.lit(w) for w in words])).otherwise(lists)
    return lists


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",),
                  text: str = "text", lang: str = "lang") -> DataFrame:
    """Columns `keep`, the statistics, `base_failed`, `broken_rules` and `kept` of every row."""
    body = F.col("__text")
    words, grams, lines = F.col("__words"), F.col("__grams"), F.col("__lines")
    n = F.size(words)
    language = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    rows = docs.select(*keep, whole(text).alias("__text"), stop_list(language).alias("__stop"))
    rows = rows.select(*keep, body, "__stop", split_words(body, SPACE_RUN).alias("__words"),
                       F.filter(F.split(body, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "").alias("__lines"))
    rows = rows.withColumn("__grams", gram_hashes(words, WINDOW))
    # Windows that occur twice: neighbours in the order of their hashes. Only texts that have some are sorted.
    rows = rows.withColumn("__sorted", F.when(
        F.size(F.array_distinct(grams)) < F.size(grams),
        F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    order = F.col("__sorted")
    rows = rows.withColumn("__again", F.sort_array(F.transform(
        F.filter(order, lambda x, j: (F.get(order, j - 1)["h"] == x["h"]) | (F.get(order, j + 1)["h"] == x["h"])),
        lambda x: x["i"])))
    again = F.col("__again")
    covered = F.aggregate(F.transform(again, lambda p, j: F.coalesce(F.least(F.get(again, j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
                          F.lit(0), lambda a, x: a + x)
    stats = F.struct(
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _count_of(body, r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        _count_of(body, r"[^!]+").alias("n_bangs"),
        F.when(F.col("__stop").isNotNull(), F.size(F.filter(words, lambda w: F.array_contains(
            F.col("__stop"), F.btrim(F.lower(w), F.lit(PUNCTUATION)))))).cast("long").alias("n_stop_words"),
    )
    # Unrolling one row changes nothing but that a filter on a statistic or the verdict stays above: pushed
    # below, it would nest the steps into each other and compute each of them anew for every word.
    rows = rows.select(*keep, F.explode_outer(F.array(stats)).alias("__stats")).select(*keep, "__stats.*")
    # Short texts and languages without a list are exempt from the share of function words.
    judged = F.col("n_stop_words").isNotNull() & (F.col("n_words") > STOP_TEXT_WORDS)
    stats = {c: F.col(c) for c in rows.columns} | {
        "n_stop_or_exempt": F.when(judged, F.col("n_stop_words")).otherwise(F.greatest(F.col("n_words"), F.lit(1)))}
    rows = rows.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        "broken_rules": compile_rules(rules, stats),
    })
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that pass, with their own columns only."""
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    language = F.col(f"`{lang}`").cast("string") if lang in docs.columns else F.lit(None).cast("string")
    judged = quality_rules(docs.select(whole_row, F.col(f"`{text}`").alias("__body"), language.alias("__lang")), rules,
                           keep=("__row",), text="__body", lang="__lang")
    return judged.where("kept").select("__row.*")
