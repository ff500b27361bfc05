"""Line-first quality rules, in built-in SQL functions only.

Every line is judged by itself (punctuation, navigation, boilerplate); failing
lines are removed, and a document that loses too large a share of its words is
rejected.  All work happens inside the row of the document: no shuffle, no
Python, memory bounded by one text.

Defined cases: a null or blank text has no words and is rejected by the base
rule; texts of any length are judged whole; repeated rows are judged alike,
one by one; an empty table gives an empty table; extra input columns are
ignored by :func:`judge` and kept by :func:`keep_good`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import SPACE, let

# The symbols the contract counts, the marks that end a sentence.
SYMBOLS = "#*$%&|<>"
SENTENCE_END = "[.!?…。！？][\"'”’»)\\]]*([\\x20\\x09-\\x0D]|$)"
# Phrases of lines that belong to the site and not to the text.
BOILERPLATE = ("all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy", "use of cookies", "accept cookies",
               "enable javascript", "javascript is disabled", "javascript is required", "lorem ipsum", "creative commons", "copyright (c)", "copyright ©",
               "copyright 19", "copyright 20", "subscribe to our", "sign up for", "click here to", "skip to content", "skip to main content")


@dataclass(frozen=True)
class Rules:
    """Thresholds; the first four are fixed by the base rule, the rest belongs to the line rules."""

    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    symbols_per_word: float = 0.25  # navigation bars, tables of links, symbol noise
    shouts_per_word: float = 0.25  # words followed by two exclamation marks
    short_line: int = 5  # without a sentence end such a line is a label or a menu entry
    words_per_sentence: int = 100  # a longer line needs a sentence end in as many words
    max_lost_share: float = 0.5


def symbols_in(text: Column) -> Column:
    """How many characters are one of ``SYMBOLS``: one byte search for each of them."""
    return reduce(lambda a, b: a + b, [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in SYMBOLS])


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def repeated_words(words: Column, window: int) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the text.

    Windows are compared by 64-bit hashes within one text; only a text in which
    a window recurs is sorted to find the places.
    """

    def covered(hashes: Column) -> Column:
        places = let(
            F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda s: F.sort_array(F.transform(
                F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]).eqNullSafe(True) | (F.get(s, k + 1)["h"] == x["h"]).eqNullSafe(True)),
                lambda x: x["i"],
            )),
        )
        steps = let(places, lambda p: F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda x, y: F.least(F.lit(window), F.coalesce(y - x, F.lit(window)))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def count(hashed: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(hashed) - window + 1), lambda i: F.xxhash64(F.slice(hashed, i, window)))
        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > window, let(hashed, count)).otherwise(F.lit(0))


def bad_line(line: Column, n: Column, rules: Rules) -> Column:
    """True for a line of ``n`` words that the punctuation, navigation or boilerplate rule removes."""

    def few(ends: Column) -> Column:
        return F.when(n < rules.short_line, ends == 0).otherwise(ends * rules.words_per_sentence < n)

    punctuation = let(F.regexp_count(line, F.lit(SENTENCE_END)), few)
    shouting = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit("!!"), F.lit("!")))) > rules.shouts_per_word * n
    navigation = symbols_in(line) > rules.symbols_per_word * n
    boilerplate = let(F.lower(line), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in BOILERPLATE]))
    return punctuation | shouting | navigation | boilerplate


def measure(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``docs`` with one struct column ``judged`` (see :func:`judge`)."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = words_of(body)
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)

    def of_lines(ls: Column) -> Column:
        good = lambda line: let(F.size(words_of(line)), lambda n: F.when(bad_line(line, n, rules), F.lit(0)).otherwise(n))
        return let(F.array_distinct(ls), lambda kinds: F.struct(
            (F.size(ls) - F.size(kinds)).cast("long").alias("n_dup_lines"),
            F.aggregate(F.transform(kinds, good), F.lit(0), lambda total, x: total + x).cast("long").alias("good_words"),
        ))

    def of_words(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
                        repeated_words(ws, rules.window).cast("long").alias("n_repeat_words"))

    facts = F.struct(
        let(words, of_words).alias("w"), let(lines, of_lines).alias("l"),
        symbols_in(body).cast("long").alias("n_symbols"),
    )

    def verdict(x: Column) -> Column:
        n = x["w"]["n_words"]
        failed = (n < rules.min_words) | (100 * x["w"]["n_repeat_words"] > rules.max_repeat_percent * n)
        lost = n - x["l"]["good_words"]
        return F.struct(
            n.alias("n_words"), x["w"]["word_chars"].alias("word_chars"), x["n_symbols"].alias("n_symbols"), x["l"]["n_dup_lines"].alias("n_dup_lines"),
            x["w"]["n_repeat_words"].alias("n_repeat_words"), lost.alias("n_lost_words"), failed.alias("base_failed"),
            (~failed & (lost <= rules.max_lost_share * n)).alias("kept"),
        )

    return docs.withColumn("judged", let(facts, verdict))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per document: counts, the base rule and the verdict of the line rules.

    ``n_lost_words``: words in removed lines; a copy of an earlier line is removed too.
    """
    return measure(docs.select(F.col(key), F.col(text)), text, rules).select(key, "judged.*")


def clean_text(text: Column, rules: Rules = Rules()) -> Column:
    """The text without the lines that the rules remove (blank and repeated lines stay)."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: (F.length(F.btrim(x, F.lit(SPACE))) == 0) | ~bad_line(x, F.size(words_of(x)), rules)), "\n")


def keep_good(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, unchanged and with all their columns."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    held = docs.select(F.struct(*columns).alias("row"), F.col(text).alias("text"))
    return measure(held, "text", rules).where("judged.kept").select("row.*")
