"""Operator 4: line-first quality rules, with DataFrame functions only.

Each line is judged by rules of punctuation, navigation and boilerplate; lines that fail are removed; a document that
loses too large a share of its words, or fails a base rule, is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BLANKS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
#: Wording of boilerplate lines, in lower case.
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "javascript is disabled", "log in to", "lorem ipsum", "newsletter",
    "powered by", "privacy policy", "read more", "sign in", "sign up", "skip to content", "terms of service", "terms of use", "we use cookies",
)


def let(value: Column, body) -> Column:
    """body(x) with x bound to value, which is so evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return let(F.btrim(text, F.lit(BLANKS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, GAP)))


def repeat_words(words: Column, width: int = 5) -> Column:
    """Words in windows of `width` words found twice or more, the first included.

    Hashes of windows tell whether any can repeat; only then places are sorted by hash, and equal neighbours compared in full.
    """

    def places(w: Column, h: Column) -> Column:
        rows = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            same = lambda a, b: (a["h"] == b["h"]) & (F.slice(w, a["i"] + 1, width) == F.slice(w, b["i"] + 1, width))
            hit = F.transform(s, lambda x, j: F.when(F.coalesce((j > 0) & same(F.get(s, F.greatest(j - 1, F.lit(0))), x), F.lit(False)) | F.coalesce(same(F.get(s, j + 1), x), F.lit(False)), x["i"]))
            return F.sort_array(F.filter(hit, lambda i: i.isNotNull()))

        return let(rows, again)

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda i, j: F.least(F.coalesce(F.get(at, j + 1) - i, F.lit(width)), F.lit(width)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def hashed(w: Column) -> Column:
        one = F.transform(w, lambda x: F.xxhash64(x))
        gram = lambda c: F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*(F.get(c, i + k) for k in range(width))))
        return let(let(one, gram), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(places(w, h), covered)))

    return let(words, lambda w: F.when(F.size(w) <= width, 0).otherwise(hashed(w))).cast("long")


def boilerplate(text: Column) -> Column:
    def has_any(lower: Column) -> Column:
        out = F.lit(False)
        for phrase in BOILERPLATE:
            out = out | lower.contains(phrase)
        return out

    return let(F.lower(text), has_any)


def line_fails(line: Column, suspect: Column) -> Column:
    """Punctuation: no sentence mark in it, or symbols and shouting marks in more than one of ten characters; navigation: a
    separator for every four words or fewer; boilerplate: wording of pages, asked only where the text (suspect) has any.  A
    line without words never fails."""
    solid = F.length(F.regexp_replace(line, GAP, ""))
    n_words = F.regexp_count(line, F.lit(C.WORD))
    unmarked = ~line.rlike("[.!?…。！？]")
    noisy = F.regexp_count(line, F.lit(r"[#*$%&|<>{}\\^~_=!?]")) * 10 > solid
    navigation = F.regexp_count(line, F.lit(r"[|»›·•→]|>|::")) * 4 >= F.greatest(n_words, F.lit(4))
    return (solid > 0) & (unmarked | noisy | navigation | (suspect & boilerplate(line)))


def lines_fail(text: Column, lines: Column) -> Column:
    """line_fails of each line."""
    return let(boilerplate(text), lambda suspect: F.transform(lines, lambda x: line_fails(x, suspect)))


def quality_rules(df: DataFrame, max_loss: float = 0.5) -> DataFrame:
    """One row per row of df (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lost_words, cleaned.

    Lines are split at line feeds.  Rejected: base_failed (under 10 words, or over 20 % of the words in repeated windows), or
    more than max_loss of the words in lines that fail.  cleaned is the text without those lines.  Null and empty texts have no
    words and are rejected; equal rows each get a row; an empty table gives an empty one; other columns are ignored.
    """
    C.prepare(df.sparkSession)
    text = C.text_col()
    lines = F.split(text, "\n")
    worded = F.filter(lines, lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    facts = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words")))
    split = let(lines, lambda a: let(lines_fail(text, a), lambda bad: F.struct(
        F.array_join(F.filter(a, lambda x, i: ~F.get(bad, i)), "\n").alias("cleaned"),
        F.array_join(F.filter(a, lambda x, i: F.get(bad, i)), "\n").alias("lost"),
    )))
    out = df.select(
        F.col("doc_id").cast("long").alias("doc_id"), facts.alias("facts"), split.alias("split"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(worded, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
    )
    out = out.select("doc_id", "facts.n_words", "facts.word_chars", "n_symbols", "n_dup_lines", "facts.n_repeat_words", F.regexp_count(F.col("split.lost"), F.lit(C.WORD)).cast("long").alias("n_lost_words"), F.col("split.cleaned").alias("cleaned"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~failed & (F.col("n_lost_words") <= max_loss * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "n_lost_words", "cleaned")


def keep_quality(df: DataFrame, max_loss: float = 0.5) -> DataFrame:
    """The rows of df that quality_rules keeps, with df's columns, whatever their names; lines that fail are gone from text."""
    text = C.text_col()

    def judged(w: Column) -> Column:
        """The text without failing lines, or null where the document is rejected."""
        n = F.size(w)
        cleaned = let(F.split(text, "\n"), lambda a: let(lines_fail(text, a), lambda bad: F.array_join(F.filter(a, lambda x, i: ~F.get(bad, i)), "\n")))
        enough = let(cleaned, lambda c: F.when(n - F.regexp_count(c, F.lit(C.WORD)) <= max_loss * n, c))
        return F.when((n >= 10) & (100 * repeat_words(w) <= 20 * n), enough)

    # a row number that the filter asks for keeps the optimizer from working out the text once more in the filter
    cleaned, row = C.free_names(df, "cleaned", "row")
    rows = df.select("*", let(words_of(text), judged).alias(cleaned), F.monotonically_increasing_id().alias(row))
    return rows.where(F.col(cleaned).isNotNull() & (F.col(row) >= 0)).withColumn("text", F.col(cleaned)).select(*df.columns)
