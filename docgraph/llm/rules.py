"""Line-first quality rules, in DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import SPACE

# What closes a sentence, phrases of page furniture, and marks that count as symbols.
TERMINAL = r"""[.!?:;)"'\x{2019}\x{201D}\x{2026}\x{3002}\x{FF01}\x{FF1F}][\x20\x09-\x0D]*$"""
BOILERPLATE = r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie policy|use of cookies|enable javascript|lorem ipsum|powered by|sign up for|subscribe to our|click here|read more|share this|copyright \(c\))"
NAVIGATION = r"(?i)^[\x20\x09-\x0D]*(home|menu|log ?in|sign ?in|register|search|next|previous|back to top|skip to content|contact us|about us|sitemap)[\x20\x09-\x0D.!>|]*$"
SYMBOL = r"[#*$%&|<>]"
# One word five times in a row.
REPEATED = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)(?:[\x20\x09-\x0D]+\1){4}(?![^\x20\x09-\x0D])"


def _line_fails(line) -> F.Column:
    """Whether a line of any length is not prose: few words without a closing mark, a menu, page furniture, symbols, shouting,
    8 words or more of which at most a third are distinct, or one word five times in a row."""

    def fails(words) -> F.Column:
        n = F.size(words)
        return (
            ((n < 10) & ~line.rlike(TERMINAL))
            | line.rlike(NAVIGATION)
            | line.rlike(BOILERPLATE)
            | (line.rlike(SYMBOL) & (F.regexp_count(line, F.lit(SYMBOL)) * 10 >= n))
            | ((n >= 4) & ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}"))
            | ((n >= 8) & (F.size(F.array_distinct(words)) * 3 <= n))
            | ((n >= 5) & line.rlike(REPEATED))
        )

    # the array of one array names the words, so that a line is split once
    return F.exists(F.array(F.array_remove(F.split(line, SPACE), "")), fails)


def assess(docs: DataFrame, loses_at_most: float = 0.3) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines,
    n_bad_lines, lost, kept and cleaned.

    Words are non-space runs. n_dup_lines: lines with a word that equal an earlier one; n_repeat_words: words in 3-word
    windows found twice or more in the text. Lines failing a rule are removed first (cleaned: the others); kept is false
    where over `loses_at_most` of the lines' characters went, or where the base fails: under 50 words, or over half of
    them repeated. Null and empty texts have no words, so they are not kept. Windows are compared by 64-bit hashes.
    Other columns are ignored; repeated rows keep a row each. No shuffle, no Python.
    """
    t = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    t = t.withColumn("w", F.filter(F.split("text", SPACE), lambda w: w != "")).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # most texts repeat no window at all; only the others are sorted, with places, to find which words do
    t = t.withColumn("h", F.expr("if(size(w) >= 3, transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])), array())"))
    t = t.withColumn("s", F.expr("if(size(array_distinct(h)) < size(h), array_sort(transform(h, (x, i) -> named_struct('h', x, 'p', i))), array())"))
    t = t.withColumn("p", F.expr("filter(transform(s, (x, i) -> if(i > 0 and s[i - 1].h = x.h or i + 1 < size(s) and s[i + 1].h = x.h, x.p, -1)), p -> p >= 0)"))
    t = t.withColumn("bad", F.filter("lines", _line_fails)).withColumn("size", F.expr("aggregate(lines, 0L, (a, x) -> a + length(x))"))
    t = t.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(F.flatten(F.transform("p", lambda p: F.array(p, p + 1, p + 2))))).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("bad").cast("long").alias("n_bad_lines"),
        F.expr("aggregate(bad, 0L, (a, x) -> a + length(x))").alias("lost"),
        "size",
        "lines",
    )
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    t = t.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("lost") <= F.col("size") * F.lit(loses_at_most)))
    return t.withColumn("cleaned", F.array_join(F.filter("lines", lambda x: ~_line_fails(x)), "\n")).drop("size", "lines")


def clean(docs: DataFrame, loses_at_most: float = 0.3) -> DataFrame:
    """(doc_id, text) of the kept documents, without their failing lines. Null and empty texts are not kept; repeated rows stay."""
    return assess(docs, loses_at_most).where("kept").select("doc_id", F.col("cleaned").alias("text"))
