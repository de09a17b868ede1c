"""From page texts to chunks and triples: choice of text source, similarity, repair of JSON, splitting."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from docgraph.functions.session import cut
from docgraph.functions.text import looks_corrupted, once


def normalised(s) -> Column:
    """Without soft hyphens and line-end hyphens, white space collapsed, lower case."""
    x = F.regexp_replace(F.replace(F.coalesce(s, F.lit("")), F.lit("­"), F.lit("")), r"-\s*\n\s*", "")
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; two empty texts are the same.

    Where one text begins with the other, the matcher's first block is the whole shorter one, so the ratio needs no search.
    """

    def one(x: str, y: str) -> float:
        if x.startswith(y) or y.startswith(x):
            return 2.0 * min(len(x), len(y)) / (len(x) + len(y)) if x or y else 1.0
        return difflib.SequenceMatcher(None, x, y).ratio()

    return pd.Series([one(x or "", y or "") for x, y in zip(a, b)])


def ocr_strategy(blocks, chars, spread) -> Column:
    """Image blocks are read alone; a page of under 50 characters that is not blank is read whole."""
    return F.when(blocks > 0, "image_blocks_only").when((chars < 50) & (spread > 40), "full_page_ocr").otherwise("no_ocr")


def choose_text(pages: DataFrame) -> DataFrame:
    """pages (text, ocr, scanned) with similarity, final_text_source, duplicates_merged and final_text.

    Nearly equal texts (0.90, or 0.80 and lengths within 5 %) count as one: the reading where the other looks damaged or the
    page is scanned; different ones are both kept, a space between.
    """
    p = pages.withColumn("reg", F.coalesce(F.trim("text"), F.lit(""))).withColumn("seen", F.coalesce(F.trim("ocr"), F.lit("")))
    both = (F.length("reg") > 0) & (F.length("seen") > 0)
    p = p.withColumn("similarity", F.when(both, sequence_ratio(normalised(F.col("reg")), normalised(F.col("seen")))))
    close = F.abs(F.length("reg") - F.length("seen")) / F.greatest(F.length("reg"), F.lit(1)) <= 0.05
    same = (F.col("similarity") >= 0.90) | ((F.col("similarity") >= 0.80) & close)
    damaged = looks_corrupted(F.col("reg")) & ~looks_corrupted(F.col("seen"))
    source = F.when(both & same, F.when(damaged | F.col("scanned"), "ocr").otherwise("regular")).when(both, "both").when(F.length("reg") > 0, "regular").when(F.length("seen") > 0, "ocr").otherwise("none")
    p = p.withColumn("final_text_source", source).withColumn("duplicates_merged", F.coalesce(both & same, F.lit(False)))
    final = F.when(F.col("final_text_source") == "both", F.concat_ws(" ", "reg", "seen")).when(F.col("final_text_source") == "ocr", F.col("seen")).otherwise(F.col("reg"))
    return p.withColumn("final_text", final).drop("reg", "seen")


def length_report(pages: DataFrame) -> DataFrame:
    """(source, pages, mismatches): final texts whose length is not what their source says; both allows up to two more."""
    want = F.when(F.col("final_text_source") == "regular", F.length("text")).when(F.col("final_text_source") == "ocr", F.length("ocr")).when(F.col("final_text_source") == "both", F.length("text") + F.length("ocr")).otherwise(0)
    off = F.length("final_text") - want
    bad = F.when(F.col("final_text_source") == "both", ~off.between(0, 2)).otherwise(off != 0)
    return pages.groupBy(F.col("final_text_source").alias("source")).agg(F.count("*").alias("pages"), F.count_if(bad).alias("mismatches"))


def missing_numbers(ids: DataFrame, column: str) -> DataFrame:
    """(n, state): whole numbers from 1 to the largest id that are missing, and ids under 1."""
    top = ids.agg(F.coalesce(F.max(F.col(column).cast("long")), F.lit(0))).first()[0]
    want = ids.sparkSession.range(1, max(top, 0) + 1).select(F.col("id").alias("n"))  # ranges over tasks, no array
    have = ids.select(F.col(column).cast("long").alias("n")).distinct()
    return want.join(have, "n", "left_anti").withColumn("state", F.lit("missing")).unionByName(have.where("n < 1").withColumn("state", F.lit("extra")))


def _repair(text: str | None) -> str | None:
    """The first balanced JSON value in a text, fences and trailing commas aside; null if none parses."""
    t = re.sub(r"```(?:json)?", "", text or "")
    for opening in re.finditer(r"[{\[]", t):
        depth, quoted, skip = 0, False, False
        for i in range(opening.start(), len(t)):
            c = t[i]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "{[":
                depth += 1
            elif c in "}]":
                depth -= 1
                if not depth:
                    try:
                        return json.dumps(json.loads(re.sub(r",\s*([}\]])", r"\1", t[opening.start() : i + 1])), ensure_ascii=False, sort_keys=True)
                    except ValueError:
                        break
    return None


@F.pandas_udf(StringType())
def repaired_json(s: pd.Series) -> pd.Series:
    """Model output as plain JSON, ready for from_json."""
    return s.map(_repair)


def halves(s) -> Column:
    """A text in two, at the break nearest its middle: blank line, line, sentence or space, in that order within a quarter of it."""

    def middle(t, n):
        mid, reach = F.shiftright(n, 1), F.greatest(F.lit(1), F.shiftright(n, 2))
        start = F.greatest(F.lit(0), mid - reach)

        def at(w):
            found = []
            for mark in ("\n\n", "\n", ". ", " "):
                before = F.when(F.contains(w["before"], F.lit(mark)), F.length(F.substring_index(w["before"], mark, -1)) + len(mark))
                after = F.nullif(F.instr(w["after"], mark), F.lit(0)) - 1
                found.append(F.when(before <= F.coalesce(after, before), mid - before).otherwise(mid + after) + len(mark))
            return F.coalesce(*found, mid)

        return once(F.struct(F.substring(t, start + 1, mid - start).alias("before"), F.substring(t, mid + 1, reach).alias("after")), at)

    def two(t):
        return once(F.length(t), lambda n: once(middle(t, n), lambda at: F.array(F.substring(t, F.lit(1), at), F.substring(t, at + 1, n))))

    return once(F.coalesce(F.col(s) if isinstance(s, str) else s, F.lit("")), two)


def split_and_retry(items: DataFrame, work, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Runs `work` (a DataFrame function that adds `error`) on items (id, text); what fails is halved and tried again.

    Parts are named id::part1 and id::part2. Returns the rows that worked and those that failed to the end. Each level is
    kept, so work is done once for each part.
    """
    done, left = None, items
    for level in range(depth + 1):
        out = cut(work(left))
        good, bad = out.where("error is null"), out.where("error is not null")
        done = good if done is None else done.unionByName(good)
        if level < depth:
            parts = bad.select(*[c for c in items.columns if c not in ("id", "text")], "id", F.posexplode(halves("text")).alias("k", "text"))
            left = parts.withColumn("id", F.concat("id", F.lit("::part"), (F.col("k") + 1).cast("string"))).select(*items.columns)
    return done, bad
