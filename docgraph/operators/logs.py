"""Mining run logs kept as whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(text, patterns: list[str], group: int = 1) -> Column:
    """The group of the first pattern in the list that matches."""
    return F.coalesce(*[F.when(text.rlike(p), F.regexp_extract(text, p, group)) for p in patterns])


def last_match(text, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def sum_matches(text, pattern: str, group: int = 1) -> Column:
    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x.try_cast("long"), F.lit(0)))


def question_id(path) -> Column:
    return F.regexp_extract(path, r"_id(\d+)_", 1).try_cast("long")


def lines(logs: DataFrame, key: str, text: str = "value") -> DataFrame:
    return logs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "content"))


def with_iteration(rows: DataFrame, key: str, header: str = r"\[Iter (\d+)/\d+\]") -> DataFrame:
    """rows of lines with iteration: that of the latest header line, 1 before any."""
    at = F.regexp_extract("content", header, 1).try_cast("long")
    return rows.withColumn("iteration", F.coalesce(F.last(at, ignorenulls=True).over(Window.partitionBy(key).orderBy("line")), F.lit(1)).cast("long"))


def sections(logs: DataFrame, key: str, header: str, text: str = "value") -> DataFrame:
    """The parts of each text between headers, the one before the first header included."""
    return logs.select(key, F.posexplode(F.split(text, header)).alias("section", "content"))


def between(text, start: str, end: str) -> Column:
    """What follows the first `start` up to the next `end` or the end of the text; null where there is no start."""
    return F.when(text.rlike(start), F.regexp_extract(text, f"(?s){start}(.*?)(?:{end}|\\z)", 1))


def tagged(rows: DataFrame, tag: str) -> DataFrame:
    """The lines that carry a tag."""
    return rows.where(F.col("content").contains(tag))
