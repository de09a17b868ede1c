"""Files in and out through Spark's readers and writers, so any store Spark reaches will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Text columns of a CSV with header; quoted line breaks stay, and a byte-order mark leaves the first name."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_jsonl(spark: SparkSession, path, schema) -> DataFrame:
    """Line JSON, plain or gz; lines that do not parse are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_documents(spark: SparkSession, path, schema=None) -> DataFrame:
    """One JSON object per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_logs(spark: SparkSession, path) -> DataFrame:
    """(path, value): one row per log file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def write_runs(lines: DataFrame, path: str, run: str = "run", line: str = "value", runs: int = 1000) -> None:
    """The lines of many runs as text files of up to so many runs each, so that their number does not grow with short runs.

    A run is a line `==> its name` and its lines, each indented by a space. Null lines are left out, and so is a null name's
    run; names have no line breaks. A run's log is one row here and when read.
    """
    log = F.array_join(F.collect_list(F.regexp_replace(F.concat(F.lit(" "), line), "\n", "\n ")), "\n")
    rows = lines.where(F.col(run).isNotNull()).groupBy(run).agg(log.alias("log"))
    rows.select(F.concat(F.lit("==> "), run, F.lit("\n"), "log").alias("value")).write.option("maxRecordsPerFile", runs).text(path)


def read_runs(spark: SparkSession, path) -> DataFrame:
    """(path, run, value): one row per run of the log files that `write_runs` or a like writer made, with its whole text."""
    part = F.explode(F.split("value", "(?md)^==> ")).alias("part")
    name = F.substring_index("part", "\n", 1)
    text = F.substr("part", F.length(name) + 2)
    return read_logs(spark, path).select("path", part).where("part <> ''").select("path", name.alias("run"), F.regexp_replace(text, "(?md)^ |\n\\z", "").alias("value"))


def newest(files: DataFrame) -> DataFrame:
    """Of (path, modified, ...) the newest file's rows."""
    return files.join(files.agg(F.max_by("path", "modified").alias("path")), "path", "left_semi")


def score(x) -> Column:
    """A score cell as a number; blank or bad is -1."""
    return F.coalesce(F.trim(x).try_cast("int"), F.lit(-1))


def fixed_columns(df: DataFrame, columns: list[str], missing: str = "N/A") -> DataFrame:
    """These columns in this order, as text; absent ones and nulls hold `missing`."""
    return df.select(*[(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(missing)) if c in df.columns else F.lit(missing)).alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    fixed_columns(df, columns, "").write.csv(path, header=True, quoteAll=True, escape='"', mode="overwrite")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path, mode="overwrite", ignoreNullFields=False)


def split_failures(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error."""
    return df.where(F.col(error).isNull()), df.where(F.col(error).isNotNull())


def merge_parts(parts: list[DataFrame]) -> DataFrame:
    """All rows under the union of their headers."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def typed_order(id_col: str) -> list[Column]:
    """Sort keys: numbers by value, then other ids as text, missing last."""
    c = F.col(id_col)
    return [c.isNull(), c.try_cast("bigint").asc_nulls_last(), c]


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """df with safe_name: later rows of a name get __1, __2 ... before nothing else changes."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return df.withColumn("safe_name", F.when(n == 0, F.col(name)).otherwise(F.concat_ws("__", F.col(name), n.cast("string"))))


def links(html) -> Column:
    """The distinct href values of a page, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), F.lit(1)))


def title(html) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), F.lit(""))


def listed(pages: DataFrame, order: str, links: Column) -> DataFrame:
    """(order, link): the links of list pages up to the first page without any, each link where it comes first."""
    p = pages.select(F.col(order), links.alias("links"))
    end = p.where(F.size("links") == 0).agg(F.min(order).alias("end"))
    some = p.join(F.broadcast(end), F.col("end").isNull() | (F.col(order) < F.col("end"))).select(order, F.posexplode("links").alias("at", "link"))
    return some.groupBy("link").agg(F.min(F.struct(order, "at")).alias("x")).select(F.col(f"x.{order}").alias(order), "link")


def expanded(spark: SparkSession, pattern: str, recursive: bool = False) -> DataFrame:
    """(path, modified, length) of the files that a path or glob names, in any store Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(pattern)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")
