"""Windows, groups, batches and bins."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions.session import cut


def token_windows(n, most: int = 1024, least: int = 512, overlap: int = 256) -> Column:
    """Windows (start, end) over n tokens: up to `most` each, `most - overlap` apart, the last one moved back to hold `least`."""
    stride = most - overlap
    k = F.greatest(F.lit(0), F.ceil((n - most) / stride)).cast("int")  # windows before the last
    last = k * stride
    moved = F.greatest(n - most, last - stride + overlap)
    shorter = F.when(moved <= n - least, moved).otherwise(n - least)
    last = F.when((n - last < least) & (k > 0), F.greatest(shorter, last - stride + 1)).otherwise(last)
    starts = F.concat(F.transform(F.filter(F.sequence(F.lit(0), k), lambda i: i < k), lambda i: i * stride), F.array(last.cast("int")))
    windows = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + most, n.cast("int")).alias("end")))
    return F.when(n > 0, windows).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def pages_of_windows(docs: DataFrame, pages: DataFrame, size: int) -> DataFrame:
    """(doc_id, chunk_index, pages): of each window of `size` characters the pages it touches, comma-joined; '1' if none.

    docs (doc_id, n_chars), pages (doc_id, page, start, n). A page goes to the windows that its own characters reach, so
    the interval join is an equality join by window.
    """
    i = F.col("chunk_index")
    windows = docs.select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_chars") / size))).alias("chunk_index"))
    touched = F.sequence(F.floor(F.col("start") / size), F.floor(F.greatest(F.col("start") + F.col("n") - 1, F.col("start")) / size))
    hit = pages.select("doc_id", "page", "start", "n", F.explode(touched).alias("chunk_index")).where(i * size < F.col("start") + F.col("n"))
    hit = windows.join(hit, ["doc_id", "chunk_index"], "left").withColumn("page", F.when(F.least((i + 1) * size, F.col("n_chars")) > F.col("start"), F.col("page")))
    hit = hit.groupBy("doc_id", "chunk_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page")), lambda x: x.cast("string")), ",").alias("pages"))
    return hit.withColumn("pages", F.when(F.col("pages") == "", "1").otherwise(F.col("pages")))


def running(df: DataFrame, order: list[Column], value: Column, out: str, by: tuple[str, ...] = (), slices: int | None = None) -> DataFrame:
    """df with `out`: the running sum of value, itself included, in order over the whole table or over each group of `by`.

    Rows are dealt into ranges of the order and summed within each; ranges' totals, a row each and group, are summed before
    them. So no task sees the whole table, nor a group that holds most of it. Rows that tie in every key are put in no
    stated order.
    """
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.struct(*[F.col(f"`{c}`") for c in by]) if by else F.lit(0)
    parts = df.withColumn("__value", value).withColumn("__by", group)
    parts = cut(parts.repartitionByRange(slices, *[F.col(f"`{c}`") for c in by], *order).withColumn("__slice", F.spark_partition_id()))
    total = parts.groupBy("__by", "__slice").agg(F.sum("__value").alias("__total"))
    ahead = Window.partitionBy("__by").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("__by", "__slice", F.coalesce(F.sum("__total").over(ahead), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__by", "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = parts.withColumn(out, F.sum("__value").over(within)).join(total, ["__by", "__slice"])
    return both.withColumn(out, F.col(out) + F.col("__before")).drop("__slice", "__value", "__before", "__by")


def numbered(df: DataFrame, order: list[Column], out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with `out`: each row's place from 1 in the order, over the whole table or in each group of `by`."""
    return running(df, order, F.lit(1).cast("long"), out, by)


def even_parts(df: DataFrame, by: str, order: str, parts: int, out: str) -> DataFrame:
    """df with `out`: its part from 1 to `parts`, each `by` cut in order into parts whose sizes differ by one at most, larger ones first."""
    sizes = df.groupBy(F.col(by).alias("__of")).agg(F.count("*").alias("__n"))
    x = numbered(df, [F.col(order)], "__place", (by,)).join(sizes, F.col(by).eqNullSafe(F.col("__of")))
    i, n = F.col("__place") - 1, F.col("__n")
    size, more = F.floor(n / parts), n % parts
    part = F.when(i < more * (size + 1), F.floor(i / (size + 1))).otherwise(more + F.floor((i - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return x.withColumn(out, (part + 1).cast("long")).drop("__of", "__n", "__place")


def groups_of(rows: DataFrame, by: str, order: str, size: int = 10) -> DataFrame:
    """rows with group_index: `size` in a row of each `by`, in order, from 0."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return rows.withColumn("group_index", F.floor(at / size).cast("long"))


def greedy_batches(rows: DataFrame, by: str, order: str, tokens: str, most_items: int = 40, most_tokens: int = 8000) -> DataFrame:
    """(by, order, batch): items in order, a new batch where the next would exceed either bound; one item always fits."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        batch, items, total, out = 0, 0, 0, []
        for t in group[tokens]:
            if items and (items + 1 > most_items or total + t > most_tokens):
                batch, items, total = batch + 1, 0, 0
            items, total = items + 1, total + t
            out.append(batch)
        return pd.DataFrame({by: group[by].to_numpy(), order: group[order].to_numpy(), "batch": out})

    kinds = dict(rows.dtypes)
    return rows.select(by, order, tokens).groupBy(by).applyInPandas(run, f"`{by}` {kinds[by]}, `{order}` {kinds[order]}, batch long")


def lightest_bin(files: DataFrame, bins: int, by: str = "part") -> DataFrame:
    """(by, id, size, bin): per `by`, sizes descending, each into the bin that is lightest so far (the first of equals).

    The order makes this sequential, so it runs per group; `by` is a folder or day, never the corpus.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        heap = [(0, b) for b in range(bins)]
        group = group.sort_values(["size", "id"], ascending=[False, True])
        out = []
        for s in group["size"]:
            load, b = heapq.heappop(heap)
            out.append(b)
            heapq.heappush(heap, (load + s, b))
        return pd.DataFrame({by: group[by].to_numpy(), "id": group["id"].to_numpy(), "size": group["size"].to_numpy(), "bin": out})

    kinds = dict(files.dtypes)
    return files.select(by, "id", "size").groupBy(by).applyInPandas(run, f"`{by}` {kinds[by]}, id long, size long, bin long")


def balanced_parts(rows: DataFrame, by: str, order: str, size: str, most: int) -> DataFrame:
    """rows with part: ceil(total / most) parts of each `by` of about equal size, in order, cut by running sums."""
    totals = rows.groupBy(F.col(by).alias("__of")).agg(F.sum(size).alias("__total"))
    x = running(rows, [F.col(order)], F.col(size), "__upto", (by,)).join(totals, F.col(by).eqNullSafe(F.col("__of")))
    total, before = F.col("__total"), F.col("__upto") - F.col(size)
    parts = F.greatest(F.lit(1), F.ceil(total / most))
    return x.withColumn("part", F.least(parts - 1, F.floor(before * parts / F.greatest(total, F.lit(1)))).cast("long")).drop("__of", "__total", "__upto")
