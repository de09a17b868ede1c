"""Passages that documents share word for word, wherever they begin and however their lines are broken.

A document's words, line breaks ignored, are cut into runs at places that the words themselves choose: a word pair whose hash
is least within some `reach` words around. A passage brings its inner cuts with it, so two documents that share it share the
runs between them. Of `reach` words in a row one is a cut, so a passage of n words shares a stretch of runs of at least
n - 2 * (reach - 1) words with every copy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgraph.llm.common import looked_up, row_slices, utf8
from docgraph.llm.decontaminate import Words, powers

#: What separates words: ASCII white space.
KIND = np.ones(256, bool)
KIND[[9, 10, 11, 12, 13, 32]] = False
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def span_keys(words: Words, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words of each span."""
    h, n = words.hash, len(words.hash)
    out = (end - begin).astype(np.uint64)
    for base in _BASES:
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum((h ^ (h >> np.uint64(30))) * powers(base, n), dtype=np.uint64)]
        x = (sums[end] - sums[begin]) * powers(pow(base, -1, 1 << 64), n + 1)[begin]
        out = (out ^ x ^ (x >> np.uint64(32))) * np.uint64(_BASES[0])
        out ^= out >> np.uint64(29)
    return out


def _over(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every `width` neighbours."""
    s = 1
    while 2 * s <= width:
        x = f(x[:-s], x[s:])
        s *= 2
    return f(x[: len(x) - (width - s)], x[width - s :]) if s < width else x


def runs(words: Words, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end word of every run, within its text."""
    n, w = len(words.hash), reach - 1  # w pairs in reach words
    starts = np.zeros(n + 1, bool)
    starts[words.first[:-1][np.diff(words.first) > 0]] = True
    if n > w:
        pair = words.shingles(2)
        # the least of each window; windows across two texts choose nothing
        least = _over(pair, w, np.minimum)
        least = np.where(words.text[: len(least)] == words.text[w:], least, np.uint64(0))
        pad = np.zeros(w - 1, np.uint64)
        cut = _over(np.r_[pad, least, pad], w, np.maximum) == pair
        cut[1:] &= pair[1:] != pair[:-1]  # one word many times in a row is one run
        cut &= words.text[:-1] == words.text[1:]
        starts[: len(cut)] |= cut
    begin = np.flatnonzero(starts[:n])
    return begin, np.r_[begin[1:], n] if len(begin) else begin


def _slices(batch):
    buf, off = utf8(batch.column(1))
    for i, j in row_slices(off, 1 << 18):
        yield i, Words(buf[off[i] : off[j]], off[i : j + 1] - off[i], KIND)


def shared_runs(docs: DataFrame, reach: int) -> DataFrame:
    """(key, keep) of every run that several documents have; keep is the least doc_id among them."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, w in _slices(batch):
                begin, end = runs(w, reach)
                text = w.text[begin]
                key = span_keys(w, begin, end)
                order = np.lexsort((key, text))
                key, text = key[order], text[order]
                new = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])][: len(key)]
                yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), ids.take(pa.array(text[new] + i))], ["key", "doc_id"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "key long, doc_id long")
    return rows.groupBy("key").agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("most")).where("keep < most").drop("most")


def repeated_passages(docs: DataFrame, shared: DataFrame, reach: int, least: int) -> DataFrame:
    """(doc_id, begin, end, keeps) of every stretch of `least` words or more that is made of runs which an earlier document has.

    keeps: the documents that have it first, each with `least` words of it or more than any other has. Runs that only the
    document itself repeats are no repeats. docs: (doc_id long without nulls, text). Rows of equal doc_id are one document.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, w in _slices(batch):
                begin, end = runs(w, reach)
                text = w.text[begin]
                base = w.first[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(span_keys(w, begin, end).view(np.int64)), ids.take(pa.array(text + i)), pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32))],
                    ["key", "doc_id", "begin", "end"],
                )

    rows = docs.select("doc_id", "text").mapInArrow(run, "key long, doc_id long, begin int, end int")
    rows = rows.join(looked_up(shared), "key").where("doc_id <> keep").select("doc_id", "begin", "end", "keep")
    place = Window.partitionBy("doc_id").orderBy("begin", "end", "keep")
    rows = rows.withColumn("new", F.coalesce(F.col("begin") > F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    rows = rows.withColumn("stretch", F.count_if("new").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    each = rows.groupBy("doc_id", "stretch", "keep").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum(F.col("end") - F.col("begin")).alias("words"))
    whole = each.groupBy("doc_id", "stretch").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.max_by("keep", F.struct("words", F.bitwise_not("keep"))).alias("main"), F.collect_list(F.when(F.col("words") >= least, F.col("keep"))).alias("keeps"))
    return whole.where(F.col("end") - F.col("begin") >= least).select("doc_id", "begin", "end", F.array_sort(F.array_distinct(F.array_append("keeps", F.col("main")))).alias("keeps"))
