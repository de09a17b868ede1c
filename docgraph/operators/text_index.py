"""A word index of texts: postings in Parquet, searched by the rarest words of what is looked for, then compared in full."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgraph.functions.session import ensure_checkpoint_dir
from docgraph.operators import retrieval

_SPACE = r"[ \t\n\x0B\f\r]+"
_SPLIT = re.compile(_SPACE)
_POSTINGS = "term string, texts int, docs array<long>, places array<int>"
_STORED = {"postings": f"{_POSTINGS}, part string", "terms": "term string, texts long, times long, part string"}
#: A row's lists are of texts of this many characters at most, or of one text that is longer.
_CHARACTERS = 4 << 20


def _words(text) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def _some(ids: pa.Array, texts: pa.Array, most: int):
    """Slices of the texts, by number and by length; only a slice's texts are Python's at a time."""
    upto = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(upto, (upto[i - 1] if i else 0) + _CHARACTERS, side="right"))
        j = min(max(i + 1, j), i + most, len(texts))
        yield ids.slice(i, j - i).to_pylist(), texts.slice(i, j - i).to_pylist()
        i = j


def _postings(batches, texts_a_row: int):
    """For each slice of a task's texts a run of rows sorted by term: in how many of them it is, and the text and the place of each
    time that it is there."""
    for batch in batches:
        for ids, texts in _some(batch.column(0), batch.column(1), texts_a_row):
            number: dict[str, int] = defaultdict()
            number.default_factory = number.__len__  # a new word gets the next number
            codes, sizes = [], []
            for text in texts:
                words = _SPLIT.split(text)
                words = words[not words[0] : len(words) - (len(words) > 1 and not words[-1])]
                codes.extend(map(number.__getitem__, words))
                sizes.append(len(words))
            if not codes:
                continue
            terms = np.array(list(number), object)
            order = np.argsort(terms)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            code, doc = rank[codes], np.repeat(np.arange(len(ids)), sizes)
            place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.argsort(code, kind="stable")
            code, doc, place = code[at], doc[at], place[at].astype(np.int32)
            start = np.r_[np.searchsorted(code, np.arange(len(terms))), len(code)].astype(np.int32)
            new = np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]
            texts_with = np.add.reduceat(new.astype(np.int32), start[:-1])
            lists = [pa.ListArray.from_arrays(pa.array(start), x) for x in (pa.array(ids, pa.int64()).take(pa.array(doc)), pa.array(place))]
            rows = pa.RecordBatch.from_arrays([pa.array(terms[order].tolist(), pa.string()), pa.array(texts_with, pa.int32()), *lists], ["term", "texts", "docs", "places"])
            for j in range(0, rows.num_rows, 2048):
                yield rows.slice(j, 2048)


class TextIndex:
    """What `build` has written under a folder: `postings`, in runs sorted by term, and `terms` (in how many texts, and how often),
    by part; a part is what was indexed at once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, texts: DataFrame, id_col: str, texts_a_row: int = 2000) -> None:
        """Indexes more texts (id_col: a long, text). What is there already is neither read nor written.

        A task writes the postings of its own texts, so nothing is shuffled but counts by term. Null ids and null texts can't
        be found and are left out; repeated rows are found once.
        """
        part = uuid.uuid4().hex
        given = texts.where(F.col(id_col).isNotNull() & F.col("text").isNotNull()).select(F.col(id_col).cast("long"), "text")
        found = given.mapInArrow(lambda batches: _postings(batches, texts_a_row), _POSTINGS)
        found.withColumn("part", F.lit(part)).write.mode("append").partitionBy("part").parquet(f"{self.path}/postings")
        new = self.read("postings").where(F.col("part") == part).groupBy("term", "part")
        new.agg(F.sum("texts").alias("texts"), F.sum(F.size("places")).alias("times")).write.mode("append").partitionBy("part").parquet(f"{self.path}/terms")

    def read(self, what: str) -> DataFrame:
        """The table `postings` or `terms`."""
        return self.spark.read.schema(_STORED[what]).parquet(f"{self.path}/{what}")

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def candidates(self, items: DataFrame, item_id: str, rarest: int = 3, few: int = 1000) -> DataFrame:
        """(item, doc): the texts in which the `rarest` inner words of an item stand as far apart as in the item.

        items: (item_id, text) of three words or more; its words but the first and the last stand whole in any text that holds
        it, so no such text is missed. Of the postings only the chosen words' lists are read; up to `few` such words are told
        to the reader, which passes over pages of other terms.
        """
        words = items.select(F.col(item_id).alias("item"), _words(F.col("text")).alias("w")).where("size(w) > 2")
        inner = words.select("item", F.posexplode(F.slice("w", F.lit(2), F.size("w") - 2)).alias("at", "term"))
        inner = inner.groupBy("item", "term").agg(F.min("at").alias("at"))
        known = self.read("terms").join(inner.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("texts").alias("texts"))
        counted = inner.join(known, "term", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
        chosen = counted.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("texts", "term"))).where(F.col("r") <= rarest)
        chosen = self._kept(chosen.withColumn("of", F.count("*").over(Window.partitionBy("item"))).select("item", "term", "at", "of", "texts"), "chosen")
        terms = chosen.where("texts > 0").select("term").distinct()
        told = [r.term for r in terms.limit(few + 1).collect()]
        postings = self.read("postings").select("term", "docs", "places")
        lists = postings.where(F.col("term").isin(told)) if len(told) <= few else postings.join(terms, "term", "left_semi")
        each = lists.select("term", F.explode(F.arrays_zip("docs", "places")).alias("x")).select("term", F.col("x.docs").alias("doc"), F.col("x.places").alias("place")).distinct()
        met = each.join(chosen, "term").groupBy("item", "doc", (F.col("place") - F.col("at")).alias("start")).agg(F.count("*").alias("n"), F.first("of").alias("of"))
        return met.where("n = of").select("item", "doc").distinct()

    def containing(self, texts: DataFrame, text_id: str, items: DataFrame, item_id: str, rarest: int = 3, most_bytes: int = 32 << 20) -> DataFrame:
        """(text_id, item_id) of every indexed text that contains an item's text, character by character.

        texts: the indexed (text_id, text), of which only the candidates are compared; candidates of up to `most_bytes` are
        counted and broadcast to where the texts are, more meet them by their ids. Items of fewer than three words have no
        inner one and are looked for in every text (`retrieval.containing`); null items are in none.
        """
        found = self._kept(self.candidates(items, item_id, rarest), "candidates")
        docs = found.select("doc").distinct()
        docs = F.broadcast(docs) if 32 * found.count() <= most_bytes else docs
        known = items.where("text is not null").select(F.col(item_id).alias("__item"), F.col("text").alias("__text"))
        met = texts.select(text_id, "text").join(docs, F.col(text_id) == F.col("doc"), "left_semi")
        met = met.join(found, F.col(text_id) == F.col("doc")).join(known, F.col("item") == F.col("__item"))
        met = met.where(F.col("text").contains(F.col("__text"))).select(text_id, F.col("item").alias(item_id)).distinct()
        short = items.where(F.size(_words(F.col("text"))) < 3).select(item_id, "text")
        return met if short.isEmpty() else met.unionByName(retrieval.containing(texts, text_id, short, item_id).distinct())


def build(texts: DataFrame, id_col: str, path: str | None = None, texts_a_row: int = 2000) -> TextIndex:
    """Writes an index of texts (id_col: a long, text) under path, a folder that all machines share, and opens it.

    Terms are runs of non-space, as they stand. A row of postings is of one term and of at most `texts_a_row` texts of one
    task, so no row grows with the corpus. By default the folder is one in the checkpoint folder.
    """
    spark = texts.sparkSession
    index = TextIndex(spark, path or f"{ensure_checkpoint_dir(spark)}/text-index-{uuid.uuid4().hex}")
    index.append(texts, id_col, texts_a_row)
    return index
