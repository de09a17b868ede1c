"""Exact vector search, fusion, reranking and selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from docgraph.functions.vectors import index_score


def _units(vectors) -> np.ndarray:
    """Rows of unit length from a column of lists; missing and zero vectors are rows of zeros, short ones are filled up with zeros."""
    lists = [v if v is not None else () for v in vectors]
    out = np.zeros((len(lists), max(map(len, lists), default=0)))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    n = np.sqrt((out * out).sum(1))
    return out / np.where(n > 0, n, 1)[:, None]


def _blocks(queries: DataFrame, most: int, each: int = 0):
    """The queries (qid, q) in blocks of ids and unit vectors, in the order of qid, for one pass over the items each: of about `most`
    bytes, of which a query takes its vector's and `each` more.

    Their values are counted before any of them is gathered, and one block at a time is.
    """
    size = queries.agg(F.coalesce(F.sum(8 * F.size("q") + each), F.lit(0))).first()[0]
    blocks = max(1, -(-size // most))
    for k in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k).select("qid", "q").collect()
        rows.sort(key=lambda r: (r.qid is not None, 0 if r.qid is None else r.qid))
        yield [r.qid for r in rows], _units([r.q for r in rows])


def _cosines(items: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Every item's cosine with every query, to six places."""
    n = min(items.shape[1], queries.shape[1])
    return np.round(items[:, :n] @ queries[:, :n].T, 6) + 0.0


#: Items and queries of a tile: its cosines are 8 MB, however many items and queries there are.
TILE = (2048, 512)


def _tiles(units: np.ndarray, queries: np.ndarray):
    """(place of its first query, cosines) of an item slice's tiles."""
    for j in range(0, len(queries), TILE[1]):
        yield j, _cosines(units, queries[j : j + TILE[1]])


def _product(items: DataFrame, queries: DataFrame, vector: str, schema: StructType, make, block_bytes: int, each: int = 0) -> DataFrame:
    """The union over blocks of queries of make(slices of (items, tiles of cosines), ids) per task. A block is broadcast, items stay
    where they are; what a task keeps of a query takes `each` bytes, so a block bounds it."""
    at, out = items.columns.index(vector), None
    for ids, units in _blocks(queries, block_bytes, each):
        shared = items.sparkSession.sparkContext.broadcast((ids, units))

        def run(batches, shared=shared):
            ids, units = shared.value
            parts = (batch.slice(i, TILE[0]) for batch in batches for i in range(0, batch.num_rows, TILE[0]))
            yield from make(((p, _tiles(_units(p.column(at).to_numpy(zero_copy_only=False)), units)) for p in parts), ids)

        got = items.mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    return out


class Best:
    """The k best rows so far of each of n queries: tables that also have __q, the query's place, and cos; ties by id."""

    def __init__(self, k: int, n: int, id_col: str):
        self.k, self.id_col, self.rows, self.kth = k, id_col, None, np.full(n, -2.0)

    def among(self, cos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item rows and query columns of those cosines, over -2, that may be among the best."""
        hit = (cos >= self.kth) & (cos > -2)
        if self.k < len(cos) and hit.sum() > 2 * self.k * len(self.kth):
            hit &= cos >= np.partition(cos, -self.k, axis=0)[-self.k]
        return np.nonzero(hit)

    def take(self, got: pa.Table) -> None:
        if not got.num_rows:
            return
        rows = got if self.rows is None else pa.concat_tables([self.rows, got])
        rows = rows.sort_by([("__q", "ascending"), ("cos", "descending"), (self.id_col, "ascending")])
        q = rows.column("__q").to_numpy()
        self.rows = rows.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < self.k)).combine_chunks()
        q, cos = self.rows.column("__q").to_numpy(), self.rows.column("cos").to_numpy()
        last = np.searchsorted(q, np.arange(len(self.kth)), side="right")
        full = last - np.searchsorted(q, np.arange(len(self.kth))) == self.k
        self.kth[full] = cos[last[full] - 1]


def _scored_schema(items: DataFrame, queries: DataFrame, vector: str) -> StructType:
    return StructType([f for f in items.schema if f.name != vector]).add("qid", queries.schema["qid"].dataType).add("cos", DoubleType())


def _rows(batch: pa.RecordBatch, vector: int, row: np.ndarray, ids: list, query: np.ndarray, cos: np.ndarray) -> pa.RecordBatch:
    kept = batch.select([i for i in range(batch.num_columns) if i != vector]).take(pa.array(row))
    return pa.RecordBatch.from_arrays([*kept.columns, pa.array(ids).take(pa.array(query)), pa.array(cos)], [*kept.schema.names, "qid", "cos"])


def with_scores(items: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding", block_bytes: int = 16 << 20) -> DataFrame:
    """items (without the vector) for each of the queries (qid, q), with the cosine of the pair and its index score.

    Vectors are brought to unit length once and multiplied in blocks; missing and zero vectors have cosine 0.
    """
    at = items.columns.index(vector)

    def make(parts, ids):
        for batch, tiles in parts:
            for j, cos in tiles:
                row, query = np.divmod(np.arange(cos.size), cos.shape[1])
                yield _rows(batch, at, row, ids, query + j, cos.ravel())

    got = _product(items, queries, vector, _scored_schema(items, queries, vector), make, block_bytes)
    return got.withColumn("score_index", F.round(index_score(F.col("cos")), 7))


def search(items: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", block_bytes: int = 16 << 20) -> DataFrame:
    """Each query's k nearest items by cosine, ties by id, with their rank and index score, and without the vector.

    A task keeps k items a query while it multiplies tile after tile, so only tasks' bests are shuffled, never all pairs. What it
    keeps counts towards a block of queries.
    """
    at = items.columns.index(vector)

    def make(parts, ids):
        best = {}
        for batch, tiles in parts:
            for j, cos in tiles:
                mine = best.setdefault(j, Best(k, cos.shape[1], id_col))
                row, query = mine.among(cos)
                mine.take(pa.Table.from_batches([_rows(batch, at, row, ids, query + j, cos[row, query]).append_column("__q", pa.array(query))]))
        for mine in best.values():
            if mine.rows is not None:
                yield from mine.rows.drop_columns(["__q"]).to_batches()

    got = _product(items, queries, vector, _scored_schema(items, queries, vector), make, block_bytes, 64 * k)
    return top_k_per_query(got, k, id_col).withColumn("score_index", F.round(index_score(F.col("cos")), 7))


def _per_item(items: DataFrame, queries: DataFrame, choose, nearer: bool, better, id_col: str, vector: str, block_bytes: int) -> DataFrame:
    """A row of items (without the vector) with qid and cos for each item that choose gives a query: choose takes a tile's cosines,
    their columns in the order of qid, to item rows and columns. Of several tiles' choices the first stays, or with `nearer` the
    first of those with the highest cosine; of several blocks' the least by `better`."""
    at = items.columns.index(vector)

    def make(parts, ids):
        for batch, tiles in parts:
            of, best = np.full(batch.num_rows, -1), np.full(batch.num_rows, -2.0)
            for j, cos in tiles:
                row, column = choose(cos)
                new = (of[row] < 0) | (nearer & (cos[row, column] > best[row]))
                row, column = row[new], column[new]
                of[row], best[row] = column + j, cos[row, column]
            row = np.flatnonzero(of >= 0)
            if len(row):
                yield _rows(batch, at, row, ids, of[row], best[row])

    got = _product(items, queries, vector, _scored_schema(items, queries, vector), make, block_bytes)
    rows = F.min_by(F.struct(*[F.col(f"`{c}`") for c in got.columns]), better)
    return got.groupBy(F.col(id_col).alias("__id")).agg(rows.alias("__row")).select("__row.*")


def nearest_query(items: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding", block_bytes: int = 16 << 20) -> DataFrame:
    """Each item (without the vector) with its nearest of the queries (qid, q) and their cosine, ties by qid. A task sends a row
    per item and block, never pairs. Rows of one id count once; without queries there are no rows."""
    return _per_item(items, queries, lambda cos: (np.arange(len(cos)), cos.argmax(1)), True, F.struct(-F.col("cos"), "qid"), id_col, vector, block_bytes)


def first_query(items: DataFrame, queries: DataFrame, above: float, id_col: str = "vec_id", vector: str = "embedding", block_bytes: int = 16 << 20) -> DataFrame:
    """Each item (without the vector) that some query (qid, q) comes nearer to than a cosine of `above`, with the smallest such
    qid and that cosine. A task sends a row per item and block, never pairs. Rows of one id count once."""

    def choose(cos):
        hit = cos > above
        row = np.flatnonzero(hit.any(1))
        return row, hit[row].argmax(1)

    return _per_item(items, queries, choose, False, F.struct("qid"), id_col, vector, block_bytes)


def mean_similarity(items: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding", block_bytes: int = 16 << 20) -> DataFrame:
    """(id, mean_cos): each item's mean cosine, to six places each, over all queries. A row per item and block, no pairs."""

    def make(parts, ids):
        for batch, tiles in parts:
            total = sum((cos.sum(1) for _, cos in tiles), np.zeros(batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(id_col)), pa.array(total), pa.array(np.full(batch.num_rows, len(ids)))], [id_col, "total", "n"])

    schema = StructType([items.schema[id_col]]).add("total", DoubleType()).add("n", LongType())
    got = _product(items.select(id_col, vector), queries, vector, schema, make, block_bytes)
    return got.groupBy(id_col).agg((F.sum("total") / F.sum("n")).alias("mean_cos"))


def top_k_per_query(scored: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """Each query's k best with their rank. Spark limits each task's rows per query to k before they are shuffled."""
    w = Window.partitionBy("qid").orderBy(F.desc("cos"), id_col)
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def fuse(ranked: DataFrame, key: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of lists with a rank from 1: the sum of 1 / (k + rank), and the best raw cosine."""
    return ranked.groupBy(key).agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("fused"), F.max("cos").alias("best"))


def best_per_key(rows: DataFrame, key: str, score: str, seq: str) -> DataFrame:
    """Of each key the row with the highest score; missing scores are 0 and the first in `seq` wins ties."""
    best = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(-F.coalesce(F.col(score), F.lit(0.0)), seq))
    return rows.groupBy(F.col(key).alias("__key")).agg(best.alias("__row")).select("__row.*")


def reserved_quota(items: DataFrame, queries: DataFrame, reserved: Column, least: int, k: int, id_col: str = "vec_id") -> DataFrame:
    """Per query up to `least` of the reserved items first, then the best of the others, k in all; rank says the order."""
    first = search(items.where(reserved), queries, least, id_col).withColumn("part", F.lit(0))
    rest = search(items, queries, k + least, id_col).join(first.select("qid", id_col), ["qid", id_col], "left_anti").withColumn("part", F.lit(1))
    w = Window.partitionBy("qid").orderBy("part", F.desc("cos"), id_col)
    return first.unionByName(rest).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).drop("part")


def mmr(candidates: DataFrame, keep: int = 12, balance: float = 0.7) -> DataFrame:
    """Maximal marginal relevance per qid over its bounded candidate list (qid, id, score, embedding): (qid, id, rank)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "id"], ascending=[False, True], ignore_index=True)
        e = np.stack(group.embedding.map(np.asarray)).astype(float)
        n = np.linalg.norm(e, axis=1)
        e = e / np.where(n > 0, n, 1)[:, None]
        relevance = group.score.to_numpy() / max(group.score.max(), 1e-12) if group.score.max() > 0 else group.score.to_numpy()
        out, nearest = [], np.zeros(len(group))
        left = np.ones(len(group), bool)
        while left.any() and len(out) < keep:
            value = np.where(left, balance * relevance - (1 - balance) * nearest, -np.inf)
            i = int(value.argmax())
            out.append(i)
            left[i] = False
            nearest = np.maximum(nearest, e @ e[i])
        return pd.DataFrame({"qid": group.qid.iloc[out].to_numpy(), "id": group.id.iloc[out].to_numpy(), "rank": np.arange(1, len(out) + 1)})

    return candidates.select("qid", "id", "score", "embedding").groupBy("qid").applyInPandas(run, "qid long, id long, rank long")


def containing(texts: DataFrame, text_id: str, items: DataFrame, item_id: str, words: int = 5, most_bytes: int = 32 << 20) -> DataFrame:
    """(text_id, item_id) of every text that contains an item's text, character by character.

    An item's inner words stand whole in any text that contains it, so pairs come from an equality join on the hash of some
    of them: its first `words` inner ones, or as many as it has. What meets is then compared exactly. Items of two words or
    fewer have no inner one and are looked for in every text; only these are, and their bytes are counted first.
    """
    split = lambda c: F.array_remove(F.split(c, r"\s+"), "")
    i = items.select(F.col(item_id), F.col("text").alias("item"), split(F.col("text")).alias("w")).where("item is not null")
    i = i.withColumn("n", F.least(F.lit(words), F.size("w") - 2))
    key = lambda w, at, n: F.xxhash64(n, F.array_join(F.slice(w, at, n), " "))
    long = i.where("n > 0").select(item_id, "item", key(F.col("w"), F.lit(2), F.col("n")).alias("key"))
    gram = lambda n: lambda at: key(F.col("w"), at, F.lit(n))
    lengths = [r.n for r in i.where("n > 0").select("n").distinct().collect()]  # `words` different ones at most
    t = texts.select(F.col(text_id), "text", split(F.col("text")).alias("w"))
    found = texts.select(text_id).join(items.select(item_id), F.lit(False)) if not lengths else None
    for n in lengths:
        grams = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), gram(n))
        met = t.where(F.size("w") >= n).select(text_id, F.explode(F.array_distinct(grams)).alias("key")).join(long, "key").select(text_id, item_id).distinct()
        found = met if found is None else found.unionByName(met)
    found = found.distinct().join(texts.select(text_id, "text"), text_id).join(long.select(item_id, "item"), item_id).where(F.col("text").contains(F.col("item"))).select(text_id, item_id)
    short = i.where("n <= 0").select(item_id, "item")
    size = short.agg(F.coalesce(F.sum(F.octet_length("item") + 64), F.lit(0))).first()[0]
    if not size:
        return found
    if size > most_bytes:
        raise ValueError("too many items of one or two words to look for in every text")
    return found.unionByName(texts.join(F.broadcast(short), F.col("text").contains(F.col("item"))).select(text_id, item_id))
