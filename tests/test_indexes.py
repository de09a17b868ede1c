"""The vector and the text index beside full scans, and states on each row's own day beside one day for all."""

import glob
import os
import random
from collections import Counter
from datetime import date, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docgraph import plans
from docgraph.operators import retrieval, temporal, text_index, vector_index

VECTORS = "vec_id long, label int, embedding array<double>"


def clustered(n, hubs=30, dim=12, seed=2, spread=0.05):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(hubs, dim))
    x = centres[r.integers(0, hubs, n)] + r.normal(size=(n, dim)) * spread
    return [(i, int(i % 7), v.tolist()) for i, v in enumerate(x)]


def found(df):
    return sorted((r.qid, r.rank, r.vec_id, r.cos, r.label) for r in df.collect())


@pytest.mark.parametrize("n,cells", [(600, None), (3000, 40)])
def test_index_search_is_exact_and_reads_few(spark, n, cells):
    items = spark.createDataFrame(clustered(n), VECTORS).repartition(4)
    index = vector_index.build(items, cells=cells, rows_per_file=500)
    queries = items.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    got = index.search(queries, 8).cache()
    assert found(got) == found(retrieval.search(items, queries, 8))
    read = [r.rows_read for r in got.select("qid", "rows_read").distinct().collect()]
    assert len(read) == queries.count() and np.mean(read) < 0.3 * n  # the radii rule most cells out
    assert index.vectors.count() == n == index.n.sum()
    # one index, another search, in blocks of few queries
    again = index.search(queries, 3, block=4)
    assert found(again) == found(retrieval.search(items, queries, 3))
    near = index.search(queries, 8, share=0.1, exact=False)
    assert near.agg(F.max("rows_read")).first()[0] < 0.5 * n
    hits = near.select("qid", "vec_id").join(got.select("qid", "vec_id"), ["qid", "vec_id"]).count()
    assert hits >= 0.9 * got.count()


def test_index_grows(spark):
    rows = clustered(900, seed=5)
    first, more = spark.createDataFrame(rows[:500], VECTORS), spark.createDataFrame([*rows[500:], *rows[:20], (5000, 1, [9.0] * 12)], VECTORS)
    index = vector_index.build(first)
    before = {f for f in glob.glob(f"{index.path.removeprefix('file:')}/vectors/**/*.parquet", recursive=True)}
    index.append(more)
    after = {f for f in glob.glob(f"{index.path.removeprefix('file:')}/vectors/**/*.parquet", recursive=True)}
    assert before and before < after
    both = first.unionByName(more)
    queries = both.where("vec_id % 90 = 0 or vec_id = 5000").dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    assert found(index.search(queries, 5)) == found(retrieval.search(both, queries, 5))
    assert index.n.sum() == 921


def test_index_of_odd_vectors(spark):
    rows = [*clustered(40, 4, 3), (100, 1, None), (101, 2, []), (102, 3, [0.0, 0.0, 0.0]), (103, 1, [1.0]), (104, 1, [None, 1.0, 2.0]), (105, 1, [float("nan"), 1.0, 0.0]), (None, 1, [1.0, 2.0, 3.0])]
    items = spark.createDataFrame(rows, VECTORS)
    index = vector_index.build(items)
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [1.0])], "qid long, q array<double>")
    got = index.search(queries, 60)
    assert Counter(r.qid for r in got.collect()) == {1: 47, 2: 47, 3: 47, 4: 47}
    assert {r.cos for r in got.where("qid in (2, 3)").collect()} == {0.0} == {r.cos for r in got.where("vec_id in (100, 101, 102, 104, 105)").collect()}
    assert [r.vec_id for r in got.where("qid = 1 and rank = 1").collect()] == [r.vec_id for r in got.where("qid = 4 and rank = 1").collect()]
    assert index.search(queries.where("false"), 5).count() == 0
    none = vector_index.build(items.where("false"))
    assert none.search(queries, 5).collect() == [] and none.vectors.count() == 0


def some_texts(r, n):
    words = ["".join(r.choice("abcde.") for _ in range(r.randint(1, 3))) for _ in range(40)]
    return [(i, "".join(r.choice(words) + r.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(r.randint(0, 60)))) for i in range(n)]


def test_text_index_equals_scan(spark):
    r = random.Random(3)
    texts = [*some_texts(r, 300), (400, None), (401, ""), (None, "a b c d"), (402, "x " * 20_000 + "needle in the hay"), (5, "twice here"), (403, "é ü 中文 ß tail")]
    items = []
    for i in range(60):
        t = r.choice(texts[:300])[1]
        a = r.randrange(len(t) + 1)
        items.append((i, t[a : a + r.randint(0, 40)]))
    items += [(100, None), (101, "needle in the h"), (102, "nowhere to be found"), (103, "ü 中文 ß"), (104, "x x x x"), (105, "zz qq"), (106, "no such words here at all")]
    texts_df, items_df = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = text_index.build(texts_df.where("doc_id < 200 or doc_id is null"), "doc_id", texts_a_row=50)
    index.append(texts_df.where("doc_id >= 200"), "doc_id", texts_a_row=7)
    want = sorted({(d, i) for d, t in texts if d is not None and t is not None for i, x in items if x is not None and x in t})
    assert sorted(tuple(x) for x in index.containing(texts_df.where("doc_id is not null"), "doc_id", items_df, "item_id").collect()) == want
    long = items_df.where("item_id in (101, 103, 102)")
    pairs = {tuple(x) for x in index.candidates(long, "item_id").collect()}
    assert {(i, d) for d, i in want if i in (101, 103)} <= pairs and len(pairs) < 5
    known = {x.term: (x.texts, x.times) for x in index.read("terms").groupBy("term").agg(F.sum("texts").alias("texts"), F.sum("times").alias("times")).collect()}
    split = [[w for w in t.replace("\n", " ").replace("\t", " ").split(" ") if w] for d, t in texts if d is not None and t is not None]
    assert known == {w: (sum(w in set(s) for s in split), sum(s.count(w) for s in split)) for w in {w for s in split for w in s}}


def test_text_index_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words that are nowhere"), (2, "a")], "item_id long, text string")
    index = text_index.build(none, "doc_id")
    assert index.containing(none, "doc_id", items, "item_id").collect() == []
    one = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    assert text_index.build(one, "doc_id").containing(one, "doc_id", items.where("false"), "item_id").collect() == []


def test_text_index_compares_few(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")
    index = text_index.build(docs, "doc_id")
    compared = index.candidates(items, "item_id").select("doc").distinct().count()
    assert 0 < compared < 0.1 * docs.count()


def test_states_on_own_days(spark):
    r = random.Random(11)
    day = lambda: None if r.random() < 0.1 else date(2000, 1, 1) + timedelta(r.randrange(300))
    changes = [(f"u{i}", f"{r.randrange(12)}/2000" if r.random() < 0.95 else None, r.choice(["amended", "amended", "amended", "repealed"]), f"{r.randrange(30)}/2001", day()) for i in range(200)]
    changes += [(f"hot{i}", "99/2000", "amended", f"{i % 7}/2003", date(2000, 5, 1)) for i in range(500)]
    asked = [(i, f"{r.choice([*range(15), 99])}/2000", date(1999, 12, 1) + timedelta(r.randrange(400))) for i in range(150)]
    asked += [(900, None, date(2000, 1, 1)), (901, "1/2000", None), (902, "99/2000", date(2000, 5, 1)), (902, "99/2000", date(2000, 5, 1)), (903, "99/2000", date(2000, 4, 30))]
    c = spark.createDataFrame(changes, "uid string, law string, kind string, by_law string, day date")
    q = spark.createDataFrame(asked, "id long, law string, on date")
    got = temporal.status_on(c, q)
    assert not any(x in got._jdf.queryExecution().executedPlan().toString() for x in ("NestedLoop", "Cartesian"))
    rows = got.collect()
    assert len(rows) == len(asked)
    for x in rows:
        if x.law is None or x.on is None:
            assert x.is_repealed is None and x.amended_by is None
            continue
        known = [y for y in changes if y[1] == x.law and (y[4] is None or y[4] <= x.on)]
        at = lambda y: (y[4] or date(1, 1, 1), y[0])
        gone = min((y for y in known if y[2] == "repealed"), key=at, default=None)
        new = max((y for y in known if y[2] == "amended"), key=at, default=None) if gone is None else None
        assert (x.is_repealed, x.repealed_by, x.repealed_on) == (gone is not None, gone and gone[3], gone and gone[4])
        assert (x.amended_by, x.amended_on) == (new and new[3], new and new[4])
    assert temporal.status_on(c.where("false"), q).where("is_repealed").count() == 0
    assert temporal.status_on(c, q.where("false")).count() == 0


def test_probing_recall(spark):
    for sf in ("sf0.01", "sf0.1"):
        rows = plans.QUERIES["indexed_knn_recall"](spark, f"/root/testdata/{sf}").collect()
        assert sum(r.found for r in rows) >= 0.9 * sum(r.wanted for r in rows)
        n = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").count()
        assert max(r.rows_read for r in rows) < 0.8 * n


@pytest.mark.parametrize("name", ["question_ids", "indexed_knn", "asof_own_day", "indexed_contains"])
def test_queries_at_a_larger_size(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = plans.QUERIES[name](spark, sf)
    plain = lambda v: "~" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)
    got = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    said = con.execute(plans.ORACLES[name])
    columns = [c[0] for c in said.description]
    assert got == Counter(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in said.fetchall())
