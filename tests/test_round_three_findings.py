import difflib
import random
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docgraph import plans, providers
from docgraph.functions import html
from docgraph.functions.session import ensure_checkpoint_dir
from docgraph.operators import extraction, graph, retrieval, text_index
from docgraph.plans import amend, catalogue
from docgraph.sources import io


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_vector_search_by_tiles(spark):
    r = np.random.default_rng(5)
    x, q = r.integers(-3, 4, (60, 4)).astype(float), r.integers(-3, 4, (1100, 4)).astype(float)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, q array<double>")
    unit = lambda a: a / np.maximum(np.sqrt((a * a).sum(1)), 1e-300)[:, None]
    cos = np.round(unit(x) @ unit(q).T, 6) + 0.0
    assert all(c.shape[0] <= retrieval.TILE[0] and c.shape[1] <= retrieval.TILE[1] for _, c in retrieval._tiles(unit(x), unit(q)))
    for block in (16 << 20, 60_000):
        got = {(row.qid, row["rank"]): (row.vec_id, row.cos) for row in retrieval.search(items, queries, 3, block_bytes=block).collect()}
        assert len(got) == 3300
        for j in range(len(q)):
            best = sorted((-cos[i, j], i) for i in range(len(x)))[:3]
            assert all(got[j, n + 1][0] == i and abs(got[j, n + 1][1] + c) < 2e-6 for n, (c, i) in enumerate(best))
        near = {row.vec_id: row.qid for row in retrieval.nearest_query(items, queries, block_bytes=block).collect()}
        assert near == {i: int(cos[i].argmax()) for i in range(len(x))}
        first = {row.vec_id: row.qid for row in retrieval.first_query(items, queries, 0.95, block_bytes=block).collect()}
        assert first == {i: int((cos[i] > 0.95).argmax()) for i in range(len(x)) if (cos[i] > 0.95).any()}


def test_embedding_of_words_that_cancel():
    one = {w: providers.embed(pd.Series([w]))[0] for w in map(str, range(400))}
    a, b = next((a, b) for a in one for b in one if np.allclose(np.add(one[a], one[b]), 0))
    got = providers.embed(pd.Series([f"{a} {b}", "", "..."]))
    assert [round(sum(x * x for x in v), 6) for v in got] == [1.0, 0.0, 0.0]


def test_provider_gets_some_inputs_at_a_time(spark):
    sizes = lambda s: pd.Series([len(s)] * len(s))
    got = providers.apply(spark.range(2000).selectExpr("cast(id as string) as text").coalesce(1), "text", "n", sizes, "int")
    assert got.count() == 2000 and 0 < got.agg(F.max("n")).first()[0] <= 256


def test_halves_without_python(spark):
    r = random.Random(3)
    texts = [None, "", "a", "ab", " ", "  ", "a b", "\n\n\n\n"] + ["".join(r.choice(["a", "é", "😀", " ", ". ", "\n", "\n\n", "bc"]) for _ in range(r.randint(0, 40))) for _ in range(400)] + ["x" * n for n in range(9)]

    def want(t):
        t = t or ""
        mid, reach = len(t) // 2, max(1, len(t) // 4)
        for mark in ("\n\n", "\n", ". ", " "):
            at = [i for i in (t.rfind(mark, max(0, mid - reach), mid), t.find(mark, mid, mid + reach)) if i >= 0]
            if at:
                mid = min(at, key=lambda i: abs(i - mid)) + len(mark)
                break
        return [t[:mid], t[mid:]]

    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", extraction.halves("text").alias("h"))
    assert "Python" not in _plan(df)
    assert {row.i: row.h for row in df.collect()} == {i: want(t) for i, t in enumerate(texts)}


def test_ratio_of_beginnings_needs_no_search(monkeypatch):
    r = random.Random(4)
    pairs = [("".join(r.choice("ab c") for _ in range(r.randint(0, 500))), "".join(r.choice("ab cdxyz") for _ in range(r.randint(0, 300)))) for _ in range(60)]
    pairs = [p for a, b in pairs for p in ((a, a + b), (a + b, a), (a, a))]
    want = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    monkeypatch.setattr(difflib, "SequenceMatcher", None)
    got = extraction.sequence_ratio.func(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]))
    assert got.tolist() == want


def test_index_takes_texts_in_slices():
    texts = ["a b"] * 5 + ["c" * (5 << 20)] + ["d"] * 3
    got = list(text_index._some(pa.array(range(9)), pa.array(texts), 4))
    assert [ids for ids, _ in got] == [[0, 1, 2, 3], [4], [5], [6, 7, 8]] and [t for _, ts in got for t in ts] == texts


@pytest.mark.parametrize("name, most", [("downloads", 2), ("amendment_list", 1)])
def test_a_page_is_read_once(spark, name, most):
    page = spark.createDataFrame([("<a href='x.pdf'>a</a>",)], "html string")
    column = html.downloads(F.col("html"), "https://example.org") if name == "downloads" else html.amendment_list(F.col("html"))
    plan = _plan(page.select(column.alias("x")).where(F.rand() < 2))
    assert plan.count("regexp_extract_all(html") <= most and plan.count("split(html") <= most


def test_expansion_of_repeated_edges_needs_no_distinct(spark, sf):
    assert "Aggregate" not in _plan(catalogue._edges(spark, sf, False))
    once, often = (graph.expand(catalogue._edges(spark, sf, x), catalogue._starts(spark, sf), 2) for x in (True, False))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, often.collect()))


def test_edge_counts(spark, sf):
    df = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (None, 3), (2, None)], "s long, o long")
    assert tuple(graph.edge_counts(df, rows_a_task=2).first()) == (4, 2, 2)
    assert tuple(graph.edge_counts(df, repeats=True).first()) == (5, 2, 2)
    assert plans.QUERIES["edge_stats"](spark, sf).count() == 4


def test_equal_answers_are_judged_once(spark):
    judged = spark.sparkContext.accumulator(0)
    edges = spark.createDataFrame([("1_2009", "diubah_dengan", "2_2009")], "source string, relationship string, target string")
    chunks = spark.createDataFrame([("2_2009", 1, "new")], "law string, seq int, text string")
    answers = spark.range(50).selectExpr("id as qid", "'both' as pipeline", "case when id = 0 then null when id = 1 then 'none' else 'See UU Nomor 1 Tahun 2009' end as answer")

    def relevant(d):
        def count(batches):
            for b in batches:
                judged.add(len(b))
                yield b

        return d.mapInPandas(count, d.schema).withColumn("uses", F.lit(True))

    merge = lambda d: d.withColumn("final", F.concat_ws("|", "answer", "context"))
    got = {r.qid: r.final for r in amend.integrated(answers, edges, chunks, relevant, merge).select("qid", "final").collect()}
    assert got == {0: None, 1: "none", **{i: "See UU Nomor 1 Tahun 2009|new" for i in range(2, 50)}} and judged.value == 1
    judged.add(-judged.value)
    q = spark.range(50).selectExpr("id as qid", "'q terbaru' as query")
    base = lambda d: d.withColumn("answer", F.lit("See UU Nomor 1 Tahun 2009"))
    dated = edges.withColumn("day", F.lit(None).cast("date"))
    out = amend.passes(q, F.lit("2024-01-01").cast("date"), base, dated, chunks, relevant, merge, lambda d: d.withColumn("final", F.col("answer"))).collect()
    assert len(out) == 50 and {r.final for r in out} == {"See UU Nomor 1 Tahun 2009|new"} and judged.value == 1


def test_embed_chunks_of_null_and_empty_texts(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, ""), (3, "word")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n, r.norm) for r in plans.QUERIES["embed_chunks"](spark, str(tmp_path)).collect()}
    assert got == {1: (64, 0.0), 2: (64, 0.0), 3: (64, 1.0)}


def test_log_files_do_not_grow_with_users(spark, tmp_path):
    spark.range(800).selectExpr("nullif(id, 5) as event_id", "nullif(id div 2, 7) as user_id").write.parquet(f"{tmp_path}/events.parquet")
    found = lambda: set(Path(ensure_checkpoint_dir(spark).removeprefix("file:")).glob("**/logs-*/**/*.txt"))
    before = found()
    got = {r.user_id: r.lines for r in plans.QUERIES["log_scan"](spark, str(tmp_path)).collect()}
    assert got == {None if i == 7 else i: 2 for i in range(400)}
    assert 0 < len(found() - before) <= 16


def test_runs_of_log_files(spark, tmp_path):
    logs = {"q_id1_": ["==> x", "", " two\n==> three", "a\r b\r==> c", ""], "q_id2_": [""], "": ["é"]}
    rows = [(k, x) for k, lines in logs.items() for x in lines] + [("q_id2_", None), (None, "x")]
    io.write_runs(spark.createDataFrame(rows, "run string, value string").coalesce(1), f"{tmp_path}/runs", runs=2)
    got = io.read_runs(spark, f"{tmp_path}/runs/*.txt").collect()
    assert {r.run: r.value for r in got} == {k: "\n".join(x) for k, x in logs.items()} and len(got) == 3
