"""Chains on their own days, discovery of changes, questions of each item, and the loop's history."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgraph.operators import graph, retrieval
from docgraph.plans import amend, retrieve


def fold(edges, start, on, repeal="dicabut_dengan"):
    out, queue, visited, laws, n = {}, [start], set(), [start], 0
    for s, r, t, d in sorted({(s, r, t, None) if d is None else (s, r, t, d) for s, r, t, d in edges}, key=lambda e: (e[1], e[2])):
        if (d is None or on is None or d <= on) and (r, t) not in out.setdefault(s, []):
            out[s].append((r, t))
    for node in queue:
        if node in visited:
            continue
        visited.add(node)
        for kind, target in out.get(node, ()):
            n += 1
            laws = [target] if kind == repeal else laws if target in laws else [*laws, target]
            queue.append(target)
    return ",".join(laws), n


@pytest.mark.parametrize("size", [8, 40])
def test_chains_equal_a_plain_fold_on_every_day(spark, size):
    rng = random.Random(size)
    day = lambda: None if rng.random() < 0.2 else datetime.date(2000 + rng.randrange(8), 1, 1)
    name = lambda: f"L{rng.randrange(size):02}"
    edges = [(name(), rng.choice(["dicabut_dengan", "diubah_dengan", "diubah_sebagian_dengan"]), name(), day()) for _ in range(2 * size)]
    edges += edges[:3] + [(None, "diubah_dengan", "L00", None)]
    e = spark.createDataFrame(edges, "source string, relationship string, target string, day date")
    asked = [(name(), day()) for _ in range(12)] + [("absent", None), (None, datetime.date(2003, 1, 1))]
    asked += asked[:2]
    got = graph.chain_with_reset(e, spark.createDataFrame(asked, "node string, asked date"), on="asked").collect()
    real = [x for x in edges if x[0]]
    want = [(s, d, *(fold(real, s, d) if s else (None, 0))) for s, d in asked]
    assert sorted(map(str, ((r.start, r.asked, r.relevant, r.n_edges) for r in got))) == sorted(map(str, want))
    plain = graph.chain_with_reset(e, spark.createDataFrame([(s,) for s, _ in asked], "node string")).collect()
    assert {r.start: (r.relevant, r.n_edges) for r in plain if r.start} == {s: fold(real, s, None) for s, _ in asked if s}


def test_chains_without_edges(spark):
    e = spark.createDataFrame([], "source string, relationship string, target string")
    assert graph.chain_with_reset(e, spark.createDataFrame([("A",)], "node string")).collect() == [("A", "A", 0)]
    assert graph.chain_with_reset(e, spark.createDataFrame([], "node string")).collect() == []


def test_an_amendment_counts_only_from_its_day(spark):
    e = spark.createDataFrame([(f"L{i}", "diubah_dengan", f"L{i + 1}", None) for i in range(5)], "source string, relationship string, target string, day date")
    found = graph.chain_with_reset(e, spark.createDataFrame([("L0", datetime.date(2000, 1, 1))], "node string, d date"), on="d")
    assert [(r.relevant, r.n_edges) for r in found.collect()] == [("L0,L1,L2,L3,L4,L5", 5)]


def test_an_items_queries(spark):
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(60, 6)).round(1), rng.normal(size=(9, 6)).round(1)
    v[5] = 0
    items = spark.createDataFrame([(i, i % 4, x.tolist()) for i, x in enumerate(v)] + [(60, 0, None)], "vec_id long, label int, embedding array<double>").repartition(3)
    ids = [70, 3, 51, 8, 26, 99, 4, 17, 60]
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, q)], "qid long, q array<double>")
    unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=1)) > 0, n, 1)[:, None]
    cos = np.vstack([np.round(unit(v) @ unit(q).T, 6), np.zeros(9)])
    nearest = {i: min((-c, k) for c, k in zip(row, ids)) for i, row in enumerate(cos)}
    first = {i: min((k, c) for c, k in zip(row, ids) if c > 0.3) for i, row in enumerate(cos) if (row > 0.3).any()}
    for block in (1 << 20, 100):  # one block, and several
        got = retrieval.nearest_query(items, queries, block_bytes=block).collect()
        assert {r.vec_id: (r.qid, r.label) for r in got} == {i: (k, i % 4 if i < 60 else 0) for i, (_, k) in nearest.items()}
        assert all(abs(r.cos + nearest[r.vec_id][0]) < 1e-9 for r in got)
        got = retrieval.first_query(items, queries, 0.3, block_bytes=block).collect()
        assert {r.vec_id: r.qid for r in got} == {i: k for i, (k, _) in first.items()} and len(got) == len(first)
    assert retrieval.nearest_query(items, queries.limit(0)).collect() == []


def test_discovery_tags_edges_with_the_phrases_that_found_them(spark):
    axis = lambda i: [float(j == i) for j in range(4)]
    texts = {1: (axis(0), "x"), 2: (axis(1), "y"), 3: (axis(2), "z"), 4: (axis(3), None)}
    chunks = spark.createDataFrame([(i, e, x) for i, (e, x) in texts.items()], "chunk_id long, embedding array<double>, text string")
    seen = []

    def embed(d):
        seen.extend(r["query"] for r in d.collect())
        at = F.when(F.endswith("query", F.lit("perubahan")), 0).otherwise(1) + F.when(F.contains("query", F.lit("No. ")), 2).otherwise(0)
        return d.withColumn("q", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.when(j == at, 1.0).otherwise(0.0)))

    def extract(d):
        edge = lambda law, action, day, ids: f"named_struct('by_law', '{law}', 'action', '{action}', 'day', cast({day} as date), 'evidence', array({ids}))"
        all_of = [edge("2/2015", "mengubah", "'2015-06-01'", "1L, 3L, 77L"), edge("3/2016", "mencabut", "null", "2L"), edge("4/2016", "unknown", "null", "2L"), edge(" ", "mencabut", "null", "2L")]
        return d.withColumn("edges", F.expr(f"array({', '.join(all_of)})"))

    asked = spark.createDataFrame([(1, "32/2009", datetime.date(2015, 6, 1)), (2, "32/2009", datetime.date(2015, 5, 31)), (3, "32/2009", None), (4, None, None)], "qid long, law string, on date")
    met = amend.found_by_phrases(asked, ["perubahan", "dicabut"], chunks, embed, k=1).collect()
    assert {(r.chunk_id, r.n, r.phrase) for r in met} == {(1, 0, "perubahan"), (3, 1, "perubahan"), (2, 2, "dicabut"), (4, 3, "dicabut")}
    assert sorted(seen)[0] == "Undang-undang (UU) No. 32 Tahun 2009 dicabut" and len(seen) == 4
    got = {(r.qid, r.by_law): (r.evidence, r.phrases) for r in amend.discovered(asked, ["perubahan", "dicabut"], chunks, embed, extract, k=1).collect()}
    early = ([1, 3], ["perubahan"])
    assert got == {(1, "2/2015"): early, (3, "2/2015"): early, **{(q, "3/2016"): ([2], ["dicabut"]) for q in (1, 2, 3)}}
    assert amend.discovered(asked.limit(0), ["perubahan"], chunks, embed, extract, k=1).collect() == []


def test_the_loop_carries_its_history(spark):
    q = spark.createDataFrame([(1, "aaaa"), (2, "a"), (3, "bbbbbb"), (4, "cc")], "qid int, query string")
    told = lambda d: d.withColumn("accepted", F.when(F.col("qid") != 4, F.length("answer") < 3)).withColumn("feedback", F.concat(F.lit("seen "), F.size("history")))
    shorter = lambda d: d.withColumn("query", F.when(F.col("qid") != 4, F.substring("query", 2, 9)).otherwise(" "))
    got = {(r.qid, r.round): r for r in retrieve.judge_loop(q, lambda d: d.withColumn("answer", F.col("query")), told, shorter, 3).collect()}
    assert {k: (r.accepted, r.at_cap, r.modified, r.feedback) for k, r in got.items()} == {
        (1, 1): (False, False, "aaa", "seen 0"), (1, 2): (False, False, "aa", "seen 1"), (1, 3): (True, False, None, "seen 2"), (2, 1): (True, False, None, "seen 0"),
        (3, 1): (False, False, "bbbbb", "seen 0"), (3, 2): (False, False, "bbbb", "seen 1"), (3, 3): (False, True, None, "seen 2"),
        (4, 1): (False, False, "cc", "seen 0"), (4, 2): (False, False, "cc", "seen 1"), (4, 3): (False, True, None, "seen 2"),
    }
    assert retrieve.judge_loop(q.limit(0), lambda d: d.withColumn("answer", F.col("query")), told, shorter).collect() == []
