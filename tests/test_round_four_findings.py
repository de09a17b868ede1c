"""What the findings of round four named: long texts for many questions, sub-goals of whole texts."""

import datetime
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docgraph import plans, providers
from docgraph.plans import amend, retrieve


@pytest.fixture
def unbroadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_long_texts_are_dealt_into_tasks(unbroadcast):
    spark, day = unbroadcast, datetime.date(2001, 1, 1)
    edges = spark.createDataFrame([("1_2000", "diubah_dengan", "2_2001", day), ("5_2000", "diubah_dengan", "6_2001", None)], "source string, relationship string, target string, day date")
    chunks = spark.createDataFrame([("2_2001", 1, "x" * 2000), ("6_2001", 1, "y" * 300)], "law string, seq long, text string")
    q = spark.range(600).selectExpr("id as qid", "'q terbaru' as query").unionByName(spark.createDataFrame([(0, None), (None, "again")], "qid long, query string"))
    law = F.when(F.col("qid") % 2 == 0, "1").when(F.col("qid") % 3 == 0, "5").otherwise("9")
    base = lambda d: d.withColumn("answer", F.when(F.col("qid") != 7, F.concat(F.lit("Nomor "), law, F.lit(" Tahun 2000"))))
    uses = lambda d: d.withColumn("uses", F.lit(True))
    merge = lambda d: d.withColumn("final", F.concat_ws("|", "answer", "context"))
    out = amend.passes(q, F.lit("2024-01-01").cast("date"), base, edges, chunks, uses, merge, lambda d: d.withColumn("final", F.col("answer")), task_bytes=20_000)
    got = out.select("qid", "final", F.spark_partition_id().alias("task")).collect()
    text = {0: "Nomor 1 Tahun 2000|" + "x" * 2000, 1: "Nomor 9 Tahun 2000", 3: "Nomor 5 Tahun 2000|" + "y" * 300}
    want = [(i, None if i == 7 else text[0 if i % 2 == 0 else 3 if i % 3 == 0 else 1]) for i in range(600)] + [(0, text[0]), (None, None)]
    assert sorted((r.qid or -1, r.final or "") for r in got) == sorted((i or -1, x or "") for i, x in want)
    tasks = {}
    for r in got:
        tasks.setdefault(r.task, []).append(len(r.final or ""))
    assert max(map(sum, tasks.values())) < sum(map(sum, tasks.values())) / 4  # of one law's questions no task has all
    for lengths in tasks.values():  # long texts come first
        assert all(a >= 300 or b < 2000 for a, b in zip(lengths, lengths[1:]))


def test_subgoals_leave_nothing_out(spark, tmp_path):
    first = "Alice met Bob. Yesterday Alice met Bob and Carol Élise! no names here\nIs it 3.5?"
    rows = [(1, first), (2, "one. two. three"), (3, None), (4, ""), (5, "..."), (1, first), (None, "Then Dave left")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.qid or 0, r.n_parts, r.answer) for r in plans.QUERIES["subgoal_answers"](spark, str(tmp_path)).collect()), key=str)
    goals = ["Alice met Bob.", "Yesterday Alice met Bob and Carol Élise!", "Yesterday rel Alice", "Alice met Bob", "Bob and Carol", "Carol rel Élise", "no names here", "Is it 3.5?"]
    alice = (1, len(goals), " ".join(goals))
    assert got == [(0, 2, "Then Dave left Then rel Dave"), alice, alice, (2, 3, "one. two. three"), (3, 1, None), (4, 1, ""), (5, 1, "...")]


def test_every_relation_of_a_sentence_is_extracted():
    text = "Alice met Bob and " + "x" * 50 + " Carol. Dan"
    assert json.loads(providers.extract(pd.Series([text, None]))[0]) == [{"subject": "Alice", "predicate": "met", "object": "Bob"}, {"subject": "Bob", "predicate": "and " + "x" * 50, "object": "Carol"}]


def test_parts_of_null_and_repeated_questions(spark):
    q = spark.createDataFrame([(1, "a;b"), (1, "a;b"), (2, None), (None, "c")], "qid long, query string")
    sent = []
    answer = lambda d: sent.extend(r.query for r in d.collect()) or providers.each(d, "query", "answer", lambda x: x.str.upper(), "string")
    join = lambda d: d.select("qid", "query", F.size("found").alias("n"), F.array_join(F.transform("found", lambda x: F.concat("query", x["query"], x["answer"])), ",").alias("answer"))
    got = retrieve.decomposed(q, lambda d: d.withColumn("parts", F.split("query", ";")), answer, join).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "a;b", 2, "a;baA,a;bbB")] * 2 + [(2, None, 1, ""), (None, "c", 1, "ccC")], key=str)
    assert sorted(sent) == ["a", "b", "c"]
