"""Operators on hand-made rows: the cases that the tables do not hold."""

import datetime
import itertools
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docgraph import plans, providers
from docgraph.functions import html, legal, text, tokens, vectors
from docgraph.operators import chunking, evaluation, extraction, graph, logs, retrieval, temporal
from docgraph.plans import amend, retrieve
from docgraph.sources import io
from docgraph.streaming import events


def values(spark, column, cases, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, s {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("s"))).collect()]


def test_text_rules(spark):
    assert values(spark, text.slug, ["  A\t b\n", None, "É"]) == ["a b", "", "é"]
    assert values(spark, text.predicate, ["Is-Part of!", None, "***"]) == ["is_part_of", "rel", "rel"]
    assert values(spark, text.label, ["__A b--C!"]) == ["a_b_c"]
    assert values(spark, text.clamp_unit, ["-1", "2", "x", None, "0.25"]) == [0.0, 1.0, 0.5, 0.5, 0.25]
    assert values(spark, text.tokens_at_index, ["", "abc", "a" * 8]) == [1, 1, 2]
    assert values(spark, text.language, ["Menurut pasal 5", "the act says", "yang dan the", "", None]) == ["id", "en", "id", "en", "en"]
    assert values(spark, text.duration_seconds, ["1m 44.83s", "30.5 s", "1h 2m 3.00s", "350 ms"]) == [pytest.approx(104.83), 30.5, 123.0, None]
    assert values(spark, text.format_seconds, [104.83, 3.5, None], "double") == ["1m 44.83s", "3.50s", "N/A"]
    assert values(spark, text.choice_letter, [" a ", "choice: B", "xcx", "", None]) == ["A", "B", "C", None, None]
    assert values(spark, text.page_numbers, ["3-5, 7, 3", ""]) == [[3, 5, 7], []]
    assert values(spark, text.delimited, ["a; ;b ;"]) == [["a", "b"]]
    assert values(spark, text.looks_corrupted, ["", "plain words here", "bad �", "x" * 40, None]) == [True, False, True, True, True]
    assert values(spark, text.route, ["bunyi pasal 3", "hubungan antara", "Alpha Beta Gamma", "uu 3", "hm"]) == ["naiverag", "graphrag", "graphrag", "naiverag", "graphrag"]
    assert values(spark, text.file_name_part, ["A b--c!", "!!", None]) == ["a-b-c", "unknown", "unknown"]
    assert values(spark, text.rate_limit_kind, ["quota hit", "Too many requests", None]) == ["quota", "rpm", "unknown"]


def test_legal_rules(spark):
    day = datetime.date
    assert values(spark, legal.parse_date, ["1 Januari 2020", "31-12-99 x", "on 2020-02-29", "31/02/2020 and 2021-01-05", "3 Foo 2020", None]) == [day(2020, 1, 1), day(2099, 12, 31), day(2020, 2, 29), day(2021, 1, 5), None, None]
    assert values(spark, legal.law_number, ["UU 4 / 2009", "Undang-Undang Nomor 12 Tahun 2011", "uu no. 3 tahun 2001", "none", None]) == ["4/2009", "12/2011", "3/2001", None, None]
    assert values(spark, legal.regulation_id, ["UU No. 16 Tahun 2025", "x"]) == ["16_2025", None]
    today = F.lit("2024-05-01").cast("date")
    got = values(spark, lambda s: legal.as_of(s, today), ["per 1 Mei 2019 apa", "terbaru per 01-01-2000", "pada 2018-03-04", ""])
    assert [(g.mode, g.day) for g in got] == [("as_of", day(2019, 5, 1)), ("latest", day(2024, 5, 1)), ("as_of", day(2018, 3, 4)), ("latest", day(2024, 5, 1))]
    keys = spark.createDataFrame([("Act", "UU Minerba", "4/2009"), ("Act", "UU Minerba", None), ("Article", "Pasal 1", "4/2009"), ("LawAddition", "Sisip!", "4/2009"), ("Person", "É Ä", "1/2")], "k string, t string, u string")
    assert [r[0] for r in keys.select(legal.entity_key(F.col("t"), F.col("k"), F.col("u"))).collect()] == ["Act::uu-4-2009", "Act::uu-minerba", "Article::uu-4-2009::pasal-1", "LawAddition::uu-4-2009-sisip", "Person::é-ä"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 2.0, 9.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(2**-0.5) and got[1] == 0 and got[3] == 0 and got[2] == pytest.approx(5 / (86**0.5 * 5**0.5))


@pytest.mark.parametrize("most, least, overlap", [(1024, 512, 256), (10, 4, 3)])
def test_windows_cover(spark, most, least, overlap):
    sizes = [0, 1, most, most + 1, most + most // 4, most + (most - overlap) - 1, most + (most - overlap), 5 * most + 3, *range(most, 3 * most, 7)]
    df = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", chunking.token_windows(F.col("n"), most, least, overlap).alias("w"))
    for r in df.collect():
        if r.n <= most:
            assert [(w.start, w.end) for w in r.w] == ([(0, r.n)] if r.n else [])
            continue
        assert r.w[0].start == 0 and r.w[-1].end == r.n
        assert all(least <= w.end - w.start <= most for w in r.w)
        assert all(b.start > a.start and b.start <= a.end for a, b in itertools.pairwise(r.w))


def test_bins_and_batches(spark):
    files = spark.createDataFrame([("d", i, s) for i, s in enumerate([9, 8, 7, 6, 5, 4, 3])], "part string, id long, size long")
    load = files.sparkSession.createDataFrame(chunking.lightest_bin(files, 3).collect()).groupBy("bin").agg(F.sum("size")).collect()
    assert max(r[1] for r in load) <= 4 / 3 * 14 + 1
    items = spark.createDataFrame([("d", i, t) for i, t in enumerate([5, 5, 9, 1, 1, 1, 20, 1])], "d string, i long, t long")
    got = {r.i: r.batch for r in chunking.greedy_batches(items, "d", "i", "t", 3, 10).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 7: 4}


def test_kappa_golden(spark):
    rows = [(h, k, n) for h, line in enumerate([[27, 4, 0], [3, 12, 8], [0, 9, 37]]) for k, n in enumerate(line)]
    df = spark.createDataFrame(rows, "human int, llm int, n int")
    assert [round(evaluation.kappa(df, "human", "llm", w).first().kappa, 4) for w in ("none", "linear", "quadratic")] == [0.6265, 0.7391, 0.8373]


def test_wilcoxon(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (0, 1), (1, 1), (2, 1)], "a int, b int")
    r = evaluation.wilcoxon(df, "a", "b").first()
    assert (r.v, r.n) == (8.0, 4)  # ranks 2, 4, (2), 2


def test_wilcoxon_of_many_pairs(spark):
    n = 3_000_000  # the cube of n passes a long's range
    r = evaluation.wilcoxon(spark.range(n).selectExpr("if(id % 3 = 0, 0, 1) as a", "if(id % 3 = 0, 1, 0) as b"), "a", "b").first()
    v, mean, var = 2 * n // 3 * (n + 1) / 2, n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - (n**3 - n) / 48
    assert (r.v, r.n) == (v, n) and abs(r.z - (v - mean) / var**0.5) < 1e-5
    s = evaluation.signed_rank(spark.range(n).selectExpr("if(id % 3 = 0, 0, 1) as a", "if(id % 3 = 0, 1, 0) as b"), "a", "b").first()
    assert (s.v, s.n) == (v, n)


def test_judge_tie(spark):
    df = spark.createDataFrame([("x", 2), ("x", 0), ("y", 1), ("y", 1), ("y", -1), ("z", 0)], "label string, score int")
    got = {r.label: (r.total, r.n, r.pct, r.winner) for r in evaluation.judge_summary(df).collect()}
    assert got == {"x": (2, 2, 50.0, True), "y": (2, 2, 50.0, True), "z": (0, 1, 0.0, False)}


def test_upserts(spark):
    df = spark.createDataFrame([("k", 1, None, "a"), ("k", 2, "n", "b"), ("k", 3, "m", None)], "k string, seq int, name string, kind string")
    assert graph.upsert_first_wins(df, "k", ["name", "kind"], "seq").first()[1:] == ("n", "a")
    assert graph.upsert_last_wins(df, "k", ["name", "kind"], "seq").first()[1:] == ("m", None)
    there, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, graph.merge_into(there, new, "k").collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_expand_cycle_and_limit(spark):
    e = spark.createDataFrame([("1", "a", "p", "b"), ("2", "b", "p", "a"), ("3", "b", "q", "c"), ("4", "c", "p", "d")], "uid string, s string, p string, o string")
    start = spark.createDataFrame([("a",)], "node string")
    got = lambda **k: {(r.uid, r.hop) for r in graph.expand(e, start, **k).collect()}
    assert got(hops=1) == {("1", 1)} and got(hops=5) == {("1", 1), ("2", 2), ("3", 2), ("4", 3)}
    assert got(hops=5, allowed=F.col("p") == "p") == {("1", 1), ("2", 2)} and got(hops=3, per_hop=1) == {("1", 1), ("2", 2)}


def test_pairs_and_chain(spark):
    rows = [(1, "A", "mengubah", "B"), (2, "A", "mengubah", "B"), (3, "B", "diubah_dengan", "A"), (4, "B", "diubah_dengan", "A"), (5, "C", "mencabut", "D"), (6, "E", "dicabut_dengan", "F")]
    e = spark.createDataFrame(rows, "seq int, source string, relationship string, target string")
    got = sorted((r.part, r.seq, r.sp) for r in graph.match_pairs(e).collect())
    assert got == [(0, 1, "B"), (0, 2, "B"), (1, 5, None), (2, 4, "B"), (2, 6, "E")]
    assert {tuple(r) for r in graph.to_passive(e.drop("seq")).collect()} == {("B", "diubah_dengan", "A"), ("D", "dicabut_dengan", "C"), ("E", "dicabut_dengan", "F")}
    c = spark.createDataFrame([("A", "diubah_dengan", "B"), ("A", "dicabut_dengan", "C"), ("C", "diubah_dengan", "D"), ("D", "diubah_dengan", "C")], "source string, relationship string, target string")
    s = spark.createDataFrame([("A",), ("Z",)], "node string")
    assert {(r.start, r.relevant, r.n_edges) for r in graph.chain_with_reset(c, s).collect()} == {("A", "C,B,D", 4), ("Z", "Z", 0)}


def test_status_rules(spark):
    d = datetime.date
    rows = [("1/2000", "amended", "2/2001", d(2001, 1, 1), "a"), ("1/2000", "amended", "3/2005", d(2005, 1, 1), "b"), ("1/2000", "repealed", "4/2010", d(2010, 1, 1), "c"), ("5/2000", "amended", "6/2001", None, "d")]
    i = spark.createDataFrame(rows, "law string, kind string, by_law string, day date, uid string")
    on = lambda day: {r.law: (r.is_repealed, r.repealed_by, r.amended_by) for r in temporal.status(i, F.lit(day).cast("date")).collect()}
    assert on("2003-01-01") == {"1/2000": (False, None, "2/2001"), "5/2000": (False, None, "6/2001")}
    assert on("2006-01-01")["1/2000"] == (False, None, "3/2005") and on("2011-01-01")["1/2000"] == (True, "4/2010", None)
    line = temporal.lineage(temporal.status(i, F.lit("2011-01-01").cast("date"))).orderBy("law").collect()
    assert line[0].line == "UU 1/2000 telah dicabut oleh UU 4/2010 (efektif 01-01-2010)." and "tanggal tidak jelas" in line[1].line


def test_mmr_against_loop(spark):
    r = np.random.default_rng(0)
    e = r.normal(size=(20, 5))
    score = r.random(20)
    df = spark.createDataFrame([(0, i, float(score[i]), e[i].tolist()) for i in range(20)], "qid long, id long, score double, embedding array<double>")
    unit = e / np.linalg.norm(e, axis=1)[:, None]
    left, out = sorted(range(20), key=lambda i: -score[i]), []
    while left and len(out) < 6:
        best = max(left, key=lambda i: 0.7 * score[i] / score.max() - 0.3 * max([0.0, *(float(unit[i] @ unit[j]) for j in out)]))
        out.append(best)
        left.remove(best)
    assert [x.id for x in retrieval.mmr(df, 6).orderBy("rank").collect()] == out


def test_fusion_is_symmetric(spark):
    df = spark.createDataFrame([(0, 1, 1, 0.9), (0, 2, 2, 0.8), (1, 2, 1, 0.7), (1, 1, 2, 0.6)], "qid int, vec_id int, rank int, cos double")
    got = {r.vec_id: r.fused for r in retrieval.fuse(df, "vec_id").collect()}
    assert got[1] == got[2] == pytest.approx(1 / 61 + 1 / 62)


def test_extraction(spark):
    p = spark.createDataFrame([(1, "Same text here", "same  text here", False), (2, "abc", None, False), (3, None, "xyz", False), (4, "alpha", "omega zz", False), (5, None, None, False), (6, "same text", "same text", True)], "id int, text string, ocr string, scanned boolean")
    got = {r.id: (r.final_text_source, r.duplicates_merged, r.final_text) for r in extraction.choose_text(p).collect()}
    assert got == {1: ("regular", True, "Same text here"), 2: ("regular", False, "abc"), 3: ("ocr", False, "xyz"), 4: ("both", False, "alpha omega zz"), 5: ("none", False, ""), 6: ("ocr", True, "same text")}
    assert all(r.mismatches == 0 for r in extraction.length_report(extraction.choose_text(p)).collect())
    assert values(spark, extraction.repaired_json, ['x ```json\n{"a": [1, 2,], }``` y', "{broken", '{"t": "a } b"}', None]) == ['{"a": [1, 2]}', None, '{"t": "a } b"}', None]
    assert values(spark, extraction.halves, ["aaaa. bbbb", "xxxx", None]) == [["aaaa. ", "bbbb"], ["xx", "xx"], ["", ""]]
    assert extraction.missing_numbers(spark.createDataFrame([(0,), (1,), (4,)], "n int"), "n").orderBy("n").collect() == [(0, "extra"), (2, "missing"), (3, "missing")]


def test_split_and_retry(spark):
    items = spark.createDataFrame([("a", "x" * 40), ("b", "short")], "id string, text string")
    good, bad = extraction.split_and_retry(items, lambda d: d.withColumn("error", F.when(F.length("text") > 12, "long")), 2)
    assert {r.id for r in good.collect()} == {"b", "a::part1::part1", "a::part1::part2", "a::part2::part1", "a::part2::part2"} and bad.count() == 0


def test_providers_and_loop(spark):
    df = spark.createDataFrame([(1, "One. Two."), (2, "One. Two."), (3, None)], "i int, t string")
    assert {r.i: r.g for r in providers.apply(df, "t", "g", providers.generate, "string").collect()} == {1: "One.", 2: "One.", 3: None}
    assert json.loads(providers.extract(pd.Series(["Alice met Bob. none"]))[0]) == [{"subject": "Alice", "predicate": "met", "object": "Bob"}]
    assert np.linalg.norm(providers.embed(pd.Series(["a b c"]))[0]) == pytest.approx(1)
    q = spark.createDataFrame([(1, "aaaa"), (2, "a")], "qid int, query string")
    got = retrieve.judge_loop(q, lambda d: d.withColumn("answer", F.col("query")), lambda d: d.withColumn("accepted", F.length("answer") < 3), lambda d: d.withColumn("query", F.substring("query", 2, 9)), 5)
    assert sorted((r.qid, r.round, r.accepted) for r in got.collect()) == [(1, 1, False), (1, 2, False), (1, 3, True), (2, 1, True)]


def test_logs(spark):
    df = spark.createDataFrame([(1, "head\n[Iter 2/3] go\nn=3\n[Iter 3/3]\nn=4 n=x n=5")], "k int, value string")
    got = logs.with_iteration(logs.lines(df, "k"), "k").orderBy("line").collect()
    assert [r.iteration for r in got] == [1, 2, 2, 3, 3]
    r = df.select(logs.first_match(F.col("value"), [r"zz(\d)", r"n=(\d)"]), logs.last_match(F.col("value"), r"n=(\d)"), logs.sum_matches(F.col("value"), r"n=(\w)")).first()
    assert tuple(r) == ("3", "5", 12)
    assert values(spark, logs.question_id, ["a_id17_x.txt", "none"]) == [17, None]


def test_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text('﻿UU_Number,Abstract\n"1","two\nlines"\n', encoding="utf-8")
    df = io.read_csv(spark, str(tmp_path / "c.csv"))
    assert df.columns == ["UU_Number", "Abstract"] and df.first().Abstract == "two\nlines"
    (tmp_path / "j.jsonl").write_text('{"id": 1}\nbroken\n{"id": 2}\n')
    assert sorted(r.id for r in io.read_jsonl(spark, str(tmp_path / "j.jsonl"), "id int").collect() if r.id) == [1, 2]
    io.write_csv(spark.createDataFrame([("a", None)], "x string, y string"), str(tmp_path / "out"), ["y", "x", "z"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["y", "x", "z"]
    (tmp_path / "log_id5_.txt").write_text("a\nb")
    assert io.read_logs(spark, str(tmp_path / "log_id5_.txt")).first().value == "a\nb"
    pages = providers.pages_of(spark.createDataFrame([("f", bytearray(b"one\ftwo"))], "path string, content binary"))
    assert [(r.page_number, r.text) for r in pages.collect()] == [(1, "one"), (2, "two")]
    ids = spark.createDataFrame([("10",), ("9",), ("x",), (None,)], "id string")
    assert [r.id for r in ids.orderBy(*io.typed_order("id")).collect()] == ["9", "10", "x", None]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1, 0, 5), 1, "view", 1.0), (1, datetime.datetime(2024, 1, 1, 0, 5), 1, "view", 1.0), (2, datetime.datetime(2024, 1, 1, 2, 0), 2, "click", 2.0)], "event_id long, ts timestamp, user_id long, event_type string, value double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = events.once(stream).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.event_id for r in spark.table("once").collect()) == [1, 2]
    q = events.tumbling(stream).writeStream.format("memory").queryName("tumbling").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("tumbling").count() >= 1
    for _ in range(2):  # a second run finds nothing new
        events.append_new(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_graph_context_follows_each_questions_own_graph(spark):
    far = [0.0, 0.0, 1.0]
    entities = spark.createDataFrame([(1, "A", [1.0, 0.0, 0.0]), (2, "B", [0.0, 1.0, 0.0])], "vec_id long, key string, embedding array<double>")
    edges = [("a1", "A", "x", far), ("a2", "x", "y", far), ("a3", "y", "z", far), ("b1", "B", "v", far)]
    others = [(f"n{i}", f"m{i}", "w", [1.0, 0.9, 0.01 * i]) for i in range(5)]
    triples = spark.createDataFrame([(u, s, "p", o, e) for u, s, o, e in edges + others], "uid string, s string, p string, o string, embedding array<double>")
    questions = spark.createDataFrame([(1, [1.0, 0.1, 0.1]), (2, [0.1, 1.0, 0.1])], "qid long, q array<double>")
    for hops, mine in ((1, {"a1"}), (2, {"a1", "a2"})):
        got = retrieve.graph_context(entities, triples, questions, k_entities=1, hops=hops, k_triples=4, k_near=2).collect()
        by = {q: {r.uid for r in got if r.qid == q} for q in (1, 2)}
        assert by[1] == mine | {"n3", "n4"} and by[2] & {"a1", "a2", "a3", "b1"} == {"b1"} and len(by[2]) == 3
        assert sorted(r["rank"] for r in got if r.qid == 1) == list(range(1, len(mine) + 3))


def test_chain_is_followed_to_its_end(spark):
    deep = [(f"L{i:02}", "dicabut_dengan" if i == 13 else "diubah_dengan", f"L{i + 1:02}") for i in range(16)]
    e = spark.createDataFrame(deep, "source string, relationship string, target string")
    got = graph.chain_with_reset(e, spark.createDataFrame([("L00",)], "node string")).collect()
    assert [(r.relevant, r.n_edges) for r in got] == [("L14,L15,L16", 16)]


def test_question_names_keep_every_digit(spark, tmp_path):
    spark.createDataFrame([(7,), (123,), (1234,), (12345,)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.qid: r.name for r in plans.QUERIES["question_ids"](spark, str(tmp_path)).collect()}
    assert list(map(str, got)) != [] and set(got.values()) == {"007", "123", "1234", "12345"}


def test_containing_equals_brute_force(spark):
    r = random.Random(5)
    words = ["ab", "c", "dé", "e", "ff"]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for i in range(60)] + [(70, None), (71, "x\nab c")]
    items = [(i, r.choice(texts)[1]) for i in range(30)]
    items = [(i, t and t[r.randint(0, 3) : r.randint(4, 60)]) for i, t in items] + [(90, "ab"), (91, ""), (92, None), (93, "c dé"), (94, "zz")]
    a = spark.createDataFrame(texts, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, k) for i, t in texts for k, x in items if t is not None and x is not None and x in t)
    assert sorted(map(tuple, retrieval.containing(a, "doc_id", b, "item_id").collect())) == want
    assert sorted(map(tuple, retrieval.containing(a, "doc_id", b.where("item_id >= 90"), "item_id").collect())) == [x for x in want if x[1] >= 90]


def test_search_equals_brute_force(spark):
    r = np.random.default_rng(4)
    v = np.round(r.normal(size=(300, 5)), 1)
    v[7] = 0
    items = spark.createDataFrame([(f"i{k:03}", v[k].tolist() if k != 9 else None) for k in range(300)], "id string, embedding array<double>")
    queries = spark.createDataFrame([(k, v[k].tolist()) for k in range(0, 20)] + [(50, [1.0, 2.0])], "qid long, q array<double>")
    q = {k: v[k] for k in range(20)} | {50: np.array([1.0, 2, 0, 0, 0])}
    cos = lambda a, b: round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 6) + 0.0 if np.linalg.norm(a) * np.linalg.norm(b) else 0.0
    for size in (32 << 20, 200):
        got = {}
        for x in retrieval.search(items, queries, 7, id_col="id", block_bytes=size).collect():
            got.setdefault(x.qid, {})[x["rank"]] = (x.id, x.cos)
        for k, b in q.items():
            want = sorted(((-cos(v[i] if i != 9 else np.zeros(5), b), f"i{i:03}") for i in range(300)))[:7]
            assert [(got[k][n + 1][0], -got[k][n + 1][1]) for n in range(7)] == [(i, c) for c, i in want]
        assert retrieval.with_scores(items, queries, id_col="id", block_bytes=size).count() == 300 * 21
        mean = {x.id: x.mean_cos for x in retrieval.mean_similarity(items, queries, id_col="id", block_bytes=size).collect()}
        assert mean["i003"] == pytest.approx(np.mean([cos(v[3], b) for b in q.values()]))
    assert retrieval.search(items, queries.limit(0), 7, id_col="id").count() == 0


def test_numbering_and_windows_of_pages(spark):
    r = random.Random(2)
    rows = [(r.choice([None, "7", "12", "x", "3b"]), i) for i in range(200)]
    got = chunking.numbered(spark.createDataFrame(rows, "id string, n int"), [*io.typed_order("id"), F.col("n")], "place").collect()
    key = lambda x: (x[0] is None, not (x[0] or "").isdigit(), int(x[0]) if (x[0] or "").isdigit() else 0, x[0] or "", x[1])
    assert [(x.id, x.n) for x in sorted(got, key=lambda x: x.place)] == sorted(rows, key=key) and {x.place for x in got} == set(range(1, 201))


def test_similar_queries_equal_brute_force(spark):
    import difflib

    r = random.Random(3)
    base = ["what does the law say about water " * 3, "who repealed the act of 2009 and when was it " * 2, "short", "", "other " * 30]
    turns = []
    for c in range(12):
        for k in range(8):
            x = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 3])):
                if x:
                    x[r.randrange(len(x))] = r.choice("abc ")
            turns.append((c, k, "".join(x) if r.random() > 0.05 else None))
    got = {(x.conv_id, x.turn): x.repeats for x in retrieve.similar_queries(spark.createDataFrame(turns, "conv_id long, turn long, text string")).collect()}
    for c, k, x in turns:
        before = [y for d, j, y in turns if d == c and j < k]
        want = any(x == y or x is not None and y is not None and difflib.SequenceMatcher(None, x, y).ratio() >= 0.97 for y in before)
        assert got[c, k] == want, (c, k, x)


def test_page_fields(spark):
    page = """<div class="card-body x"><div class="fw-semibold fs-5">UU Nomor 5 Tahun 2010</div><div class="fw-bold">Status Peraturan</div>
    <div class="row"><div><div class="p fw-bold bg-light-danger">Dicabut dengan</div></div><div class="col-lg-10"><a class="text-danger">UU No. 7 Tahun 2012</a><a class="text-danger">PP No. 1 Tahun 2000</a><a>UU No. 9 Tahun 2000</a></div></div></div>
    <div class="card-body"><div class="fw-semibold fs-5">Nothing</div></div>"""
    got = values(spark, html.amendment_list, [page, "", None])
    assert [tuple(x) for x in got[0]] == [("5_2010", "dicabut_dengan", "7_2012")] and not got[1] and not got[2]
    detail = '<div class="col-lg-3 fw-bold">Tempat &amp; Waktu (x):</div><div class="col-lg-9"><b>a</b>\n b</div><div class="col-lg-3 fw-bold">T</div><div class="col-lg-9"></div>'
    assert [[tuple(y) for y in x] for x in values(spark, html.label_values, [detail, ""])] == [[("tempat__waktu_x", "a b")], []]
    assert values(spark, lambda c: html.downloads(c, "https://a.b"), ['<a href="/q.doc">x</a><a href="/z" class="download-file">y</a><a href="n">Unduh</a><a href="/q.doc">x</a>']) == [["https://a.b/z", "https://a.b/q.doc", "https://a.b/n"]]


def test_amended_answers(spark):
    edges = spark.createDataFrame([("1_2000", "diubah_dengan", "2_2001", datetime.date(2001, 1, 1)), ("2_2001", "dicabut_dengan", "3_2005", datetime.date(2005, 1, 1)), ("9_1999", "diubah_dengan", "8_1999", None)], "source string, relationship string, target string, day date")
    chunks = spark.createDataFrame([("3_2005", i, f"c{i}") for i in range(6)] + [("2_2001", 0, "two"), ("8_1999", 1, "eight")], "law string, seq long, text string")
    uses = lambda d: d.withColumn("uses", F.col("seq") != 1)
    merge = lambda d: d.withColumn("final", F.concat_ws("|", "answer", "context"))
    answers = spark.createDataFrame([(1, "a", "UU Nomor 1 Tahun 2000"), (1, "b", "No. 9 Tahun 1999"), (2, "a", "none")], "qid long, pipeline string, answer string")
    join = lambda d: d.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("answer")), " + ").alias("answer"))
    before = {x.qid: x.answer for x in amend.before_aggregation(answers, edges.drop("day"), chunks, uses, merge, join).collect()}
    assert before == {1: "No. 9 Tahun 1999 + UU Nomor 1 Tahun 2000|c0\nc2", 2: "none"}  # a repeal leaves its law alone; chunk 1 is not used
    after = {x.qid: x.answer for x in amend.after_aggregation(answers, edges.drop("day"), chunks, uses, merge, join).collect()}
    assert after == {1: "No. 9 Tahun 1999 + UU Nomor 1 Tahun 2000|c0\nc2", 2: "none"}
    q = spark.createDataFrame([(1, "UU 1/2000 per 01-06-2002"), (2, "UU 1/2000 terbaru"), (3, "x as of 2002-01-01")], "qid long, query string")
    base = lambda d: d.withColumn("answer", F.when(F.col("qid") < 3, "Nomor 1 Tahun 2000").otherwise("Nomor 9 Tahun 1999"))
    got = {x.qid: (x.mode, x.final) for x in amend.passes(q, F.lit("2024-01-01").cast("date"), base, edges, chunks, uses, merge, lambda d: d.withColumn("final", F.col("answer"))).collect()}
    assert got == {1: ("as_of", "Nomor 1 Tahun 2000|two"), 2: ("latest", "Nomor 1 Tahun 2000|c0\nc2\nc3\nc4\nc5"), 3: ("as_of", "Nomor 9 Tahun 1999")}


def test_questions_in_parts(spark):
    q = spark.createDataFrame([(1, "a;b;a"), (2, "")], "qid long, query string")
    asked = []
    answer = lambda d: asked.append(d.count()) or d.withColumn("answer", F.upper("query"))
    got = retrieve.decomposed(q, lambda d: d.withColumn("parts", F.filter(F.split("query", ";"), lambda x: x != "")), answer, lambda d: d.select("qid", F.size("found").alias("n"), F.array_join(F.transform("found", lambda x: x["answer"]), ",").alias("answer")))
    assert {tuple(x) for x in got.collect()} == {(1, 3, "A,B,A"), (2, 1, "")} and asked == [3]


def test_tokenizers(spark):
    letters = tokens.Vocabulary("none", lambda path: (lambda s: [ord(c) for c in s], lambda ids: "".join(map(chr, ids))))
    df = spark.createDataFrame([("one  two\nthree",), (None,), ("",)], "t string")
    for kind, back in ((tokens.Words(), ["one two three", "", ""]), (letters, ["one  two\nthree", "", ""])):
        assert [r.x for r in df.select(kind.decode(kind.encode(F.col("t"))).alias("x")).collect()] == back
    w = df.select(tokens.windows(tokens.Words(), F.col("t"), 2, 1).alias("w")).collect()
    assert [r.w for r in w] == [[["one", "two"], ["two", "three"]], [], []]


def test_providers_results_over_tables(spark, sf):
    """What the provider queries give, against the same stand-ins called one text at a time."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in plans.QUERIES["embed_chunks"](spark, sf).collect()}
    assert all(got[i].n == providers.DIMENSIONS and got[i].norm == pytest.approx(sum(x * x for x in providers.embed(pd.Series([t]))[0]), abs=1e-6) for i, t in docs.items())
    rows = {}
    for r in plans.QUERIES["extract_triples"](spark, sf).collect():
        rows.setdefault(r.doc_id, []).append((r.seq, r.subject, r.object))
    for i, t in docs.items():
        assert sorted(rows.get(i, [])) == [(k, x["subject"], x["object"]) for k, x in enumerate(json.loads(providers.extract(pd.Series([t]))[0]))]
    judged = {r.doc_id: r for r in plans.QUERIES["qa_generate_verify"](spark, sf).collect()}
    for i, t in docs.items():
        question = providers.generate(pd.Series([t]))[0]
        assert (judged[i].chars, judged[i].score) == (len(question), providers.judge(pd.Series([question + "\n" + t]))[0])


def test_groups_are_numbered_and_parted_over_ranges(spark):
    r = random.Random(8)
    rows = [(i, r.choice(["big", "big", "big", "small", None]), r.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, by string, size long").repartition(3)
    got = {x.id: x for x in chunking.running(df, [F.col("id")], F.col("size"), "upto", ("by",), slices=7).collect()}
    parts = {x.id: x.part for x in chunking.even_parts(df, "by", "id", 6, "part").collect()}
    for group in ("big", "small", None):
        mine = [x for x in rows if x[1] == group]
        assert [got[x[0]].upto for x in mine] == list(itertools.accumulate(x[2] for x in mine))
        want = [k + 1 for k, piece in enumerate(np.array_split(np.arange(len(mine)), 6)) for _ in piece]
        assert [parts[x[0]] for x in mine] == want
