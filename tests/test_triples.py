"""Triples through the table function: several a sentence, partial failures, unknown chunks, batches that fail."""

import json

import pytest

from docgraph.operators import triples


@pytest.fixture
def model():
    # a function of a function goes to the workers with its code
    def model(ids, texts):
        """Raises for prompts of over 60 characters, answers in no JSON where a text says so, and names a chunk that nobody asked about."""
        if sum(map(len, texts)) > 60:
            raise RuntimeError("too long")
        if any("garbled" in t for t in texts):
            return "Sorry, I can't."
        said = []
        for i, t in zip(ids, texts):
            words = t.split()
            found = [{"subject": a, "predicate": "Is  Next-To", "object": b, "confidence": c} for a, b, c in zip(words, words[1:], (7, -1, "x", 0.25, 0.25, 0.25, 0.25))]
            said.append({"chunk_id": i, "triples": found + ([{"subject": "only"}] if "half" in t else [])})
        return json.dumps({"results": [*said, {"chunk_id": "stranger", "triples": [{"subject": "a", "object": "b"}]}]})

    return model


def test_triples_and_failures(spark, model):
    rows = [("a", "one two three"), ("b", "half done"), ("c", None), ("d", ""), ("e", "this is garbled"), ("f", "x " * 20 + "\n\n" + "y " * 20), (None, "lost words"), ("g", "four five"), ("a", "six seven"), ("h", "z" * 2000)]
    df = spark.createDataFrame(rows, "id string, text string").coalesce(1)
    found, failed = triples.extract(df, model, items=4, characters=200, depth=3)
    got = {(r.chunk_id, r.subject, r.object, r.confidence) for r in found.collect() if "::" not in r.chunk_id}
    assert got == {("a", "one", "two", 1.0), ("a", "two", "three", 0.0), ("a", "six", "seven", 1.0), ("b", "half", "done", 1.0), ("g", "four", "five", 1.0)}
    parts = {r.chunk_id for r in found.collect() if r.chunk_id.startswith("f")}
    assert parts == {"f::part1", "f::part2"}
    bad = [(r.chunk_id, r.error) for r in failed.collect()]
    assert ("b", "triple") in bad
    assert {i.split("::")[0] for i, e in bad if e.startswith("answer")} == {"e"}  # alone in the end, in parts as far as it goes
    assert {i.split("::")[0] for i, e in bad if e.startswith("call")} == {"h"}
    assert "stranger" not in {r.chunk_id for r in found.collect()} | {i for i, _ in bad}
    assert {r.predicate for r in found.collect()} == {found.first().predicate}


def test_called_from_sql(spark, model):
    triples.register(spark, model, "some_triples")
    rows = spark.sql("select t.chunk_id, t.seq, t.subject, t.object from values (array('p', 'q'), array('u v w', 'n m')) as b(ids, texts), lateral some_triples(b.ids, b.texts) as t where array_contains(b.ids, t.chunk_id)").collect()
    assert sorted(map(tuple, rows)) == [("p", 0, "u", "v"), ("p", 1, "v", "w"), ("q", 0, "n", "m")]


@pytest.mark.parametrize("items,characters", [(1, 10), (3, 25), (100, 10**6)])
def test_batches_hold_every_chunk(spark, items, characters):
    rows = [(str(i), "w" * (i * 7 % 31)) for i in range(50)]
    got = triples.batches(spark.createDataFrame(rows, "id string, text string").repartition(3), items, characters).collect()
    assert sorted((i, t) for r in got for i, t in zip(r.ids, r.texts)) == sorted(rows)
    assert all(len(r.ids) <= items and (len(r.ids) == 1 or sum(map(len, r.texts)) <= characters) for r in got)


def test_nothing(spark, model):
    found, failed = triples.extract(spark.createDataFrame([], "id string, text string"), model)
    assert found.collect() == [] == failed.collect()
