"""Triples from chunks by a table function: batches to a model, its answers by lateral join, failed batches in halves again."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.functions.session import cut
from docgraph.functions.text import predicate
from docgraph.operators.extraction import halves

#: What the model is asked for a batch: chunk ids and texts in, JSON out.
Provider = Callable[[list[str], list[str]], str]
_ROW = "chunk_id string, seq int, subject string, predicate string, object string, quote string, confidence double, error string"


def table_function(provider: Provider):
    """A table function of (ids, texts), arrays of one batch: a row for each triple of the model's answer.

    The answer is JSON: {"results": [{"chunk_id", "triples": [{"subject", "predicate", "object", "quote", "confidence"}]}]}. A
    triple without subject or object gives a row with error 'triple', the others of its chunk stay. A call that raises, or an
    answer that is no such JSON, gives one row with error 'call: ...' or 'answer: ...' for the batch.
    """

    class Extract:
        def eval(self, ids, texts):
            ids = list(ids)
            try:
                raw = provider(ids, ["" if t is None else t for t in texts])
            except Exception as e:  # whatever a model's client raises: the batch is tried again in parts, or reported
                yield ids[0], None, None, None, None, None, None, f"call: {type(e).__name__}"
                return
            try:
                results = [(str(r["chunk_id"]), list(r["triples"])) for r in json.loads(raw)["results"]]
            except (ValueError, KeyError, TypeError) as e:
                yield ids[0], None, None, None, None, None, None, f"answer: {type(e).__name__}"
                return
            for chunk, found in results:
                for seq, t in enumerate(found):
                    t = t if isinstance(t, dict) else {}
                    said = [str(t[x]) if t.get(x) not in (None, "") else None for x in ("subject", "predicate", "object", "quote")]
                    try:
                        sure = float(t.get("confidence", 0.5))
                    except (TypeError, ValueError):
                        sure = 0.5
                    yield chunk, seq, *said, sure, None if said[0] and said[2] else "triple"

    return F.udtf(Extract, returnType=_ROW, useArrow=True)


def register(spark: SparkSession, provider: Provider, name: str = "triples_of") -> None:
    """Makes the table function known to SQL: select t.* from batches, lateral triples_of(ids, texts) as t."""
    spark.udtf.register(name, table_function(provider))


def batches(chunks: DataFrame, items: int = 16, characters: int = 20_000) -> DataFrame:
    """(ids, texts): chunks (id string, text), in batches of up to so many items and characters; a longer text is one alone.

    A task makes the batches of its own rows, so nothing is shuffled. Chunks without an id are left out.
    """

    def run(parts):
        ids, texts, n = [], [], 0
        for part in parts:
            done = []
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                size = len(t or "")
                if ids and (len(ids) == items or n + size > characters):
                    done.append((ids, texts))
                    ids, texts, n = [], [], 0
                ids.append(i)
                texts.append(t)
                n += size
            yield _batch(done)
        yield _batch([(ids, texts)] if ids else [])

    return chunks.where("id is not null").select(F.col("id").cast("string"), "text").mapInArrow(run, "ids array<string>, texts array<string>")


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.list_(pa.string())) for k in (0, 1)], ["ids", "texts"])


def extract(chunks: DataFrame, provider: Provider, items: int = 16, characters: int = 20_000, depth: int = 4, name: str = "triples_of") -> tuple[DataFrame, DataFrame]:
    """The triples of chunks (id, text), and what failed: (chunk_id, seq, subject, predicate, object, quote, confidence) and
    (chunk_id, seq, error).

    Batches go to the model through the table function; answers on chunks that the batch does not have are dropped. A batch
    that fails is tried again in halves, a chunk alone as two parts of its text, named id::part1 and id::part2, up to
    `depth` times; what then still fails is a failure of each of its chunks. Each round's answers are written to the shared
    checkpoint folder, so no call is made again for a later round, and only failed batches' texts go along. Predicates are
    normalised, confidences lie within 0 and 1 (0.5 where none is given). An empty table gives none.
    """
    spark, left, rounds = chunks.sparkSession, batches(chunks, items, characters), []
    register(spark, provider, name)
    failed = F.col("error").startswith("call") | F.col("error").startswith("answer")
    for level in range(depth + 1):
        left.createOrReplaceTempView(f"{name}_batches")
        asked = spark.sql(f"select b.ids, b.texts, t.* from {name}_batches b, lateral {name}(b.ids, b.texts) t where array_contains(b.ids, t.chunk_id)")
        again = F.coalesce(failed, F.lit(False))
        out = cut(asked.withColumn("ids", F.when(again, F.col("ids"))).withColumn("texts", F.when(again, F.col("texts"))))
        bad = out.where("ids is not null")
        rounds.append(out.where("ids is null"))
        if level == depth or bad.isEmpty():
            rounds.append(bad.withColumn("chunk_id", F.explode("ids")))
            break
        n = F.size("ids")
        half = F.ceil(n / 2).cast("int")
        several = bad.where(n > 1).select(F.explode(F.array(*[F.struct(F.slice("ids", a, b).alias("ids"), F.slice("texts", a, b).alias("texts")) for a, b in ((F.lit(1), half), (half + 1, n - half))])).alias("x")).select("x.*")
        alone = bad.where(n == 1).select(F.col("ids")[0].alias("id"), F.posexplode(halves(F.coalesce(F.col("texts")[0], F.lit("")))).alias("k", "text"))
        alone = alone.select(F.array(F.concat("id", F.lit("::part"), (F.col("k") + 1).cast("string"))).alias("ids"), F.array("text").alias("texts"))
        left = several.unionByName(alone)
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    found = every.where("error is null").select("chunk_id", "seq", "subject", predicate(F.coalesce("predicate", F.lit(""))).alias("predicate"), "object", "quote", sure.alias("confidence"))
    return found, every.where("error is not null").select("chunk_id", "seq", "error")
