"""Queries that build an index and search it, states of the law on each question's own day, and calls under a rate limit."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgraph.operators import admission, ordinal, retrieval, temporal, text_index, triples, vector_index
from docgraph.plans.catalogue import RANKED, _vectors, query, t
from docgraph.plans.catalogue_wide import _folder
from docgraph.sources import named_files as files

#: An application builds the index of a table once.
_BUILT: dict[tuple[str, str], vector_index.VectorIndex] = {}


def _vector_index(spark, sf) -> vector_index.VectorIndex:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUILT:
        _BUILT[key] = vector_index.build(t(spark, sf, "embeddings").select("vec_id", "label", "embedding"))
    return _BUILT[key]


@query(f"with {RANKED} select qid, vec_id, label, cos, rank from ranked where rank <= 20")
def indexed_knn(spark, sf):
    """The exact nearest vectors through the index: the cells' radii say which may be left out."""
    return _vector_index(spark, sf).search(_vectors(spark, sf)[1], 20).select("qid", "vec_id", "label", "cos", "rank")


@query()
def indexed_knn_recall(spark, sf):
    """Of a search of the nearest cells alone, holding seven tenths of the vectors: the share of each query's true 20 nearest that it finds."""
    items, queries = _vectors(spark, sf)
    got = _vector_index(spark, sf).search(queries, 20, share=0.7, exact=False).select("qid", "vec_id", "rows_read")
    want = retrieval.search(items, queries, 20).select("qid", "vec_id")
    both = want.join(got, ["qid", "vec_id"], "left").groupBy("qid").agg(F.count("rows_read").alias("found"), F.count("*").alias("wanted"), F.max("rows_read").alias("rows_read"))
    return both.withColumn("recall", F.round(F.col("found") / F.col("wanted"), 6))


@query("select d.doc_id, w.item_id from documents d join benchmark w on contains(d.text, w.text)")
def indexed_contains(spark, sf):
    docs, items = t(spark, sf, "documents").select("doc_id", "text"), t(spark, sf, "benchmark").select("item_id", "text")
    return text_index.build(docs, "doc_id").containing(docs, "doc_id", items, "item_id")


@query("""with c as (select 'u' || page_id as uid, (page_id % 211) || '/2010' as law, page_id % 97 = 0 as repeals, (page_id % 80) || '/2015' as by_law,
  case when page_id % 13 > 0 then date '1994-01-01' + (page_id * 37 % 3000)::int end as day from pages),
q as (select conv_id, turn, (conv_id % 230) || '/2010' as law, date '1993-06-01' + ((conv_id * 7 + turn * 131) % 3500)::int as "on" from conversations),
r as (select *, coalesce(day, date '0001-01-01') as since from c where repeals qualify row_number() over (partition by law order by since, uid) = 1),
a as (select *, coalesce(day, date '0001-01-01') as since from c where not repeals qualify row_number() over (partition by law, since order by uid desc) = 1),
x as (select q.*, a.by_law as a_by, a.day as a_on from q asof left join a on q.law = a.law and q."on" >= a.since)
select conv_id, turn, x.law, "on", coalesce(r.since <= "on", false) as is_repealed, case when r.since <= "on" then r.by_law end as repealed_by, case when r.since <= "on" then r.day end as repealed_on,
  case when not coalesce(r.since <= "on", false) then a_by end as amended_by, case when not coalesce(r.since <= "on", false) then a_on end as amended_on from x left join r on x.law = r.law""")
def asof_own_day(spark, sf):
    """The law's state on the day that each question names, all days in one merge."""
    changes = t(spark, sf, "pages").selectExpr(
        "concat('u', page_id) as uid", "concat(page_id % 211, '/2010') as law", "if(page_id % 97 = 0, 'repealed', 'amended') as kind", "concat(page_id % 80, '/2015') as by_law",
        "if(page_id % 13 > 0, date_add(date '1994-01-01', cast(page_id * 37 % 3000 as int)), null) as day",
    )
    asked = t(spark, sf, "conversations").selectExpr("conv_id", "turn", "concat(conv_id % 230, '/2010') as law", "date_add(date '1993-06-01', cast((conv_id * 7 + turn * 131) % 3500 as int)) as on")
    return temporal.status_on(changes, asked)


@query("""with c as (select conv_id, turn, role, timestamp '2024-01-01' + to_seconds(conv_id // 40 * 300 + conv_id % 40) as ts from conversations),
n as (select *, row_number() over (partition by role order by ts, conv_id * 1000 + turn) - 1 as i from c),
w as (select *, max(epoch_us(ts) - i // 13 * 60000000) over (partition by role, i % 13 order by i) + i // 13 * 60000000 as go from n)
select conv_id, turn, role, epoch_us(ts) as came_us, go::bigint as goes_us, (go - epoch_us(ts))::bigint as wait_us from w""")
def rate_admission(spark, sf):
    """13 calls a minute for each role: when each turn of a conversation may go."""
    calls = t(spark, sf, "conversations").selectExpr("conv_id", "turn", "role", "conv_id * 1000 + turn as seq", "timestamp_seconds(1704067200 + conv_id div 40 * 300 + conv_id % 40) as ts")
    got = admission.admitted(calls, "role", "ts", "seq", 13, 60)
    return got.select("conv_id", "turn", "role", F.unix_micros("ts").alias("came_us"), F.unix_micros("admitted").alias("goes_us"), "wait_us")


def _neighbours(ids: list[str], texts: list[str]) -> str:
    """A stand-in for the model: in each sentence every capitalised word and the next one."""
    import json
    import re

    results = []
    for i, text in zip(ids, texts):
        named = [re.findall(r"[A-Z][a-z]+", s) for s in re.split(r"[.!?\n]", text)]
        results.append({"chunk_id": i, "triples": [{"subject": a, "predicate": "next to", "object": b} for w in named for a, b in zip(w, w[1:])]})
    return json.dumps({"results": results})


@query("""with s as (select doc_id, unnest(range(1, len(parts) + 1)) as k, unnest(parts) as s from (select doc_id, regexp_split_to_array(text, '[.!?\n]') as parts from documents)),
w as (select doc_id, k, regexp_extract_all(s, '[A-Z][a-z]+') as w from s), x as (select doc_id, k, unnest(range(1, len(w))) as i, w from w where len(w) > 1)
select doc_id::varchar as chunk_id, (row_number() over (partition by doc_id order by k, i) - 1)::int as seq, w[i] as subject, w[i + 1] as object, 0.5::double as confidence from x""")
def triples_by_table_function(spark, sf):
    """Every document in batches to a model through SQL's lateral join, as many triples a sentence as it has."""
    found, _ = triples.extract(t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), _neighbours)
    return found.select("chunk_id", "seq", "subject", "object", "confidence")


@query("""with n as (select *, coalesce(source, 'unnamed') as s, ceil(count(*) over (partition by coalesce(source, 'unnamed')) / 500) as parts from documents)
select s || case when doc_id % parts > 0 then '__' || (doc_id % parts)::int else '' end || '.jsonl' as file, count(*) as lines, min(doc_id) as least, max(doc_id) as most,
sum(length(text))::bigint as chars, bit_xor(('0x' || left(md5(coalesce(text, '')), 8))::bigint) as digest from n group by 1""")
def named_files(spark, sf):
    """Every document as a line of its source's file, 500 a file or so, written as a whole and read back by ranges of bytes."""
    there = _folder(spark, "named")
    docs = t(spark, sf, "documents").select("source", "doc_id", "text")
    files.write(docs, there, "source", F.to_json(F.struct("doc_id", "text"), {"ignoreNullFields": "false"}), ["doc_id"], most=500, ending=".jsonl", spread=F.col("doc_id"))
    d = files.read(spark, there).select(F.col("name").alias("file"), F.from_json("value", "doc_id long, text string").alias("d")).select("file", "d.*")
    digest = F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 8), 16, 10).cast("long")
    return d.groupBy("file").agg(F.count("*").alias("lines"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.sum(F.length("text")).alias("chars"), F.bit_xor(digest).alias("digest"))


@query()
def ordinal_model(spark, sf):
    """Scores of 0 to 2 by kind of event with a random intercept per user: odds ratios against the first kind, thresholds, spread."""
    scores = t(spark, sf, "events").selectExpr("user_id", "event_type", "if(value < 30, 0, if(value < 80, 1, 2)) as score")
    out = ordinal.effects(scores, "user_id", "event_type", "score")
    return out.select("term", *[F.round(c, 4).alias(c) for c in out.columns if c != "term"])
