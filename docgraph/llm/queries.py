"""The operators as queries over the corpus tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm import chat, decontaminate, filter_audit, kmeans, minhash, mixing, oracles, paragraphs, quality, rules, sharding, simhash, substrings, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(every: int, rest: int, doc_id: str = "doc_id") -> F.Column:
    """Whether the checksum of doc_id leaves this rest; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % every == rest, F.lit(False))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = substrings.dedup_substrings(_table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = F.expr("aggregate(spans, struct(0L as n, 0L as before, false as end), (a, x) -> struct(if(a.end, a.n + x - a.before, a.n) as n, x as before, not a.end as end)).n")
    return r.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op3_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.dedup_paragraphs(_table(spark, sf_dir, "documents"), least=1, wrapped=True)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return r.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~_held_out(4, 2)), seeds=toxicity.SEEDS)
    return toxicity.score(docs, lexicon).select("doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = mixing.copies(_table(spark, sf_dir, "documents"))
    return r.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql("select -1L as conv_id, turn, role, '</s>[INST] ok [/INST]' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.format_conversations(rows))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels").where(~_held_out(3, 1)))
    return quality.score(docs, model).select("doc_id", _held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rules.assess(_table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster_embeddings(_table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    named = (op1_substring_dedup, op2_decontaminate, op3_paragraph_dedup, op4_simhash, op5_shard, op6_toxicity, op7_mix, op8_chat, op9_quality, op10_rules, op11_ball_kmeans, op12_filter_audit, op13_minhash, pipeline)
    return {f.__name__: f for f in named}


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_decontaminate": rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') as w from documents),
b as (select item_id, regexp_extract_all({_LOWER}, '{_WORDS}') as w from benchmark),
bw as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i:i + 9], ' ') as win
       from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as win
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d cross join (select distinct n from bw))),
hits as (select distinct doc_id, i, n, item_id from dw join bw using (win, n)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as list
          from (select distinct doc_id, item_id::varchar as x from hits) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)""",
    "op8_chat": r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s as (select *, length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g'))
        + case role when 'user' then 15 when 'assistant' then 7 when 'system' then 13
          else 16 + length(role) + length(regexp_replace(role, '[^\\<\[\]]', '', 'g')) end as chars from c)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars
from s group by conv_id""",
}


def oracle_sql() -> dict[str, str]:
    return ORACLES | {"op7_mix": oracles.mix(), "op10_rules": oracles.line_rules(), "op11_ball_kmeans": oracles.kmeans(), "op12_filter_audit": oracles.filter_audit(), "op13_minhash": oracles.near_duplicates()}
