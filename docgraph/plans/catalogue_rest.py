"""Queries over the graph's upkeep, mined logs and answers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docgraph.functions import legal, text
from docgraph.operators import evaluation, graph, logs, temporal
from docgraph.plans.catalogue import AMENDMENTS, AS_OF, CHANGES, LOGS, _amendments, _changes, _list, _logs, _with_median, query, t

# ---- the graph's upkeep --------------------------------------------------------------------------------------------


@query("""select label, count(*) as n from (select unnest(list_distinct([kind, base, 'Entity'])) as label from (select case p_partkey % 4 when 0 then 'Act' when 1 then 'Article' when 2 then 'Norm' else 'Person' end as kind,
case p_partkey % 4 when 0 then 'LegalDocument' when 1 then 'LegalDocumentContent' when 2 then 'RuleExpression' else 'Person' end as base from part)) group by label""")
def entity_labels(spark, sf):
    kind = F.expr("case p_partkey % 4 when 0 then 'Act' when 1 then 'Article' when 2 then 'Norm' else 'Person' end")
    labels = F.array_distinct(F.array(kind, legal.base_label(kind), F.lit("Entity")))
    return t(spark, sf, "part").select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("select l_partkey as key, l_suppkey as other, count(*) as n from lineitem group by all having count(*) > 1")
def duplicate_keys(spark, sf):
    return t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("other")).agg(F.count("*").alias("n")).where("n > 1")


@query("""with tr as (select distinct l_partkey, l_suppkey from lineitem)
select l_partkey, l_suppkey, p_name as subject, s_name as object from tr left join part on p_partkey = l_partkey left join (select * from supplier where s_acctbal > 0) on s_suppkey = l_suppkey""")
def triple_ends(spark, sf):
    subjects = t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("subject"))
    objects = t(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("object"))
    return t(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct().join(subjects, "l_partkey", "left").join(objects, "l_suppkey", "left")


@query("select o_orderkey, case when o_custkey in (select c_custkey from customer where c_acctbal < 0) then 'changes' else 'main' end as part from orders")
def split_by_keys(spark, sf):
    o, few = t(spark, sf, "orders"), t(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(few, "o_custkey", "left_semi").select("o_orderkey", F.lit("changes").alias("part")).unionByName(o.join(few, "o_custkey", "left_anti").select("o_orderkey", F.lit("main").alias("part")))


@query("select c_custkey, trim(c_name) || ' | ' || c_mktsegment as node, c_name || ' [lives in] ' || n_name || ' | ' || case when c_custkey % 2 = 0 then c_custkey || '/2009' else '' end || ' | ' as triple from customer join nation on n_nationkey = c_nationkey")
def embedding_texts(spark, sf):
    c = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    law = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.col("c_custkey").cast("string"), F.lit("/2009")))
    return c.select("c_custkey", legal.node_text(F.col("c_name"), F.col("c_mktsegment")).alias("node"), legal.triple_text(F.col("c_name"), F.lit("lives in"), F.col("n_name"), law, F.lit(None)).alias("triple"))


@query("""select event_id, case when event_id % 3 = 0 then 1 else 2 end::bigint as n, case when event_id % 3 = 0 then 'user' else 'user,the ' || event_type end as subjects from events""")
def query_triples(spark, sf):
    raw = F.expr("""concat('[{"subject": {"text": "user"}, "predicate": "saw", "object": {"text": "', event_id, '"}}, {"subject": {"text": "the ', event_type, '"}, "predicate": "of"', if(event_id % 3 = 0, '', ', "object": {"text": "x"}'), '}]')""")
    found = graph.complete_triples(raw)
    return t(spark, sf, "events").select("event_id", F.size(found).cast("long").alias("n"), F.array_join(F.transform(found, lambda x: x["subject"]["text"]), ",").alias("subjects"))


@query("select user_id, event_id, case when row_number() over (partition by user_id order by event_id) <= 40 then 'run' else 'deferred' end as state from events")
def call_budget(spark, sf):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return t(spark, sf, "events").select("user_id", "event_id", F.when(n <= 40, "run").otherwise("deferred").alias("state"))


@query("""select o_custkey, '[ERROR json_error] uu-' || o_custkey || '2009__p-' || min(o_orderkey) || case when count(*) > 1 then '-' || max(o_orderkey) else '' end || '__batch__' || count(*) || '__'
|| left(sha1(string_agg(o_orderkey::varchar, '|' order by o_orderkey::varchar)), 8) || '.json' as name from orders group by o_custkey""")
def error_file_names(spark, sf):
    o = t(spark, sf, "orders").select("o_custkey", F.concat(F.col("o_custkey").cast("string"), F.lit("/2009")).alias("law"), F.col("o_orderkey").alias("page"), F.col("o_orderkey").cast("string").alias("chunk_id"))
    return o.groupBy("o_custkey").agg(text.error_file_name("json error", "law", "page", "chunk_id").alias("name"))


# ---- versions ------------------------------------------------------------------------------------------------------


@query(f"""with {AMENDMENTS}, seen as (select source, relationship, target, min(seq) as seq from amendments group by all),
kinds as (select source, relationship, min(seq) as seq, string_agg('UU No. ' || replace(target, '_', ' Tahun '), ', ' order by seq) as targets from seen group by source, relationship)
select source, 'UU No. ' || replace(source, '_', ' Tahun ') || ' telah ' || string_agg(replace(relationship, '_', ' ') || ' ' || targets, '; ' order by seq) as note from kinds group by source""")
def change_notes(spark, sf):
    return temporal.change_notes(_amendments(spark, sf))


@query("""select o_orderkey, case o_orderkey % 3 when 0 then o_orderdate::date when 1 then (o_orderdate + interval 1 day)::date else make_date(2000 + o_orderkey % 20, 1, 1) end as day from orders""")
def effective_dates(spark, sf):
    o = t(spark, sf, "orders").selectExpr("o_orderkey", "if(o_orderkey % 3 = 0, concat('since ', date_format(o_orderdate, 'yyyy-MM-dd')), 'undated') as quote", "if(o_orderkey % 3 = 1, date_format(o_orderdate + interval 1 day, 'dd/MM/yyyy'), 'Pasal 3') as article", "concat('7/', 2000 + o_orderkey % 20) as law")
    return o.select("o_orderkey", temporal.effective_date(["quote", "article"], F.col("law")).alias("day"))


@query(f"""with {CHANGES}, chunks as (select doc_id as chunk_id, n_chars, case when doc_id % 2 = 0 then (doc_id % 60) || '/2010' else (doc_id % 80) || '/2015' end as law from documents),
free as (select law, chunk_id, 'operative' as kind from chunks where law not in (select law from state where is_repealed or a_by is not null) qualify row_number() over (partition by law order by chunk_id) <= 3),
best as (select s.law, chunk_id, 'amending' as kind from state s join chunks c on c.law = s.a_by where not is_repealed qualify row_number() over (partition by s.law order by n_chars desc, chunk_id) <= 3)
select * from free union all select * from best""")
def operative_text(spark, sf):
    chunks = t(spark, sf, "documents").selectExpr("doc_id as chunk_id", "doc_id as seq", "n_chars as score", "if(doc_id % 2 = 0, concat(doc_id % 60, '/2010'), concat(doc_id % 80, '/2015')) as law")
    return temporal.operative(chunks, temporal.status(_changes(spark, sf), F.lit(AS_OF).cast("date")))


# ---- mined logs ----------------------------------------------------------------------------------------------------


@query("""select event_id as qid, coalesce(quality, -1) as score from events left join labels on doc_id = event_id""")
def log_scores(spark, sf):
    paths = t(spark, sf, "events").select(F.concat(F.lit("run/q_id"), F.col("event_id").cast("string"), F.lit("_x.txt")).alias("path"))
    scores = t(spark, sf, "labels").select(F.col("doc_id").alias("qid"), "quality")
    return paths.select(logs.question_id(F.col("path")).alias("qid")).join(scores, "qid", "left").select("qid", F.coalesce("quality", F.lit(-1)).alias("score"))


@query("select doc_id from documents anti join labels using (doc_id)")
def left_to_do(spark, sf):
    return t(spark, sf, "documents").join(t(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query(rf"""with {LOGS}, l as (select user_id, unnest(string_split(value, chr(10))) as content, unnest(range(0, len(string_split(value, chr(10))))) as line from logs),
i as (select *, coalesce(last_value(try_cast(nullif(regexp_extract(content, '\[Iter (\d+)/\d+\]', 1), '') as bigint) ignore nulls) over (partition by user_id order by line rows between unbounded preceding and current row), 1) as iteration from l)
select user_id, iteration, count(*) as lines, bool_or(regexp_matches(content, 'value=\d*7$')) as accepted from i where contains(content, '[click]') group by user_id, iteration""")
def tagged_iterations(spark, sf):
    rows = logs.tagged(logs.with_iteration(logs.lines(_logs(spark, sf), "user_id"), "user_id"), "[click]")
    return rows.groupBy("user_id", "iteration").agg(F.count("*").alias("lines"), F.bool_or(F.col("content").rlike(r"value=\d*7$")).alias("accepted"))


@query(rf"""with {LOGS} select user_id, unnest(range(0, len(x))) as section, length(unnest(x)) as chars from (select user_id, regexp_split_to_array(value, '\[Iter \d+/\d+\]') as x from logs)""")
def log_sections(spark, sf):
    return logs.sections(_logs(spark, sf), "user_id", r"\[Iter \d+/\d+\]").select("user_id", F.col("section").cast("long").alias("section"), F.length("content").cast("long").alias("chars"))


@query(rf"""with {LOGS} select user_id, case when regexp_matches(value, '\[purchase\] value=\d+\n') then regexp_extract(value, '(?s)\[purchase\] value=\d+\n(.*?)(?:\[Iter|\z)', 1) end as answer from logs""")
def answer_in_log(spark, sf):
    return _logs(spark, sf).select("user_id", logs.between(F.col("value"), r"\[purchase\] value=\d+\n", r"\[Iter").alias("answer"))


DECISIONS = "case event_id % 5 when 0 then 'naive' when 1 then ' Graph ' when 2 then 'naive_fallback' when 3 then 'graphrag_fallback' else 'Other' end"


@query("""with d as (select value, case event_id % 5 when 0 then 'naiverag' when 1 then 'graphrag' when 2 then 'naiverag_fallback' when 3 then 'graphrag_fallback' else 'other' end as decision from events)
select case when contains(decision, 'graph') then 'graphrag' when contains(decision, 'naive') then 'naiverag' else decision end as base, decision, count(*) as n, round(avg(value), 4) as mean from d group by rollup (base, decision)""")
def decision_summary(spark, sf):
    d = t(spark, sf, "events").select("value", text.decision(F.expr(DECISIONS)).alias("decision"))
    return d.withColumn("base", text.base_decision(F.col("decision"))).rollup("base", "decision").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("select event_type, count(*) as n, round(sum(value), 4) as total, min(value) as least, max(value) as most, round(avg(value), 4) as mean, round(median(value), 4) as middle from events group by rollup (event_type)")
def duration_stats(spark, sf):
    v, e = F.col("value"), t(spark, sf, "events").select("event_type", "value")
    plain = e.rollup("event_type").agg(F.grouping("event_type").alias("g"), F.count("*").alias("n"), F.round(F.sum(v), 4).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.avg(v), 4).alias("mean"))
    return _with_median(plain, evaluation.medians(e, "event_type", "value", total=True), "event_type", 4)


# ---- answers -------------------------------------------------------------------------------------------------------


@query("""with seen as (select user_id, case when event_id % 4 = 0 then 'DOC-' else 'CHUNK-' end || event_type as ref, min(event_id) as first from events group by all)
select user_id, string_agg(ref, ',' order by first) as refs from seen where ref like 'CHUNK-%' group by user_id""")
def citations_of_answers(spark, sf):
    ref = F.concat(F.when(F.col("event_id") % 4 == 0, "DOC-").otherwise("CHUNK-"), F.col("event_type"))
    seen = t(spark, sf, "events").select("user_id", ref.alias("ref"), "event_id").where(F.col("ref").startswith("CHUNK-")).groupBy("user_id", "ref").agg(F.min("event_id").alias("first"))
    return seen.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "ref"))), lambda s: s["ref"]), ",").alias("refs"))


@query("""with x as (select *, row_number() over (partition by conv_id order by turn) as n from conversations)
select conv_id, string_agg('[C' || n || '] doc=' || conv_id || ' chunk=' || turn || ' | ' || role || ' | score=' || printf('%.3f', turn / 7.0::double) || chr(10) || substr(text, 1, 200) || case when length(text) > 200 then '...' else '' end, chr(10) order by n) as digest from x where n <= 3 group by conv_id""")
def chunk_digests(spark, sf):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    x = t(spark, sf, "conversations").withColumn("n", n).where("n <= 3")
    line = F.concat(F.format_string("[C%d] doc=%d chunk=%d | %s | score=%.3f\n", "n", "conv_id", "turn", "role", F.col("turn") / 7), text.clamp_chars(F.col("text"), 200))
    return x.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("x")))), lambda s: s["x"]), "\n").alias("digest"))


@query("select doc_id, (" + " + ".join(f"len(regexp_extract_all(lower(text), '{p}'))" for p in text.REFERENCE_CUES) + f" + len(regexp_extract_all(lower(text), '{text.NUMBER_CUE}')) // 4)::bigint as score from documents")
def reference_score(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.reference_score(F.col("text")).alias("score"))


@query(rf"""with w as (select doc_id, lower(text) as x, regexp_extract_all(lower(text), '[a-z]+') as ws from documents)
select doc_id, case when regexp_matches(x, '{text.HINT_ID}') or regexp_matches(x, '{text.HINT_EN}') then 0.9::double
when len(list_filter(ws, lambda v: list_contains({_list(text.WORDS_ID)}, v))) <> len(list_filter(ws, lambda v: list_contains({_list(text.WORDS_EN)}, v))) then 0.6 else 0.5 end::double as sure from w""")
def language_confidence(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.language_confidence(F.col("text")).alias("sure"))


@query("select source, count(*) as n, coalesce(min(n_chars), 0) as least, coalesce(max(n_chars), 0) as most, coalesce(round(avg(n_chars), 4), 0) as mean from documents group by source")
def score_stats(spark, sf):
    n = F.col("n_chars")
    return t(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.coalesce(F.min(n), F.lit(0)).alias("least"), F.coalesce(F.max(n), F.lit(0)).alias("most"), F.coalesce(F.round(F.avg(n), 4), F.lit(0.0)).alias("mean"))


@query("""select doc_id, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.2f KB', n / 1024.0::double) when n < 1073741824 then printf('%.2f MB', n / 1048576.0::double) else printf('%.2f GB', n / 1073741824.0::double) end as size
from (select doc_id, n_chars * (doc_id % 9 * 300 + 1) as n from documents)""")
def file_sizes(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.human_size(F.col("n_chars") * (F.col("doc_id") % 9 * 300 + 1)).alias("size"))
