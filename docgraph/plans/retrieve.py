"""Whole questions: graph retrieval and the judge-and-rewrite loop, composed of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.functions import vectors
from docgraph.functions.session import cut, stored
from docgraph.operators import extraction, retrieval


def graph_context(entities: DataFrame, triples: DataFrame, questions: DataFrame, k_entities: int = 15, hops: int = 2, k_triples: int = 60, k_near: int = 20) -> DataFrame:
    """(qid, uid, score, rank): the triples to answer each question from.

    entities (vec_id, key, embedding), triples (uid, s, p, o, embedding), questions (qid, q). A question's candidates are the
    triples within `hops` of its own `k_entities` nearest entities and its `k_near` nearest triples, each once; these are
    ranked by cosine and the best `k_triples` kept. A triple near in the graph competes with `k_near` others from outside only.
    Only candidates are scored; their vectors are joined to them by uid.
    """
    triples = triples.dropDuplicates(["uid"])
    near = retrieval.search(entities, questions, k_entities)
    found = retrieval.search(triples.select("uid", "embedding"), questions, k_near, id_col="uid").select("qid", "uid")
    edges = triples.select(F.col("s").alias("node"), "uid", "o")
    seen = frontier = cut(near.select("qid", F.col("key").alias("node")).distinct())
    for _ in range(hops):
        got = cut(frontier.join(edges, "node").select("qid", "uid", "o"))
        found = found.unionByName(got.select("qid", "uid"))
        frontier = cut(got.select("qid", F.col("o").alias("node")).distinct().join(seen, ["qid", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
    scored = found.distinct().join(triples.select("uid", "embedding"), "uid").join(questions.select("qid", "q"), "qid")
    scored = scored.select("qid", "uid", (F.round(vectors.cosine(F.col("embedding"), F.col("q")), 6) + 0.0).alias("cos"))
    ranked = retrieval.top_k_per_query(scored, k_triples, "uid")
    return ranked.select("qid", "uid", F.col("cos").alias("score"), "rank")


HISTORY = "array<struct<query:string,answer:string,feedback:string,modified:string>>"


def judge_loop(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], accept: Callable[[DataFrame], DataFrame], rewrite: Callable[[DataFrame], DataFrame], rounds: int = 3) -> DataFrame:
    """(qid, round, query, answer, accepted, feedback, modified, at_cap): asks, judges and rewrites until accepted or `rounds` is reached.

    answer, accept and rewrite each take and return DataFrames: answer adds `answer` to (qid, query, history), accept adds
    `accepted` and may add `feedback`, rewrite replaces `query` where it was refused. `history` is what a question's earlier
    rounds asked, answered, were told and made of it, in order, so that judge and rewriter can avoid repeating themselves; it
    has `rounds` - 1 entries at most. Every round runs on all open questions at once; what is settled leaves the loop. An
    empty or null rewriting leaves the query as it was, a null verdict refuses, and the last round's refused answers are
    marked at_cap and not rewritten. Repeated questions keep a row each in every round.
    """
    left, out = questions.select("qid", "query", F.array().cast(HISTORY).alias("history")), None
    for n in range(1, rounds + 1):
        judged = accept(answer(left))
        told = F.col("feedback") if "feedback" in judged.columns else F.lit(None).cast("string")
        judged = cut(judged.select("qid", "query", "history", "answer", F.coalesce("accepted", F.lit(False)).alias("accepted"), told.alias("feedback")))
        settled = judged.where("accepted") if n < rounds else judged
        done = settled.select("qid", F.lit(n).alias("round"), "query", "answer", "accepted", "feedback", F.lit(None).cast("string").alias("modified"), (~F.col("accepted")).alias("at_cap"))
        if n < rounds:
            asked = rewrite(judged.where("not accepted").withColumn("__asked", F.col("query")))
            asked = cut(asked.withColumn("modified", F.coalesce(F.nullif(F.trim("query"), F.lit("")), "__asked")))
            done = done.unionByName(asked.select("qid", F.lit(n).alias("round"), F.col("__asked").alias("query"), "answer", "accepted", "feedback", "modified", F.lit(False).alias("at_cap")))
            turn = F.struct(F.col("__asked").alias("query"), "answer", "feedback", "modified")
            left = asked.select("qid", F.col("modified").alias("query"), F.concat("history", F.array(turn)).cast(HISTORY).alias("history"))
        out = done if out is None else out.unionByName(done)
    return out


def search_expansion(laws: DataFrame, phrases: list[str]) -> DataFrame:
    """(law, phrase, query): each law under both long forms with each phrase, the stated query set of an amendment search."""
    forms = F.array(*[F.concat(F.lit(f"Undang-undang (UU) {w} "), F.split("law", "/")[0], F.lit(" Tahun "), F.split("law", "/")[1]) for w in ("Nomor", "No.")])
    x = laws.select("law", F.explode(forms).alias("form"))
    return x.select("law", "form", F.explode(F.array(*[F.lit(p) for p in phrases])).alias("phrase")).select("law", "phrase", F.concat_ws(" ", "phrase", "form").alias("query"))


def similar_queries(turns: DataFrame, least: float = 0.97) -> DataFrame:
    """(conv_id, turn, repeats): whether an earlier query of the conversation has a sequence similarity of `least` or more.

    turns (conv_id, turn, text). Equal texts need no comparison and count once a conversation. Two texts at `least` differ
    in length by the factor 2 / least - 1 at most, so pairs come from an equality join on bins of the length's logarithm.
    """
    first = turns.groupBy("conv_id", "text").agg(F.min("turn").alias("first"))
    factor = 2 / least - 1
    bin_ = F.floor(F.ln(F.length("text") + 1.0) / F.ln(F.lit(factor))).cast("long")
    x = first.where("text is not null").withColumn("bin", bin_)
    early = x.select("conv_id", F.col("text").alias("other"), F.col("first").alias("before"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    pairs = x.join(early, ["conv_id", "bin"]).where("before < first and text <> other").where(F.least(F.length("text"), F.length("other")) * factor + 1 >= F.greatest(F.length("text"), F.length("other")))
    near = pairs.where(extraction.sequence_ratio(F.col("text"), F.col("other")) >= least).select("conv_id", "text").distinct().withColumn("near", F.lit(True))
    out = turns.alias("t").join(first.alias("f"), F.expr("t.conv_id <=> f.conv_id and t.text <=> f.text")).select("t.conv_id", "t.turn", "t.text", "first")
    out = out.join(near, ["conv_id", "text"], "left")
    return out.select("conv_id", "turn", ((F.col("turn") > F.col("first")) | F.coalesce("near", F.lit(False))).alias("repeats"))


def decomposed(questions: DataFrame, decompose: Callable[[DataFrame], DataFrame], answer: Callable[[DataFrame], DataFrame], aggregate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(qid, n_parts, answer): each question in parts, the parts answered, and the answers put together.

    questions (qid, query); decompose adds `parts` (array of texts; none leaves the question whole) to (query), once for each
    distinct question, answer adds `answer` to (query), once for each distinct part, aggregate turns (qid, query, found: array
    of part and answer, in order) into (qid, n_parts, answer). A null part or question has a null answer and is not answered;
    repeated questions keep a row each. Questions are told apart by their SHA-256, and a question's text is shuffled once,
    however many parts it has. Decomposers, sub-goals and intermediate questions are this with their own providers.
    """
    asked = stored(questions.select("qid", "query", F.coalesce(F.sha2("query", 256), F.lit("")).alias("__key")))
    whole = decompose(asked.groupBy("__key").agg(F.first("query").alias("query")))
    parts = stored(whole.select("__key", F.when(F.size("parts") > 0, F.col("parts")).otherwise(F.array("query")).alias("parts")))
    parts = parts.select("__key", F.posexplode("parts").alias("k", "query"))
    answers = answer(parts.select("query").where("query is not null").distinct()).select("query", "answer")
    found = parts.join(answers, "query", "left").groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("k", "query", "answer"))).alias("found"))
    return aggregate(asked.join(found, "__key").drop("__key"))


def hypothetical(questions: DataFrame, imagine: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], items: DataFrame, k: int) -> DataFrame:
    """(qid, vec_id, cos, rank): the items nearest to an imagined answer instead of the question. imagine adds `answer` to
    (qid, query), embed adds `q` to (qid, answer)."""
    q = cut(embed(imagine(questions).select("qid", "answer")).select("qid", "q"))
    return retrieval.search(items, q, k).select("qid", "vec_id", "cos", "rank")
