"""What filters remove in every order: a permutation trie over persisted survivors."""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import Tables, words_of

#: The audit's filters, by letter, in the order of their bits.
NAMES = "ABCDE"


def verdicts(docs: DataFrame, labels: DataFrame, tables: Tables) -> DataFrame:
    """(part, fails, good, toxic) for each row of docs: fails has bit i where the row fails filter NAMES[i].

    A: under 200 words. B: under half of the words are distinct. C: over 2 % of the code points are A-Z. D: holds a symbol.
    E: a row of smaller doc_id has the same text. Null texts are empty, words are runs of non-space, null sources are ''.
    Texts are told apart by SHA-256. good, toxic: whether a label of the doc_id says so (several labels: any).
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].alias("id"), F.coalesce(docs["source"], F.lit("")).alias("part"), text.alias("t"))
    words = F.array(words_of(F.col("t")))  # the array of one array names the words, so that a text is split once
    few = F.transform(words, lambda w: F.struct((F.size(w) < 200).alias("a"), (F.size(F.array_distinct(w)) * 100 < F.size(w) * 50).alias("b")))[0]
    capitals = F.regexp_count("t", F.lit("[A-Z]")).cast("long") * 100 > F.length("t").cast("long") * 2
    rows = rows.select("id", "part", few.alias("w"), capitals.alias("c"), F.col("t").rlike(r"[#$%&*|]").alias("d"), F.unhex(F.sha2("t", 256)).alias("digest"))
    bit = lambda c, i: F.when(c, 1 << i).otherwise(0)
    # texts and their words end here: all that follows reads rows of some bytes
    rows = tables.keep(rows.select("id", "part", "digest", (bit(F.col("w.a"), 0) + bit(F.col("w.b"), 1) + bit(F.col("c"), 2) + bit(F.col("d"), 3)).alias("fails")))
    # kept, so that the join reads both sides as they are dealt and Spark splits a text that many rows have
    first = tables.keep(rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last"))
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    said = rows.join(first, "digest", "left").join(known, "id", "left")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    out = tables.keep(said.select("part", (F.col("fails") + bit(copy, 4)).alias("fails"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))
    tables.drop(rows, first)
    return out


def _counts(survivors: DataFrame, applied: int, n: int) -> DataFrame:
    """(part, applied, kept, edges): per part the rows that survive the filters in `applied`, and for each filter what it removes of
    them: (removed, good, toxic), zeros for those applied already."""
    edge = []
    for i in range(n):
        hit = (F.col("fails").bitwiseAND(F.lit(1 << i)) > 0) if not applied >> i & 1 else F.lit(False)
        edge.append(F.struct(F.count_if(hit).alias("removed"), F.count_if(hit & (F.col("good") == 1)).alias("good"), F.count_if(hit & (F.col("toxic") == 1)).alias("toxic"), F.count_if(hit & (F.col("fails") == 1 << i)).alias("alone")))
    return survivors.groupBy("part").agg(F.count("*").alias("kept"), F.array(*edge).alias("edges")).select("part", F.lit(applied).alias("applied"), "kept", "edges")


def walk(rows: DataFrame, n: int, tables: Tables) -> DataFrame:
    """The counts (`_counts`) of every state of the trie of all orders of n filters, over rows (part, fails, good, toxic).

    Depth first: a state's survivors are filtered from its parent's, written to the shared checkpoint folder, counted, and
    dropped once its branch is done, so at most n + 1 tables of survivors are there at a time. Prefixes of the same filters
    in another order are the same state, which is walked once: 2**n states stand for the n! orders.
    """
    found, seen = [], {0}

    def visit(applied: int, survivors: DataFrame) -> None:
        found.append(tables.keep(_counts(survivors, applied, n)))
        for i in range(n):
            then = applied | 1 << i
            if then not in seen:
                seen.add(then)
                rest = tables.keep(survivors.where(F.col("fails").bitwiseAND(F.lit(1 << i)) == 0))
                visit(then, rest)
                tables.drop(rest)

    visit(0, rows)
    states = tables.keep(*found)
    tables.drop(*found)
    return states


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every source of docs
    (doc_id, text, source, ...), every order of the five filters and each of its steps, zeros included.

    kept and removed: what the order's filters up to the step leave, and what the step's takes of what the others left.
    redundant: rows that fail the step's filter but were removed before; unique_fails: rows that fail no other; good_lost and
    toxic_lost: removed rows of such a label; shapley: what the filter removes, summed over all orders. See `verdicts` for
    the filters. A part's 32 states come together in one row, whatever the part's size. Rows of equal doc_id count each and
    are no copies of each other; a null doc_id has no label and is no copy; an empty table gives no rows.
    """
    tables, n = Tables(docs.sparkSession, "filter-audit"), len(NAMES)
    rows = verdicts(docs, labels, tables)
    states = walk(rows, n, tables)
    tables.drop(rows)
    parts = states.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("applied", F.struct("kept", "edges")))).alias("m"))
    steps = []
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order):
            after = before | 1 << i
            steps.append({"filter_order": "".join(NAMES[j] for j in order), "step": step + 1, "i": i, "before": before, "after": after})
            before = after
    # in so many orders exactly the state's filters come before a given one that is not among them
    ways = ", ".join(str(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for s in range((1 << n) - 1))
    shapley = f"transform(sequence(0, {n - 1}), i -> aggregate(map_keys(m), 0L, (a, s) -> a + if(s & shiftleft(1, i) = 0, array({ways})[s] * m[s].edges[i].removed, 0L)))"
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, i: int, before: int, after: int>>")
    wide = parts.select("part", "m", F.expr(shapley).alias("shapley"), F.inline(listed))
    of = lambda path: F.coalesce(F.expr(path), F.lit(0).cast("long"))
    edge = lambda what: of(f"m[before].edges[i].{what}")
    return wide.select(
        "part", "filter_order", "step", of("m[after].kept").alias("kept"), edge("removed").alias("removed"), (of("m[0].edges[i].removed") - edge("removed")).alias("redundant"),
        of("m[0].edges[i].alone").alias("unique_fails"), edge("good").alias("good_lost"), edge("toxic").alias("toxic_lost"), F.expr("shapley[i]").alias("shapley"),
    )
