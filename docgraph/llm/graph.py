"""Connected components as a Spark job: tasks turn the edges they read into stars, whose nodes then move on to their root's root, in rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import Tables, unsent


def _star(u: np.ndarray, v: np.ndarray, moved: np.ndarray) -> pa.RecordBatch:
    """Some edges u > v as an edge from each node to the least that they reach; moved: whether any was, or these are other edges."""
    node, at = np.unique(np.r_[u, v], return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(node))
    x, y = a, b
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
    leaf = np.flatnonzero(root != np.arange(len(node)))
    other = moved.any() or (root[at[: len(u)]] != at[len(u) :]).any()
    return pa.RecordBatch.from_arrays([pa.array(node[leaf]), pa.array(node[root[leaf]]), pa.array(np.full(len(leaf), other))], ["u", "v", "moved"])


def _stars(edges: DataFrame, most: int) -> DataFrame:
    """(u, v, moved) of (u, v, moved): each task's edges u > v as stars, some `most` edges at a time."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n >= most:
                yield _star(*[np.concatenate(x) for x in zip(*held)])
                held, n = [], 0
        if n:
            yield _star(*[np.concatenate(x) for x in zip(*held)])

    return edges.select("u", "v", F.lit(False).alias("moved")).mapInArrow(run, "u long, v long, moved boolean")


def pointers(edges: DataFrame, rounds: int = 50, most: int = 1 << 20) -> DataFrame:
    """(node, root) for every node of the undirected edge table (a, b) that is not the least that it can reach, root.

    Each round, every task that reads edges turns them into stars, every edge (u, v) with u > v moves on to the least node that
    v points to, and all nodes that one node points to are then tied to the least of them. A node points to one node for each
    `most` edges read at most, so none fills a task. Every round's edges are written to the shared checkpoint folder and the
    round's before are dropped. Raises if `rounds` rounds do not suffice.
    """
    tables = Tables(edges.sparkSession, "components")
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    e = tables.keep(edges.where("a <> b").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.lit(False).alias("moved")))
    for _ in range(rounds):
        read = _stars(e, most)
        low = read.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("to"))
        on = read.join(unsent(low), "v", "left").select("u", F.coalesce("to", "v").alias("v"), (F.col("moved") | F.col("to").isNotNull()).alias("moved"))
        tied = on.groupBy("u").agg(F.min("v").alias("to"), F.collect_set("v").alias("vs"), F.bool_or("moved").alias("moved"))
        tied = tied.select(F.explode(F.array_append("vs", F.col("u"))).alias("u"), F.col("to").alias("v"), (F.col("moved") | (F.size("vs") > 1)).alias("moved")).where("u <> v")
        old, e = e, tables.keep(tied)
        tables.drop(old)
        if not e.agg(F.bool_or("moved")).first()[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the undirected edge table (a, b): root is the least node that can be reached.

    Self-loops, repeats and both directions are allowed; nodes without an edge do not appear; an empty table gives none. See
    `pointers`, which leaves the roots themselves out.
    """
    found = pointers(edges, rounds)
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
