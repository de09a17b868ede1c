"""Which call a rate limit lets go when: at most so many calls of a key in any window of time, first come, first served."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType, TimestampType

from docgraph.functions.session import cut
from docgraph.operators.chunking import numbered


def admitted(calls: DataFrame, key: str, ts: str, order: str, most: int, seconds: float, piece: int = 4096) -> DataFrame:
    """calls with admitted (when the call goes, a timestamp) and wait_us: a key's calls go in the order of ts and `order`, each as
    soon as fewer than `most` of its key went within the last `seconds`; a call exactly that long ago no longer counts.

    The i-th call of a key goes at a(i) = max(ts(i), a(i - most) + seconds), so every most-th call makes a lane of its own, in
    which a(j) = j * seconds + max over m <= j of (ts(m) - m * seconds): a running maximum. Places in the order are numbered over
    ranges; a lane's maximum is taken in pieces of `piece` calls, whose maxima, a row each, are carried over those after
    them. So no task holds a key's calls, a key with most of all rows included.

    Calls without a ts never go (admitted and wait_us are null) and count for nothing; a null key is a key. Rows that tie in ts
    and `order` go in no stated order.
    """
    step = round(seconds * 1_000_000)
    placed = calls.where(F.col(ts).isNotNull()).withColumn("__key", F.struct(F.col(key).alias("k")))
    placed = numbered(placed, [F.col(ts), F.col(order)], "__i", (key,)).withColumn("__i", F.col("__i") - 1)
    came = F.unix_micros(F.col(ts).cast("timestamp"))
    j = F.floor(F.col("__i") / most)
    lanes = placed.withColumn("__lane", F.col("__i") % most).withColumn("__j", j).withColumn("__piece", F.floor(j / piece)).withColumn("__slack", came - j * step)
    lanes = cut(lanes)
    keys = ["__key", "__lane", "__piece"]
    ahead = Window.partitionBy("__key", "__lane").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    before = lanes.groupBy(*keys).agg(F.max("__slack").alias("__most")).withColumn("__before", F.max("__most").over(ahead)).drop("__most")
    within = Window.partitionBy(*keys).orderBy("__j").rowsBetween(Window.unboundedPreceding, 0)
    out = lanes.withColumn("__within", F.max("__slack").over(within)).join(before, keys)
    out = out.withColumn("__go", F.greatest("__within", "__before") + F.col("__j") * step)  # greatest passes over nulls
    out = out.withColumn("admitted", F.timestamp_micros("__go")).withColumn("wait_us", F.col("__go") - came)
    never = calls.where(F.col(ts).isNull()).withColumn("admitted", F.lit(None).cast("timestamp")).withColumn("wait_us", F.lit(None).cast("long"))
    return out.select(*never.columns).unionByName(never)


def admitted_stream(calls: DataFrame, key: str, ts: str, order: str, most: int, seconds: float) -> DataFrame:
    """As `admitted`, for a stream: (key, order, admitted, wait_us), the times of a key's last `most` admissions kept as its state.

    A batch's calls of a key go in the order of ts and `order`; a call that comes in a later batch than one of a later ts goes
    after that. A restart goes on from the checkpoint.
    """
    step = round(seconds * 1_000_000)

    def run(k, batches, state):
        ring = deque(state.get[0] if state.exists else [], maxlen=most)
        rows = pd.concat(list(batches)).sort_values([ts, order])
        came = rows[ts].astype("datetime64[us]").astype("int64").tolist()
        go = []
        for t in came:
            t = max(t, ring[-1] if ring else t, ring[0] + step if len(ring) == most else t)
            ring.append(t)
            go.append(t)
        state.update((list(ring),))
        yield pd.DataFrame({key: [k[0]] * len(go), order: rows[order].to_numpy(), "admitted": pd.to_datetime(pd.Series(go), unit="us"), "wait_us": [a - b for a, b in zip(go, came)]})

    out = StructType([calls.schema[key], calls.schema[order]]).add("admitted", TimestampType()).add("wait_us", LongType())
    return calls.where(F.col(ts).isNotNull()).groupBy(key).applyInPandasWithState(run, out, "ring array<long>", "append", "NoTimeout")
