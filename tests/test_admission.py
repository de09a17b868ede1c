"""Admission under a rate limit, beside the limiter as a plain loop."""

import random
from collections import defaultdict, deque
from datetime import datetime, timedelta, timezone

import pytest

from docgraph.operators import admission

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
CALLS = "id long, k string, ts timestamp, __i long"


def by_loop(calls, most, seconds):
    rings, out = defaultdict(lambda: deque(maxlen=most)), {}
    for i, k, ts in sorted((c for c in calls if c[2] is not None), key=lambda c: (c[2], c[0])):
        ring, go = rings[k], ts
        if len(ring) == most:
            go = max(go, ring[0] + timedelta(seconds=seconds))
        ring.append(go)
        out[i] = go
    return out


def some_calls(seed, n=400, span=900):
    r = random.Random(seed)
    calls = [(i, r.choice(["hot"] * 6 + ["a", "b", None]), START + timedelta(seconds=r.choice([r.randrange(span), r.randrange(span // 9)]), microseconds=r.choice([0, 0, r.randrange(10**6)]))) for i in range(n)]
    return [*calls, (n, "a", None), (n + 1, None, None)]


@pytest.mark.parametrize("most,seconds,piece", [(13, 60, 4096), (3, 20, 2), (1, 2.5, 1), (1000, 60, 3)])
def test_batch_equals_loop(spark, most, seconds, piece):
    calls = some_calls(most)
    df = spark.createDataFrame([(*c, 7) for c in calls], CALLS).drop("__i").repartition(3)
    got = admission.admitted(df, "k", "ts", "id", most, seconds, piece=piece)
    assert got.columns == ["id", "k", "ts", "admitted", "wait_us"]
    rows, want = {r.id: r for r in got.collect()}, by_loop(calls, most, seconds)
    assert len(rows) == len(calls)
    for i, _, ts in calls:
        if ts is None:
            assert rows[i].admitted is None and rows[i].wait_us is None
        else:
            assert rows[i].admitted.astimezone(timezone.utc) == want[i]
            assert rows[i].wait_us == (want[i] - ts) / timedelta(microseconds=1)


def test_nothing_waits_for_nothing(spark):
    assert admission.admitted(spark.createDataFrame([], CALLS).drop("__i"), "k", "ts", "id", 3, 60).collect() == []


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    calls = sorted((c for c in some_calls(5, 200) if c[2] is not None), key=lambda c: (c[2], c[0]))
    come, out, marks = (str(tmp_path / x) for x in ("come", "out", "marks"))
    df = spark.createDataFrame([(*c, 7) for c in calls], CALLS).drop("__i")
    for part in (calls[:90], calls[90:150], calls[150:]):  # three runs from one checkpoint
        ids = [c[0] for c in part]
        df.where(df.id.isin(ids)).coalesce(1).write.mode("append").parquet(come)
        stream = spark.readStream.schema(df.schema).parquet(come)
        admission.admitted_stream(stream, "k", "ts", "id", 4, 30).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    want = by_loop(calls, 4, 30)
    rows = spark.read.parquet(out).collect()
    assert len(rows) == len(calls)
    assert {r.id: r.admitted.astimezone(timezone.utc) for r in rows} == want
