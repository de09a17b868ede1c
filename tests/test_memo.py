"""The memo per key beside a plain loop, over batches and restarts."""

import random
from collections import OrderedDict, defaultdict

import pytest

from docgraph.streaming import memo

ROWS = "seq long, k string, item string"


def by_loop(rows, most):
    memos, out = defaultdict(OrderedDict), {}
    for seq, k, item in sorted(rows):
        if item is None:
            continue
        have = memos[k]
        gone = None
        hit = item in have
        if not hit:
            if len(have) >= most:
                gone = have.popitem(last=False)[0]
            have[item] = True
        out[seq] = (k, item, hit, gone)
    return out


@pytest.mark.parametrize("n,most", [(120, 3), (900, 10)])
def test_hits_and_evictions_equal_loop(spark, tmp_path, n, most):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", memo.PROVIDER)
    try:
        r = random.Random(n)
        rows = [(i, r.choice(["hot", "hot", "b"]), r.choice([None, *(f"x{int(r.expovariate(0.15))}" for _ in range(12))])) for i in range(n)]
        come, out, marks = (str(tmp_path / x) for x in ("come", "out", "marks"))
        cuts = [0, n // 3, n // 2, n]
        for a, b in zip(cuts, cuts[1:]):  # three runs from one checkpoint
            spark.createDataFrame(rows[a:b], ROWS).coalesce(1).write.mode("append").parquet(come)
            stream = spark.readStream.schema(ROWS).parquet(come)
            memo.memoised(stream, "k", "seq", "item", most).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        got = {x.seq: (x.k, x.item, x.hit, x.evicted) for x in spark.read.parquet(out).collect()}
        assert got == by_loop(rows, most)
        assert any(x[2] for x in got.values()) and any(x[3] for x in got.values())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
