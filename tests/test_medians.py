import math
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from docgraph.functions.session import cut
from docgraph.operators import chunking
from docgraph.operators import evaluation as ev


def plain(data):
    groups = {}
    for g, v in data:
        if v is not None:
            groups.setdefault((g, False), []).append(v)
            groups.setdefault((None, True), []).append(v)
    return {k: (len(v), statistics.median(v)) for k, v in groups.items()}


def got(spark, data, schema="g string, v double"):
    return {(r["g"], r["whole"]): (r["n"], r["median"]) for r in ev.medians(spark.createDataFrame(data, schema), "g", "v", total=True).collect()}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-3, 3), st.floats(-1e9, 1e9))), max_size=40))
def test_equals_plain_medians(spark, data):
    data = [(g, None if v is None else float(v)) for g, v in data]
    assert got(spark, data) == plain(data)


def test_hot_group_ties_nan_and_whole_numbers(spark):
    data = [("hot", float(k % 7)) for k in range(5000)] + [("cold", 1.0), ("cold", 4.0), ("none", None)]
    assert got(spark, data) == plain(data)
    assert math.isnan(got(spark, [("a", 1.0), ("a", float("nan")), ("a", float("nan"))])[("a", False)][1])
    assert got(spark, [("a", 2), ("a", 5)], "g string, v long") == {("a", False): (2, 3.5), (None, True): (2, 3.5)}
    assert got(spark, []) == {}


def test_no_task_holds_a_group(spark, monkeypatch):
    """One group of distinct values is summed in slices, none of which has more than a third of it."""
    slices = []

    def watched(df):
        out = cut(df)
        slices.append([r["count"] for r in out.groupBy("__slice").count().collect()])
        return out

    monkeypatch.setattr(chunking, "cut", watched)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        df = spark.range(20000).selectExpr("'one' as g", "cast(id as double) as v")
        assert ev.medians(df, "g", "v").first()["median"] == 9999.5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(slices) == 1 and sum(slices[0]) == 20000 and max(slices[0]) < 20000 / 3


@pytest.mark.parametrize("days", [1, 5])
def test_sketches_merge(spark, days):
    df = spark.range(20000).selectExpr("id % 3 as g", f"id % {days} as day", "cast((id * 7919) % 20000 as double) as v")
    kept = ev.quantile_sketches(df, ["g", "day"], "v")
    for r in ev.quantiles_of(kept, ["g"], [0.1, 0.5, 0.9]).collect():
        values = sorted(x["v"] for x in df.where(f"g = {r['g']}").collect())
        assert r["n"] == len(values)
        for rank, x in zip([0.1, 0.5, 0.9], r["quantiles"]):
            assert abs(sum(v <= x for v in values) / len(values) - rank) < 0.02
