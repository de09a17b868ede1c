"""The signed-rank test beside all signs enumerated, and pairs per question beside loops."""

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from docgraph.operators import evaluation


def by_enumeration(diffs):
    d = [x for x in diffs if x]
    size = [abs(x) for x in d]
    rank = [sum(y < x for y in size) + (size.count(x) + 1) / 2 for x in size]
    v = sum(r for r, x in zip(rank, d) if x > 0)
    every = [sum(r for r, s in zip(rank, signs) if s) for signs in itertools.product([0, 1], repeat=len(d))]
    greater, less = sum(x >= v for x in every) / len(every), sum(x <= v for x in every) / len(every)
    return v, len(d), greater, less, min(1, 2 * min(greater, less))


@pytest.mark.parametrize("seed,n,top", [(1, 12, 100), (2, 12, 3), (3, 9, 1), (4, 1, 5), (5, 11, 6)])
def test_exact_probabilities(spark, seed, n, top):
    r = random.Random(seed)
    rows = [(r.randint(0, top), r.randint(0, top)) for _ in range(n)]
    got = evaluation.signed_rank(spark.createDataFrame([*rows, (None, 1), (2, None)], "a int, b int"), "a", "b").first()
    assert got.exact and got.pairs == n
    assert (got.v, got.n, got.p_greater, got.p_less, got.p_two_sided) == pytest.approx(by_enumeration([a - b for a, b in rows]))


def test_counts_of_rank_sums():
    assert evaluation.rank_sum_counts([1, 2, 3]).tolist() == [1, 1, 1, 2, 1, 1, 1]
    assert evaluation.rank_sum_counts([]).tolist() == [1]
    assert evaluation.rank_sum_counts(list(range(1, 51))).sum() == 2.0**50


def test_normal_beyond(spark):
    r = random.Random(9)
    rows = [(r.gauss(0.2, 1), 0.0) for _ in range(49)]
    df = spark.createDataFrame(rows, "a double, b double")
    near, exact = evaluation.signed_rank(df, "a", "b", exact_up_to=10).first(), evaluation.signed_rank(df, "a", "b").first()
    assert not near.exact and exact.exact and near.v == exact.v and near.effect == exact.effect
    for x in ("p_greater", "p_less", "p_two_sided"):
        assert getattr(near, x) == pytest.approx(getattr(exact, x), abs=0.01)
    mean, sd = 49 * 50 / 4, math.sqrt(49 * 50 * 99 / 24)
    assert near.effect == pytest.approx(abs(near.v - mean) / sd / 7)
    same = evaluation.signed_rank(df.selectExpr("b as a", "b"), "a", "b").first()
    assert (same.v, same.n, same.pairs, same.p_greater, same.p_two_sided, same.effect) == (0, 0, 49, 1, 1, 0)
    none = evaluation.signed_rank(df.where("false"), "a", "b").first()
    assert (none.n, none.pairs, none.p_two_sided) == (0, 0, 1)


@pytest.mark.parametrize("how", ["sum", "mean"])
def test_pairs_per_question(spark, how):
    r = random.Random(6)
    rows = [(f"q{i % 7}" if i % 13 else None, i % 3, r.choice(["x", "y", "z", None]), r.choice([-1, 0, 1, 2, None])) for i in range(160)]
    got = {x.q: (x.a, x.b) for x in evaluation.paired(spark.createDataFrame(rows, "q string, run int, who string, s int"), "q", "run", "who", "s", "x", "y", how).collect()}
    cells = defaultdict(list)
    for q, run, who, s in rows:
        if s is not None and s >= 0 and who in ("x", "y"):
            cells[q, run, who].append(s)
    want = defaultdict(list)
    for q, run in {k[:2] for k in cells}:
        if (q, run, "x") in cells and (q, run, "y") in cells:
            want[q].append([np.mean(cells[q, run, w]) for w in "xy"])
    total = {"sum": np.sum, "mean": np.mean}[how]
    assert got.keys() == want.keys()
    for q, x in want.items():
        assert got[q] == pytest.approx(tuple(total(x, axis=0)))
