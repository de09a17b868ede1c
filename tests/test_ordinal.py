import math

import numpy as np
import pytest

from docgraph.operators import ordinal


def made(seed, questions, effects, thresholds, sigma, repeats=3):
    rng = np.random.default_rng(seed)
    rows = []
    for q in range(questions):
        u = rng.normal() * sigma
        for s, b in enumerate(effects):
            for _ in range(repeats):
                x = b + u + rng.logistic()
                rows.append((q, "abcdef"[s], int(sum(x > t for t in thresholds))))
    return rows


def plain_loglik(rows, theta, effects, sigma, nodes=61):
    """Question by question, cell by cell, by another number of nodes."""
    at, w = np.polynomial.hermite_e.hermegauss(nodes)
    w = w / w.sum()
    cdf = lambda x: 1 / (1 + math.exp(-x))
    per = {}
    for q, s, y in rows:
        per.setdefault(q, []).append((s, y))
    total = 0.0
    for cells in per.values():
        sum_ = 0.0
        for u, wu in zip(at, w):
            p = 1.0
            for s, y in cells:
                eta = effects["abcdef".index(s)] + sigma * u
                hi = cdf(theta[y] - eta) if y < len(theta) else 1.0
                lo = cdf(theta[y - 1] - eta) if y else 0.0
                p *= hi - lo
            sum_ += wu * p
        total += math.log(sum_)
    return total


def table(spark, rows):
    return spark.createDataFrame(rows, "q long, s string, y int")


def test_gradient_and_hessian_by_differences():
    rng = np.random.default_rng(5)
    counts, times = rng.integers(0, 4, (7, 9)).astype(float), rng.integers(1, 4, 7).astype(float)
    at, w = np.polynomial.hermite_e.hermegauss(15)
    w = w / w.sum()
    f = lambda p: ordinal.summed(counts, times, ordinal.cell_logs(p, 3, 3, at), w)
    p = np.array([-0.4, 0.3, 0.5, -0.7, 0.2])
    _, g, h = f(p)
    for k in range(5):
        d = np.zeros(5)
        d[k] = 1e-5
        assert (f(p + d)[0] - f(p - d)[0]) / 2e-5 == pytest.approx(g[k], rel=1e-5, abs=1e-5)
        assert (f(p + d)[1] - f(p - d)[1]) / 2e-5 == pytest.approx(h[k], rel=1e-4, abs=1e-4)


@pytest.mark.parametrize("seed,questions", [(1, 150), (2, 600)])
def test_made_labels_are_recovered(spark, seed, questions):
    true = [0.0, 0.8, -0.6]
    rows = made(seed, questions, true, [-0.5, 1.0], 1.2)
    f = ordinal.fit(table(spark, rows), "q", "s", "y")
    assert f.converged and f.systems == ["a", "b", "c"] and f.scores == [0, 1, 2]
    error = np.sqrt(np.diag(f.covariance))
    assert np.abs(f.effects - true[1:]).max() < 4 * error[2:4].max() < 0.8
    assert np.abs(f.thresholds - [-0.5, 1.0]).max() < 0.5 and abs(f.sigma - 1.2) < 0.35
    # the likelihood is that of a plain loop, and no step in any direction is better
    best = plain_loglik(rows, f.thresholds, [0.0, *f.effects], f.sigma)
    assert f.loglik == pytest.approx(best, abs=1e-3)
    for d in (0.05, -0.05):
        assert plain_loglik(rows, f.thresholds + d, [0.0, *f.effects], f.sigma) < best
        assert plain_loglik(rows, f.thresholds, [0.0, f.effects[0] + d, f.effects[1]], f.sigma) < best
        assert plain_loglik(rows, f.thresholds, [0.0, f.effects[0], f.effects[1] + d], f.sigma) < best
        assert plain_loglik(rows, f.thresholds, [0.0, *f.effects], f.sigma + d) < best


def test_order_nulls_and_invalid_rows_do_not_matter(spark):
    rows = made(3, 60, [0.0, 0.5], [0.0], 0.8)
    f = ordinal.fit(table(spark, rows), "q", "s", "y")
    g = ordinal.fit(table(spark, rows[::-1] + [(None, "a", 1), (1, None, 1), (1, "a", None), (1, "a", -1)]), "q", "s", "y")
    assert f.loglik == pytest.approx(g.loglik) and f.effects == pytest.approx(g.effects, abs=1e-6)
    r = {x["term"]: x for x in ordinal.effects(table(spark, rows), "q", "s", "y").collect()}
    assert set(r) == {"b", "0|1", "sigma"} and r["b"]["odds_ratio"] == pytest.approx(math.exp(r["b"]["estimate"]))
    assert 0 <= r["b"]["p_greater"] <= 1 and r["0|1"]["std_error"] is None


def test_one_system_or_no_row_raises(spark):
    with pytest.raises(ValueError, match="systems"):
        ordinal.fit(table(spark, [(1, "a", 0), (2, "a", 1)]), "q", "s", "y")
    with pytest.raises(ValueError, match="systems"):
        ordinal.fit(table(spark, []), "q", "s", "y")


def test_questions_without_spread(spark):
    """Where questions do not differ, sigma goes towards zero and the fit still ends, near the plain odds."""
    rows = [(q, "a", int(k < 1)) for q in range(40) for k in range(4)] + [(q, "b", int(k < 3)) for q in range(40) for k in range(4)]
    f = ordinal.fit(table(spark, rows), "q", "s", "y")
    assert f.sigma < 0.1 and f.effects[0] == pytest.approx(2 * math.log(3), abs=0.05)
