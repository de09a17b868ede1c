"""The ordinal mixed model of an evaluation: scores in order, systems as effects, a random intercept per question."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.functions.session import cut


@dataclass
class Fit:
    """What maximises the likelihood. Systems and scores are in order; the first system is what the others are compared with."""

    systems: list
    scores: list
    thresholds: np.ndarray
    effects: np.ndarray
    sigma: float
    loglik: float
    covariance: np.ndarray  # of thresholds' parameters, effects, log sigma
    steps: int
    converged: bool


def cell_logs(params: np.ndarray, systems: int, scores: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log P(score | system, node) with gradient and Hessian in the parameters, cells in rows (system by system), nodes in columns.

    Parameters: the first threshold, the logs of the steps to the next ones, an effect for each system but the first, log
    sigma. P(score <= c) = logistic(threshold_c - effect - sigma * node).
    """
    m, size = scores - 1, len(params)
    steps = np.exp(params[1:m])
    theta = params[0] + np.concatenate([[0.0], np.cumsum(steps)])
    sigma = math.exp(params[-1])
    d_theta = np.zeros((m, size))
    d_theta[:, 0] = 1
    for j in range(1, m):
        d_theta[j:, j] = steps[j - 1]
    logs, grads, hessians = [], [], []
    for s in range(systems):
        g = np.zeros((m, len(nodes), size))
        g += d_theta[:, None, :]
        if s:
            g[:, :, m + s - 1] = -1
        g[:, :, -1] = -sigma * nodes
        x = theta[:, None] - (params[m + s - 1] if s else 0.0) - sigma * nodes
        cdf = 1 / (1 + np.exp(-np.clip(x, -500, 500)))
        pdf = cdf * (1 - cdf)
        bent = pdf * (1 - 2 * cdf)
        second = np.zeros((m, len(nodes), size, size))  # of x itself
        for j in range(1, m):
            second[j:, :, j, j] = steps[j - 1]
        second[:, :, -1, -1] = -sigma * nodes
        low = np.zeros((1, len(nodes)))
        p = np.maximum(np.diff(np.concatenate([low, cdf, low + 1]), axis=0), 1e-300)
        dc = pdf[:, :, None] * g
        ddc = bent[:, :, None, None] * g[..., :, None] * g[..., None, :] + pdf[:, :, None, None] * second
        pad = lambda v: np.concatenate([np.zeros((1, *v.shape[1:])), v, np.zeros((1, *v.shape[1:]))])
        dp, ddp = np.diff(pad(dc), axis=0), np.diff(pad(ddc), axis=0)
        dl = dp / p[:, :, None]
        logs.append(np.log(p))
        grads.append(dl)
        hessians.append(ddp / p[:, :, None, None] - dl[..., :, None] * dl[..., None, :])
    return np.concatenate(logs), np.concatenate(grads), np.concatenate(hessians)


def summed(counts: np.ndarray, times: np.ndarray, cells: tuple, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, gradient and Hessian over questions: counts has a row each (a count for each cell), which stands `times` times."""
    logs, grads, hessians = cells
    size = grads.shape[2]
    at = counts @ logs + np.log(weights)
    top = at.max(axis=1, keepdims=True)
    e = np.exp(at - top)
    each = top[:, 0] + np.log(e.sum(axis=1))
    w = e / e.sum(axis=1, keepdims=True)
    g = np.einsum("qc,ckp->qkp", counts, grads)
    mean = np.einsum("qk,qkp->qp", w, g)
    tw = w * times[:, None]
    h = np.einsum("ck,ckpr->pr", counts.T @ tw, hessians) + np.einsum("qk,qkp,qkr->pr", tw, g, g, optimize=True) - (mean * times[:, None]).T @ mean
    return float(times @ each), times @ mean, h.reshape(size, size)


def fit(scores: DataFrame, question: str, system: str, score: str, nodes: int = 41, most_steps: int = 60, tolerance: float = 1e-9, most_levels: int = 64) -> Fit:
    """Maximum likelihood of score ~ system + (1 | question), a cumulative logit model.

    Spark counts the scores of each question and system, then the questions whose counts are equal: what is fitted is that
    table, in the checkpoint folder. Each Newton step is one job over it: tasks integrate each question's intercept by
    Gauss-Hermite quadrature (`nodes` points, fixed places, which suit questions of up to some hundreds of scores each) and send one row of sums. Rows with a null in any of the three, and
    negative scores, are left out. The distinct systems and scores are read to the driver and may be `most_levels` at most;
    fewer than two of either raise ValueError. A step that lowers the likelihood is halved; where the
    Hessian is not that of a maximum, the step is damped.
    """
    rows = scores.select(F.col(f"`{question}`").alias("q"), F.col(f"`{system}`").alias("s"), F.col(f"`{score}`").alias("y")).where("q is not null and s is not null and y >= 0")
    few = lambda c: [r[0] for r in rows.select(c).distinct().limit(most_levels + 1).collect()]
    systems, levels = sorted(few("s")), sorted(few("y"))
    if not (2 <= len(systems) <= most_levels and 2 <= len(levels) <= most_levels):
        raise ValueError(f"{len(systems)} systems and {len(levels)} scores; 2 to {most_levels} of each are needed")
    # a question's cells as columns: one aggregation with partial sums, no list of a question's rows
    cells = [F.count_if((F.col("s") == F.lit(s)) & (F.col("y") == F.lit(y))) for s in systems for y in levels]
    patterns = cut(rows.groupBy("q").agg(F.array(*cells).alias("counts")).groupBy("counts").agg(F.count("*").alias("times")))
    at, weights = np.polynomial.hermite_e.hermegauss(nodes)
    weights = weights / weights.sum()
    size = len(levels) - 1 + len(systems) - 1 + 1

    def value(params: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            logs, total = cell_logs(params, len(systems), len(levels), at), np.zeros(1 + size + size * size)
            for b in batches:
                for k in range(0, b.num_rows, 2048):
                    part = b.slice(k, 2048)
                    counts = part.column("counts").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(float)
                    ll, g, h = summed(counts, part.column("times").to_numpy().astype(float), logs, weights)
                    total += np.concatenate([[ll], g, h.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

        sums = np.sum([r["sums"] for r in patterns.mapInArrow(run, "sums array<double>").collect()], axis=0)
        return sums[0], sums[1 : 1 + size], sums[1 + size :].reshape(size, size)

    n = rows.groupBy("y").count().collect()
    share = np.cumsum([dict((r[0], r[1]) for r in n)[y] for y in levels])[:-1] / sum(r[1] for r in n)
    start = np.log(share / (1 - share))
    params = np.concatenate([start[:1], np.log(np.diff(start)), np.zeros(len(systems) - 1), [0.0]])
    here, done, steps = value(params), False, 0
    while not done and steps < most_steps:
        steps += 1
        ll, g, h = here
        values, vectors = np.linalg.eigh(-h)
        step = vectors @ ((vectors.T @ g) / np.maximum(np.abs(values), 1e-6))
        step *= min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        for _ in range(30):
            there = value(params + step)
            if there[0] >= ll - 1e-12 * abs(ll):
                break
            step = step / 2
        else:
            break
        params, here = params + step, there
        done = bool(abs(here[0] - ll) <= tolerance * (1 + abs(ll)) and np.abs(step).max() < 1e-5)
    m = len(levels) - 1
    theta = params[0] + np.concatenate([[0.0], np.cumsum(np.exp(params[1:m]))])
    return Fit(systems, levels, theta, params[m:-1], math.exp(params[-1]), here[0], np.linalg.pinv(-here[2]), steps, done)


def effects(scores: DataFrame, question: str, system: str, score: str, **options) -> DataFrame:
    """(term, estimate, std_error, z, p_greater, odds_ratio): a row for each system but the first, a threshold between two scores
    and `sigma`, the spread of questions. z, p_greater (one-sided: a higher score than the first system's) and odds_ratio are
    null for thresholds and sigma. Thresholds and sigma come without std_error, since they are fitted through logs.
    """
    f = fit(scores, question, system, score, **options)
    m = len(f.scores) - 1
    out = []
    for s, b, e in zip(f.systems[1:], f.effects, np.sqrt(np.diag(f.covariance))[m:-1]):
        out.append((str(s), float(b), float(e), float(b / e), math.erfc(b / e / math.sqrt(2)) / 2, math.exp(b)))
    out += [(f"{a}|{b}", float(x), None, None, None, None) for a, b, x in zip(f.scores, f.scores[1:], f.thresholds)]
    out.append(("sigma", f.sigma, None, None, None, None))
    return scores.sparkSession.createDataFrame(out, "term string, estimate double, std_error double, z double, p_greater double, odds_ratio double")
