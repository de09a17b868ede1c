"""Scores, agreement and significance."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgraph.operators.chunking import running


def distribution(scores: DataFrame, by: str, score: str = "score") -> DataFrame:
    """(by, score, n, pct): counts of scores of 0 or more within each `by`, and their share in percent."""
    n = scores.where(F.col(score) >= 0).groupBy(by, score).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(by)), 6))


def breakdown(scores: DataFrame, a: str, b: str, score: str = "score", least: int = 5) -> DataFrame:
    """By each, by pair and in all: n, average, share of 1 or more and of 2, for sets of at least `least`."""
    g = scores.where(F.col(score) >= 0).groupingSets([[a], [b], [a, b], []], a, b)
    return g.agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean"), F.round(F.avg((F.col(score) >= 1).cast("int")), 6).alias("success"), F.round(F.avg((F.col(score) == 2).cast("int")), 6).alias("perfect")).where(F.col("n") >= least)


def judge_summary(scores: DataFrame, label: str = "label", score: str = "score", top: int = 2) -> DataFrame:
    """(label, total, n, pct, winner): percent of the highest score possible; winner marks the best, several in a tie."""
    s = scores.where(F.col(score) >= 0).groupBy(label).agg(F.sum(score).cast("long").alias("total"), F.count("*").alias("n"))
    s = s.withColumn("pct", F.round(100 * F.col("total") / (top * F.col("n")), 6))
    return s.withColumn("winner", F.col("pct") == F.max("pct").over(Window.partitionBy(F.lit(0))))


def kappa(pairs: DataFrame, a: str, b: str, weights: str = "none") -> DataFrame:
    """Cohen's kappa of two raters' whole-number scores: 1 - observed over expected disagreement, with no, linear or quadratic weights.

    pairs may carry a count n. The marginals' cross product is of the few scores there are, never of rows.
    """
    n = F.col("n") if "n" in pairs.columns else F.lit(1)
    joint = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"), n.alias("n")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    d = F.col("a") - F.col("b")
    w = {"none": (d != 0).cast("double"), "linear": F.abs(d).cast("double"), "quadratic": (d * d).cast("double")}[weights]
    observed = joint.agg(F.sum(w * F.col("n")).alias("o"), F.sum("n").alias("t"))
    left, right = joint.groupBy("a").agg(F.sum("n").alias("na")), joint.groupBy("b").agg(F.sum("n").alias("nb"))
    expected = left.join(right, F.lit(True)).agg(F.sum(w * F.col("na") * F.col("nb")).alias("e"))
    return observed.join(expected, F.lit(True)).select(F.lit(weights).alias("weights"), F.round(1 - F.col("o") * F.col("t") / F.nullif("e", F.lit(0.0)), 6).alias("kappa"), F.col("t").cast("long").alias("n"))


def wilcoxon(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The signed-rank statistic V of a over b: mean ranks of |a - b| over the pairs that differ, summed where a is more, with its normal z.

    Ranks are summed as decimals and cubes taken as doubles, since longs overflow from some million pairs on.
    """
    d = pairs.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    sizes = d.groupBy("m").agg(F.count("*").alias("t"), F.sum((F.col("d") > 0).cast("long")).alias("up"))
    s = _rank_sums(running(sizes, [F.col("m")], F.col("t"), "upto"))
    v, n = F.col("twice").cast("double") / 2, F.col("n").cast("double")
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.col("ties").cast("double") / 48
    return s.select(F.round(v, 6).alias("v"), "n", F.round((v - mean) / F.sqrt(var), 6).alias("z"))


def _rank_sums(ranked: DataFrame) -> DataFrame:
    """(twice, n, ties) of (t, up, upto), a row per distinct difference: twice the sum of the mean ranks where a is more, which is
    whole, as a decimal; the pairs; the sum of t * t * t - t as a double."""
    whole, t = (2 * F.col("upto") - F.col("t") + 1).cast("decimal(18,0)"), F.col("t").cast("double")
    return ranked.agg(F.sum(whole * F.col("up").cast("decimal(18,0)")).alias("twice"), F.sum("t").alias("n"), F.sum(t * t * t - t).alias("ties"))


def paired(scores: DataFrame, question: str, run: str, label: str, score: str, a: str, b: str, how: str = "sum") -> DataFrame:
    """(question, a, b): per question the sum or mean of the scores of two labels over the runs in which both have one.

    A score is valid from 0 on; of several scores of a (question, run, label) the mean counts. Null questions and runs are
    values like others.
    """
    valid = scores.where((F.col(score) >= 0) & F.col(label).isin(a, b)).groupBy(question, run)
    each = valid.agg(*[F.avg(F.when(F.col(label) == x, F.col(score))).alias(y) for x, y in ((a, "__a"), (b, "__b"))]).where("__a is not null and __b is not null")
    total = {"sum": F.sum, "mean": F.avg}[how]
    return each.groupBy(question).agg(total("__a").alias("a"), total("__b").alias("b"))


def rank_sum_counts(ranks: list[int]) -> np.ndarray:
    """Of all ways to give the ranks (whole numbers, repeats allowed) a sign: how many have each sum of those above zero."""
    counts = np.zeros(sum(ranks) + 1)
    counts[0] = 1
    for r in ranks:
        counts[r:] += counts[: len(counts) - r].copy()
    return counts


def signed_rank(pairs: DataFrame, a: str, b: str, exact_up_to: int = 50) -> DataFrame:
    """The signed-rank test of a over b, one row: v, n (pairs that differ), pairs, exact, p_greater, p_less, p_two_sided, effect.

    v: mean ranks of |a - b| over the pairs that differ, summed where a is more. Up to `exact_up_to` such pairs the
    probabilities are exact, ties included: the signs' rank sums are counted by adding one rank after the other. Beyond it
    they are the normal distribution's, with the variance less what ties take and half a rank of continuity. effect: |z| without
    continuity over the root of the number of pairs. Pairs with a null are left out; where none differs, v is 0 and every
    probability 1. Spark counts the distinct differences; only sums, or at most `exact_up_to` ranks, come to the driver.
    """
    spark = pairs.sparkSession
    d = pairs.select((F.col(a) - F.col(b)).cast("double").alias("d")).where("d is not null")
    total = d.count()
    sizes = d.where("d <> 0").groupBy(F.abs("d").alias("m")).agg(F.count("*").alias("t"), F.sum((F.col("d") > 0).cast("long")).alias("up"))
    ranked = running(sizes, [F.col("m")], F.col("t"), "upto").withColumn("twice", 2 * F.col("upto") - F.col("t") + 1)  # twice the mean rank is whole
    sums = _rank_sums(ranked).first()
    v, n, ties = (int(x or 0) for x in sums)
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    z = (v / 2 - mean) / math.sqrt(var) if var > 0 else 0.0
    above = lambda x: math.erfc(x / math.sqrt(2)) / 2
    if n <= exact_up_to:
        counts = rank_sum_counts([r["twice"] for r in ranked.select("twice", "t").collect() for _ in range(r["t"])])
        greater, less = counts[v:].sum() / counts.sum(), counts[: v + 1].sum() / counts.sum()
        two = min(1.0, 2 * min(greater, less))
    else:
        s = math.sqrt(var)
        greater, less = above((v / 2 - mean - 0.5) / s), above((mean - v / 2 - 0.5) / s)
        two = min(1.0, 2 * above(max(0.0, abs(v / 2 - mean) - 0.5) / s))
    row = (v / 2, n, total, n <= exact_up_to, float(greater), float(less), float(two), abs(z) / math.sqrt(total) if total else 0.0)
    return spark.createDataFrame([row], "v double, n long, pairs long, exact boolean, p_greater double, p_less double, p_two_sided double, effect double")


def medians(df: DataFrame, by: str, value: str, total: bool = False) -> DataFrame:
    """(by, whole, n, median): the exact median of each group, the mean of the middle two where n is even, as a double.

    With `total`, one more row for the whole table (by null, whole true). Nulls in `value` do not count, and a group of nulls
    alone has no row; a null `by` is a group; NaN is above every number. Values are counted first, then dealt into ranges of
    (group, value) and their counts summed in that order: the median is where the sum passes the middle. So no task holds a
    group's values, however large the group.
    """
    v = df.select(F.col(f"`{by}`").alias("__group"), F.lit(False).alias("__whole"), F.col(f"`{value}`").alias("__v")).where("__v is not null")
    sizes = v.groupBy("__group", "__whole", "__v").agg(F.count("*").alias("__c"))
    if total:
        none = F.lit(None).cast(v.schema["__group"].dataType)
        sizes = sizes.unionByName(sizes.groupBy("__v").agg(F.sum("__c").alias("__c")).select(none.alias("__group"), F.lit(True).alias("__whole"), "__v", "__c"))
    run = running(sizes, [F.col("__v")], F.col("__c"), "__upto", ("__group", "__whole"))
    totals = run.groupBy(F.col("__group").alias("__of"), F.col("__whole").alias("__all")).agg(F.max("__upto").alias("n"))
    both = run.join(totals, F.col("__group").eqNullSafe(F.col("__of")) & (F.col("__whole") == F.col("__all")))
    middle = both.where((F.col("__upto") >= F.floor((F.col("n") + 1) / 2)) & (F.col("__upto") - F.col("__c") < F.floor((F.col("n") + 2) / 2)))
    out = middle.groupBy("__group", "__whole").agg(F.max("n").alias("n"), ((F.min("__v").cast("double") + F.max("__v").cast("double")) / 2).alias("median"))
    return out.select(F.col("__group").alias(by), F.col("__whole").alias("whole"), "n", "median")


def quantile_sketches(df: DataFrame, by: list[str], value: str, size: int = 400) -> DataFrame:
    """(by..., sketch): a mergeable summary of each group's values, to be kept in a table and joined by later days' ones.

    `size` bounds a sketch whatever it has seen, and with it the error of a rank (some 1 % of the rows at 400). Nulls do not count.
    """
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(f"`{value}`").cast("double"), size).alias("sketch"))


def quantiles_of(sketches: DataFrame, by: list[str], ranks: list[float]) -> DataFrame:
    """(by..., n, quantiles): each group's sketches, of any number of days or tasks, merged, and the values at these ranks."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    at = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(r))) for r in ranks])
    return merged.select(*by, F.kll_sketch_get_n_double("sketch").alias("n"), at.alias("quantiles"))
