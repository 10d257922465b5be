"""Statistics over tables: exact tests, corrections, ranks, correlations and slopes, as DataFrame plans."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scans import rank_avg, value_ranks


@F.pandas_udf(T.DoubleType())
def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    import numpy as np

    quads = pd.DataFrame({"a": a, "b": b, "c": c, "d": d})
    known: dict[tuple, float] = {}
    for q in set(map(tuple, quads.to_numpy().tolist())):
        w, x, y, z = (int(v) for v in q)
        n1, n2, k = w + x, y + z, w + y
        least, most = max(0, k - n2), min(n1, k)
        # each outcome's chance is the one before times a ratio of small numbers
        i = np.arange(least, most, dtype=float)
        p = np.r_[0.0, np.cumsum(np.log((n1 - i) * (k - i) / ((i + 1) * (n2 - k + i + 1))))]
        p = np.exp(p - p.max())
        known[q] = float(min(1.0, p[p <= p[w - least] * (1 + 1e-7)].sum() / p.sum()))
    return pd.Series([known[q] for q in map(tuple, quads.to_numpy().tolist())], dtype=float)


def fisher_exact(df: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """df with p_value (two-sided) and odds_ratio (a * d / (b * c), null where that is undefined)."""
    odds = F.when(F.col(b) * F.col(c) > 0, (F.col(a) * F.col(d)) / (F.col(b) * F.col(c)).cast("double"))
    return df.withColumn("p_value", _fisher(*[F.col(x).cast("long") for x in (a, b, c, d)])).withColumn("odds_ratio", odds)


def _with_group(df: DataFrame, part: DataFrame, by: list[str]) -> DataFrame:
    """df with the columns of a table that has one row for each group, one row in all without groups."""
    return df.join(part, by) if by else df.crossJoin(F.broadcast(part))  # one row


def bonferroni(df: DataFrame, p: str, by: list[str] = ()) -> DataFrame:
    """df with p_adj: p times the number of tests of its group, 1 at most."""
    tests = df.groupBy(*by).agg(F.count("*").alias("__m"))
    return _with_group(df, tests, list(by)).withColumn("p_adj", F.least(F.lit(1.0), F.col(p) * F.col("__m"))).drop("__m")


def benjamini_hochberg(df: DataFrame, p: str, by: list[str] = ()) -> DataFrame:
    """df with q_value: the least p * m / r of a p-value and all greater ones, r being the number of tests up to it.

    Equal p-values share their value, so that only the distinct ones of a group, with their counts, are put in order."""
    by = list(by)
    each = df.groupBy(*by, F.col(p).alias("__p")).agg(F.count("*").alias("__n"))
    share = F.col("__p") * F.col("total") / (F.col("before") + F.col("__n"))
    found = value_ranks(each, by, "__p", "__n", share).select(*by, "__p", F.least(F.lit(1.0), F.col("lowest")).alias("q_value"))
    own = df.withColumn("__p", F.col(p))
    return own.join(found, [*by, "__p"]).drop("__p")


def mann_whitney(df: DataFrame, by: list[str], group: str, value: str, first: Column, correct: bool = True, ties: bool = True) -> DataFrame:
    """by, n1, n2, u (of the rows where first holds), z: normal approximation with tie and continuity correction."""
    each = df.groupBy(*by, F.col(value).alias("__v")).agg(F.sum(F.when(first, 1).otherwise(0)).alias("__a"), F.count("*").alias("__c"))
    rank = F.col("before") + 1 + (F.col("__c") - 1) / F.lit(2.0)
    agg = value_ranks(each, list(by), "__v", "__c").groupBy(*by).agg(
        F.sum("__a").cast("long").alias("n1"),
        F.sum(F.col("__c") - F.col("__a")).cast("long").alias("n2"),
        F.sum(F.col("__a") * rank).alias("__r1"),
        F.sum(F.col("__c") * F.col("__c") * F.col("__c") - F.col("__c")).alias("__t"),
    )
    n = (F.col("n1") + F.col("n2")).cast("double")
    u = F.col("__r1") - F.col("n1") * (F.col("n1") + 1) / F.lit(2.0)
    spread = F.col("n1") * F.col("n2") / F.lit(12.0) * (n + 1 - (F.col("__t") / (n * (n - 1)) if ties else F.lit(0.0)))
    off = u - F.col("n1") * F.col("n2") / F.lit(2.0)
    shift = F.signum(off) * F.least(F.abs(off), F.lit(0.5)) if correct else F.lit(0.0)
    usable = agg.filter((F.col("n1") > 0) & (F.col("n2") > 0))
    return usable.select(*by, "n1", "n2", u.alias("u"), F.when(spread > 0, (off - shift) / F.sqrt(spread)).alias("z"))


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """The two-sided p-value of a standard normal deviate."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if x == x else float("nan"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, n, rho; groups in which a variable is constant are left out."""
    ranked = rank_avg(rank_avg(df, by, x, "__x"), by, y, "__y")
    agg = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_pop("__x").alias("__sx"), F.stddev_pop("__y").alias("__sy"), F.covar_pop("__x", "__y").alias("__c"))
    return agg.filter("__sx > 0 and __sy > 0").select(*by, "n", (F.col("__c") / (F.col("__sx") * F.col("__sy"))).alias("rho"))


def pearson_edges(df: DataFrame, item: str, sample: str, value: str, least: float) -> DataFrame:
    """Pairs a < b of items whose values over common samples correlate above least."""
    one, two = (df.select(F.col(item).alias(n), F.col(sample).alias("s"), F.col(value).alias(v)) for n, v in (("a", "x"), ("b", "y")))
    pairs = one.join(two, "s").filter("a < b").groupBy("a", "b")
    agg = pairs.agg(F.count("*").alias("n"), F.stddev_pop("x").alias("__sx"), F.stddev_pop("y").alias("__sy"), F.covar_pop("x", "y").alias("__c"))
    return agg.filter("__sx > 0 and __sy > 0").withColumn("r", F.col("__c") / (F.col("__sx") * F.col("__sy"))).filter(F.col("r") > least).select("a", "b", "n", "r")


def converged(df: DataFrame, by: list[str], x: str, y: str, points: int = 3, slope: float = 0.2) -> DataFrame:
    """by, slope over the last points of each curve, converged (|slope| within the bound)."""
    last = df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(x).desc()))).filter(F.col("__r") <= points)
    agg = last.groupBy(*by).agg(F.count("*").alias("__n"), F.regr_slope(y, x).alias("slope"))
    return agg.filter(F.col("__n") == points).select(*by, "slope", (F.abs("slope") <= slope).alias("converged"))


def saturation_fit(points: DataFrame, by: str, rounds: int = 50) -> DataFrame:
    """by, a, b of a * (1 - exp(-b * x)) fitted to each group's few points (x, y doubles) by damped Gauss-Newton steps."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        x, y = pdf.x.to_numpy(float), pdf.y.to_numpy(float)
        a, b, damp = float(y.max()) or 1.0, 1.0 / max(float(x.mean()), 1e-9), 1e-3
        loss = lambda p, q: float(((y - p * (1 - np.exp(-q * x))) ** 2).sum())
        for _ in range(rounds):
            e = np.exp(-b * x)
            jac = np.c_[1 - e, a * x * e]
            step = np.linalg.solve(jac.T @ jac + damp * np.eye(2), jac.T @ (y - a * (1 - e)))
            if b + step[1] > 0 and loss(a + step[0], b + step[1]) <= loss(a, b):
                a, b, damp = a + step[0], b + step[1], damp / 3
            else:
                damp *= 5
        return pd.DataFrame({by: [pdf[by].iloc[0]], "a": [a], "b": [b]})

    kind = points.schema[by].dataType.simpleString()
    return points.select(by, "x", "y").groupBy(by).applyInPandas(run, f"{by} {kind}, a double, b double")
