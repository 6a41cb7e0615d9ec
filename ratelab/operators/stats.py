"""Rank correlation, least-squares line and confidence band per group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelab import constants as C
from ratelab.operators.running import SLICE_ROWS, average_ranks
from ratelab.session import settle

MANY_DEGREES = 200


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz), until it stands still.

    The number of rounds needed goes with the root of the larger parameter; a fraction that still moves far beyond that fails.
    """
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    most = 500 + 20 * int(np.sqrt(max(a.max(initial=0.0), b.max(initial=0.0))))
    for m in range(1, most):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all((np.abs(d * c - 1.0) < 1e-15) | ~np.isfinite(d * c)):
            return h
    raise ArithmeticError(f"the tail of Student's t has not converged after {most} rounds")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling series after shifting the argument up."""
    shift = np.zeros_like(x)
    x = x.copy()
    for _ in range(12):
        small = x < 12
        shift += np.where(small, np.log(np.where(small, x, 1.0)), 0.0)
        x = np.where(small, x + 1.0, x)
    inv = 1.0 / x
    series = inv / 12 - inv**3 / 360 + inv**5 / 1260 - inv**7 / 1680
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


def _tail_integral(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail for MANY_DEGREES and more, as the density integrated beyond t.

    Near one the steps of the continued fraction shrink as the root of the degrees grows, until rounding exceeds them. The
    integral takes the same double exponential nodes for any number of degrees, over the length in which the density falls by e.
    """
    t, n = np.minimum(np.abs(t), 1e100)[:, None], df[:, None]
    y, step = np.linspace(-4.2, 4.2, 120, retstep=True)
    nodes = np.exp(y - np.exp(-y))
    length = np.where(t > 1, (n + t * t) / ((n + 1) * np.maximum(t, 1)), 1.0)
    beyond = nodes * length
    fall = np.exp(-(n + 1) / 2 * np.log1p(beyond * (2 * t + beyond) / (n + t * t)))
    area = (fall * nodes * (1 + np.exp(-y)) * step * length).sum(axis=1)
    t, a = t[:, 0], df / 2
    top = -1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5)  # of the log density at zero, beyond the normal one
    return np.sqrt(2 / np.pi) * np.exp(top - (df + 1) / 2 * np.log1p(t * t / df)) * area


def student_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail probability of Student's t."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    many = df >= MANY_DEGREES
    if many.any():
        out = np.empty(df.shape)
        out[many], out[~many] = _tail_integral(t[many], df[many]), student_tail(t[~many], df[~many])
        return out
    a, b = df / 2.0, np.full_like(df, 0.5)
    x = df / (df + t * t)
    front = np.exp(
        _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)
        + a * np.log(np.where(x > 0, x, 1.0)) + b * np.log(np.where(x < 1, 1.0 - x, 1.0))
    )
    near = x < (a + 1.0) / (a + b + 2.0)  # either fraction is asked only where it converges
    direct = front * _beta_fraction(a, b, np.where(near, x, 0.0)) / a
    mirrored = 1.0 - front * _beta_fraction(b, a, np.where(near, 0.0, 1.0 - x)) / b
    out = np.where(near, direct, mirrored)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def student_quantile(level: float, df: np.ndarray) -> np.ndarray:
    """Quantile above one half, by bisection on the tail."""
    df = np.asarray(df, float)
    low, high = np.zeros_like(df), np.full_like(df, 1e10)
    target = 2.0 * (1.0 - level)
    for _ in range(90):
        mid = (low + high) / 2
        above = student_tail(mid, df) > target
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def _two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index, dtype=float)
    if ok.any():
        out[ok] = student_tail(t[ok].to_numpy(float), df[ok].to_numpy(float))
    return out.astype(object).where(out.notna(), None)


@F.pandas_udf(T.DoubleType())
def _quantile(df: pd.Series) -> pd.Series:
    ok = df.notna() & (df > 0)
    out = pd.Series(np.nan, index=df.index, dtype=float)
    if ok.any():
        out[ok] = student_quantile(C.BAND_LEVEL, df[ok].to_numpy(float))
    return out.astype(object).where(out.notna(), None)


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, limit: int = SLICE_ROWS) -> DataFrame:
    """Rank correlation and number of points per group.

    A missing value anywhere in a group, or a constant side, leaves its correlation undefined (null). The
    points are settled: ranks are joined back by value, and a mean computed twice can differ in its last digit.
    """
    ranked = average_ranks(settle(df.select(*keys, x, y)), keys, {x: "rank_x", y: "rank_y"}, limit)
    rho = F.try_divide(
        F.covar_pop("rank_x", "rank_y"), F.stddev_pop("rank_x") * F.stddev_pop("rank_y")
    )
    complete = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) == F.count(F.lit(1))
    return ranked.groupBy(*keys).agg(F.when(complete, rho).alias("rho"), F.count(F.lit(1)).alias("n"))


def with_pvalue(rho: DataFrame) -> DataFrame:
    """Add the two-sided p-value of each correlation; null for fewer than three points."""
    r, n = F.col("rho"), F.col("n")
    t = F.when(1 - r * r <= 0, F.lit(float("inf"))).otherwise(F.abs(r) * F.sqrt(F.try_divide(n - 2, 1 - r * r)))
    t = F.when((n > 2) & r.isNotNull(), t)
    return rho.withColumn("p_value", _two_sided(t, (n - 2).cast("double")))


def ols_line(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, residual deviation and the sums a confidence band needs, in one aggregation."""
    slope, sxy = F.regr_slope(y, x), F.regr_sxy(y, x)
    syy, sxx, n = F.regr_syy(y, x), F.regr_sxx(y, x), F.regr_count(y, x)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    stats = df.groupBy(*keys).agg(
        n.alias("n"), slope.alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        sxx.alias("sxx"), syy.alias("syy"), sxy.alias("sxy"), F.regr_avgx(y, x).alias("mean_x"),
        F.min(F.when(both, F.col(x))).alias("min_x"), F.max(F.when(both, F.col(x))).alias("max_x"),
    )
    left = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    residual = F.when(F.col("n") > 2, F.sqrt(F.try_divide(left, F.col("n") - 2)))
    return stats.withColumn("residual_sd", residual).drop("syy", "sxy")


def confidence_band(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """The fitted line and its 95 percent band on an even grid just beyond the range of x."""
    line = ols_line(df, keys, x, y).where(F.col("slope").isNotNull() & (F.col("n") > 2))
    line = line.withColumn("t", _quantile((F.col("n") - 2).cast("double")))
    low, high = F.col("min_x") - C.BAND_MARGIN, F.col("max_x") + C.BAND_MARGIN
    grid = F.explode(F.sequence(F.lit(0), F.lit(C.BAND_POINTS - 1)))
    points = line.withColumn("point", grid).withColumn(
        "x", low + F.col("point") * (high - low) / (C.BAND_POINTS - 1)
    )
    se = F.col("residual_sd") * F.sqrt(1 / F.col("n") + F.try_divide((F.col("x") - F.col("mean_x")) ** 2, F.col("sxx")))
    fit = F.col("slope") * F.col("x") + F.col("intercept")
    return points.select(
        *keys, "point", "x", fit.alias("fit"), (fit - F.col("t") * se).alias("low"), (fit + F.col("t") * se).alias("high")
    )


def centroids(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Mean point per group."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.avg(x).alias(x), F.avg(y).alias(y), F.count(F.lit(1)).alias("n")
    )
