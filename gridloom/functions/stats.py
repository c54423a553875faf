"""Student's t and friends (numpy only), as scalars and as column functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.num import NAN, pearson
from gridloom.operators.order import running


def beta_inc(x: float, a: float, b: float, terms: int = 300, tol: float = 1e-12) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if not 0 <= x <= 1 or math.isnan(x):
        return NAN
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(1 - x, b, a, terms, tol)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for n in range(terms + 1):
        m = n // 2
        if n == 0:
            num = 1.0
        elif n % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + num / c
        c = c if abs(c) > tiny else tiny
        f *= c * d
        if abs(1 - c * d) < tol:
            break
    return front * (f - 1.0)


def beta_inc_array(x: np.ndarray, a: np.ndarray, b: np.ndarray, terms: int = 300, tol: float = 1e-12) -> np.ndarray:
    """:func:`beta_inc` of arrays at once: all fractions take their steps together until the last has settled."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    out = np.where((x == 0) | (x == 1), x, NAN)
    on = (x > 0) & (x < 1)
    flip = on & (x > (a + 1) / (a + b + 2))
    y, p, q = (v[on] for v in (np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)))
    if not len(y):
        return out
    lgamma = np.frompyfunc(math.lgamma, 1, 1)
    (p1, at_p), (q1, at_q), (s1, at_s) = (np.unique(v, return_inverse=True) for v in (p, q, p + q))
    log = lambda v, at: lgamma(v).astype(float)[at]  # noqa: E731  (few distinct degrees of freedom)
    front = np.exp(log(s1, at_s) - log(p1, at_p) - log(q1, at_q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny, f, c, d = 1e-300, np.ones(len(y)), np.ones(len(y)), np.zeros(len(y))
    for n in range(terms + 1):
        m = n // 2
        if n == 0:
            num = np.ones(len(y))
        elif n % 2 == 0:
            num = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        else:
            num = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        d = 1.0 + num * d
        d = 1.0 / np.where(np.abs(d) > tiny, d, tiny)
        c = 1.0 + num / c
        c = np.where(np.abs(c) > tiny, c, tiny)
        f *= c * d
        if (np.abs(1 - c * d) < tol).all():
            break
    value = front * (f - 1.0)
    out[on] = np.where(flip[on], 1.0 - value, value)
    return out


def t_p(t: float, df: float) -> float:
    """Two-sided p value of a t statistic."""
    if not (df > 0) or t is None or math.isnan(t):
        return NAN
    return beta_inc(df / (df + t * t), df / 2, 0.5)


def t_quantile(p: float, df: float) -> float:
    """The p quantile of t, by doubling and bisection; NaN for df not above 0."""
    if df is None or not (df > 0) or not 0 < p < 1:
        return NAN
    if p < 0.5:
        return -t_quantile(1 - p, df)
    hi = 1.0
    while 1 - t_p(hi, df) / 2 < p and hi < 1e12:
        hi *= 2
    lo = 0.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_p(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def t_p_value(t: Column | str, df: Column | str) -> Column:
    """Two-sided p values as a column, Arrow-batched."""

    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        t, v = x.to_numpy(float), np.where(y > 0, y, NAN).astype(float)
        return pd.Series(beta_inc_array(v / (v + t * t), v / 2, 0.5))

    return F.pandas_udf(f, "double")(t, df)


def with_t_quantile(d: DataFrame, df: str, p: float, name: str = "tq") -> DataFrame:
    """``d`` with the p quantile for each row's df: one evaluation per distinct df, joined back."""

    def q(x: pd.Series) -> pd.Series:
        return x.map(lambda v: t_quantile(p, v))

    table = d.select(df).distinct().withColumn(name, F.pandas_udf(q, "double")(F.col(df).cast("double")))
    return d.join(table, df, "left")


def ranks(d: DataFrame, value: str, by: str | None = None, name: str = "rank") -> DataFrame:
    """1-based ranks with ties averaged.

    Equal values are counted first; without ``by`` the counts are summed up by ranges of the values, so no task sees all of them.
    """
    keys = [by, value] if by else [value]
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    if by:
        before = F.coalesce(F.sum("__n").over(W.partitionBy(by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        n = n.withColumn("__before", before)
    else:
        n = running(n, [F.col(value)], {"__before": F.col("__n")})
    n = n.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], (F.col("__before") + (F.col("__n") + 1) / 2).alias(name))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return d.join(n, same[0] & same[1] if by else same[0]).drop(*[f"__k{i}" for i in range(len(keys))])


def spearman(d: DataFrame, x: str, y: str) -> DataFrame:
    """(r, n, p): Pearson correlation of ranks, p by the t approximation.

    Both rank tables come from the rows themselves and meet them in one stage.
    """
    e = d.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    tables = {}
    for c in "xy":
        n = running(e.groupBy(c).agg(F.count(F.lit(1)).alias("n")), [F.col(c)], {"before": F.col("n")})
        tables[c] = n.select(c, (F.col("before") + (F.col("n") + 1) / 2).alias(f"r{c}"))
    e = e.join(tables["x"], "x").join(tables["y"], "y")
    s = e.agg(pearson("rx", "ry").alias("r"), F.count(F.lit(1)).alias("n"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-300)))
    return s.select("r", "n", t_p_value(t, (F.col("n") - 2).cast("double")).alias("p"))


def fit_line(d: DataFrame, x: str, y: str, level: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(fit, rows): slope, intercept, r, p; every row with its fitted value, band and whether Cook's distance passes 4 / n."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    s = d.agg(F.count(F.lit(1)).alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), pearson(a, b).alias("r"), F.avg(a).alias("mx"), F.regr_sxx(b, a).alias("sxx"), F.regr_syy(b, a).alias("syy"))
    n = F.col("n")
    mse = F.greatest(F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"), F.lit(0.0)) / F.when(n > 2, n - 2)
    t = F.col("r") * F.sqrt((n - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-300)))
    s = with_t_quantile(s.withColumns({"mse": mse, "p": t_p_value(t, (n - 2).cast("double")), "df": n - 2}), "df", 0.5 + level / 2)
    j = d.join(F.broadcast(s))  # one row
    lev = 1 / n + F.pow(a - F.col("mx"), F.lit(2.0)) / F.col("sxx")
    fit = F.col("intercept") + F.col("slope") * a
    half = F.col("tq") * F.sqrt(F.col("mse") * lev)
    cook = F.pow(b - fit, F.lit(2.0)) / (2 * F.when(F.col("mse") > 0, F.col("mse"))) * lev / F.pow(1 - lev, F.lit(2.0))
    rows = j.select(*d.columns, fit.alias("fit"), (fit - half).alias("lower"), (fit + half).alias("upper"), (cook > 4 / n).alias("influential"))
    return s.select("n", "slope", "intercept", "r", "p"), rows


def quantile(c: Column | str, q: float) -> Column:
    """Type-7 quantile (exact)."""
    return F.percentile(c, F.lit(q))


def nice_ticks(lo: float, hi: float, count: int = 5) -> list[float]:
    """Round axis ticks within [lo, hi]."""
    if not hi > lo:
        return [lo]
    raw = (hi - lo) / max(count, 1)
    base = 10 ** math.floor(math.log10(raw))
    step = min((m * base for m in (1, 2, 5, 10)), key=lambda s: abs(s - raw))
    return [float(round(k * step, 12)) for k in range(math.ceil(lo / step - 1e-9), math.floor(hi / step + 1e-9) + 1)]


def smoothstep(c: Column, lo: float, hi: float) -> Column:
    t = F.least(F.greatest((c - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
    return t * t * (3 - 2 * t)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def nearly_equal(a: Column, b: Column, tol: float = 1e-9) -> Column:
    return F.abs(a - b) <= tol


def dft(x: np.ndarray) -> np.ndarray:
    return np.fft.rfft(x)


def inverse_dft(z: np.ndarray, n: int) -> np.ndarray:
    return np.fft.irfft(z, n)
