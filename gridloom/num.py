"""Number rules shared by the operators: missing values, rounding, guarded division.

A cell is missing if it is NaN or infinite; Spark aggregates skip NULL but not NaN, so operators
that skip missing cells convert first (``finite`` or ``not_nan``) and operators that let NaN through
do not.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def finite(c: Column | str) -> Column:
    """The value, NULL unless finite."""
    return F.when(is_finite(c), col(c))


def not_nan(c: Column | str) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def or_nan(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(NAN))


def js_round(c: Column | str) -> Column:
    """Round half towards plus infinity."""
    return F.floor(col(c) + 0.5)


def div(a: Column, b: Column, other: Column | float | None = None) -> Column:
    """a / b, ``other`` (NULL by default) where b is 0 or NULL."""
    q = F.when(b != 0, a / F.when(b != 0, b))
    return q if other is None else F.coalesce(q, F.lit(other) if not isinstance(other, Column) else other)


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def gt(a: Column, b: Column) -> Column:
    """a > b with NaN comparing false (Spark puts NaN above everything)."""
    return ~F.isnan(a) & ~F.isnan(b) & (a > b)


def lt(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b) & (a < b)


def pearson(x: Column | str, y: Column | str, least: int = 3) -> Column:
    """Pearson correlation over pairs of finite values as one aggregate from moments; NULL below ``least`` pairs or without variance."""
    both = is_finite(x) & is_finite(y)
    a, b = F.when(both, col(x)), F.when(both, col(y))
    vx, vy, n = F.var_pop(a), F.var_pop(b), F.count(a)
    ok = (n >= least) & (vx > 0) & (vy > 0)
    return F.when(ok, F.covar_pop(a, b) / F.when(ok, F.sqrt(vx * vy)))


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison with another engine; no negative zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def rounded_array(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """:func:`rounded` in a task, where a row is too short for a decimal number; halves of the scaled double go away from 0, as in DuckDB."""
    t = np.abs(x) * 10.0**digits
    whole = ~(t < 2.0**52)  # nothing to round, or not finite
    f = np.floor(t)
    up = np.subtract(t, f, where=~whole, out=np.zeros_like(t)) >= 0.5
    return np.where(whole, x, np.copysign((f + up) / 10.0**digits, x)) + 0.0
