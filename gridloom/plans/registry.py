"""Registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.layout import SQL as VIEWS
from gridloom.num import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query; ``views`` names the layouts its SQL starts from."""

    def wrap(f):
        QUERIES[name] = f
        if sql is not None:
            with_ = ", ".join(VIEWS[v] for v in views.split())
            SQL[name] = (f"WITH {with_}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().lstrip('+')}" if with_ else sql).strip()
        return f

    return wrap


def r(expr: str) -> str:
    """SQL text of a rounded number."""
    return f"(round(CAST({expr} AS DOUBLE), 6) + CAST(0 AS DOUBLE))"


def draws(streams: int, count: int, first: int = 1) -> str:
    """rnd(rep, n, u): the seeded generator's numbers as SQL; the n-th state is the seed plus n + 1 steps."""
    return (
        f"rnd AS (SELECT s.range AS rep, n.range AS n, (s.range + {first} + (n.range + 1) * 1831565813) & 4294967295 AS st, ((xor(st, st >> 15)::HUGEINT * (st | 1)) & 4294967295)::BIGINT AS x1, "
        f"xor(x1, (x1 + ((xor(x1, x1 >> 7)::HUGEINT * (x1 | 61)) & 4294967295)::BIGINT) & 4294967295) AS x2, xor(x2, x2 >> 14) / 4294967296.0 AS u FROM range({streams}) s, range({count}) n)"
    )


def show(d: DataFrame, /, *keys: str, **values: Column | str) -> DataFrame:
    """Keys as they are, values rounded."""
    return d.select(*keys, *[rounded(v).alias(n) for n, v in values.items()])


def col(name: str) -> Column:
    return F.col(name)


def t_inside(t: str, df: str) -> str:
    """SQL text of P(|T| <= t) for whole df, as a finite sum over powers of the cosine of atan(t / sqrt(df))."""
    angle = f"atan(({t}) / sqrt({df}))"
    even = f"list_sum(list_transform(range({df} // 2), lambda k: exp(lgamma(2 * k + 1) - k * ln(4.0::DOUBLE) - 2 * lgamma(k + 1)) * power(cos({angle}), 2 * k)))"
    odd = f"coalesce(list_sum(list_transform(range(({df} - 1) // 2), lambda k: exp(k * ln(4.0::DOUBLE) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * power(cos({angle}), 2 * k))), 0)"
    return f"CASE WHEN {df} % 2 = 0 THEN sin({angle}) * {even} ELSE 2 / pi() * ({angle} + sin({angle}) * cos({angle}) * {odd}) END"


def t_table(dfs: str, level: float = 0.95) -> str:
    """tq(df, q): the two-sided t quantile of each df of a query, by bisection; needs WITH RECURSIVE."""
    return (
        f"tb AS (SELECT 0 AS step, df, 0.0::DOUBLE AS lo, 100.0::DOUBLE AS hi FROM ({dfs}) UNION ALL SELECT step + 1, df, CASE WHEN p < {level} THEN mid ELSE lo END, CASE WHEN p < {level} THEN hi ELSE mid END "
        f"FROM (SELECT *, {t_inside('mid', 'df')} AS p FROM (SELECT *, (lo + hi) / 2 AS mid FROM tb WHERE step < 60))), tq AS (SELECT df, (lo + hi) / 2 AS q FROM tb WHERE step = 60)"
    )
