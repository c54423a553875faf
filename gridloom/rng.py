"""Seeded 32-bit generator (mulberry32), so that seeded operators repeat everywhere."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_M = 0xFFFFFFFF
#: fixed value of the generator
STEP = 0x6D2B79F5


def mulberry32(seed: int) -> Callable[[], float]:
    """A function that gives the next number in [0, 1)."""
    state = seed & _M

    def draw() -> float:
        nonlocal state
        state = (state + STEP) & _M
        x = ((state ^ (state >> 15)) * (state | 1)) & _M
        x ^= (x + (((x ^ (x >> 7)) * (x | 61)) & _M)) & _M
        return ((x ^ (x >> 14)) & _M) / 4294967296.0

    return draw


def random_index(draw: Callable[[], float], n: int) -> int:
    return int(draw() * n)


def normal(draw: Callable[[], float]) -> float:
    """A standard normal by the Box-Muller transform."""
    import math

    u = max(draw(), 1e-300)
    return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * draw())


def shuffled(draw: Callable[[], float], items: list) -> list:
    out = list(items)
    for i in range(len(out) - 1, 0, -1):
        j = random_index(draw, i + 1)
        out[i], out[j] = out[j], out[i]
    return out


def low_product(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of 32-bit numbers, without a long overflowing."""
    high = F.shiftright(b, 16)
    return (a * b.bitwiseAND(F.lit(0xFFFF)) + F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_M))


def draw_at(seed: Column, n: Column) -> Column:
    """The n-th number (from 0) of :func:`mulberry32`, for any row by itself."""
    state = (seed.cast("long") + (n.cast("long") + 1) * F.lit(STEP)).bitwiseAND(F.lit(_M))
    x = low_product(state.bitwiseXOR(F.shiftright(state, 15)), state.bitwiseOR(F.lit(1)))
    x = x.bitwiseXOR((x + low_product(x.bitwiseXOR(F.shiftright(x, 7)), x.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(_M)))
    return x.bitwiseXOR(F.shiftright(x, 14)).cast("double") / 4294967296.0


def drawn(seed: np.ndarray | int, n: np.ndarray) -> np.ndarray:
    """:func:`draw_at` of arrays."""
    u = np.uint64
    m = u(_M)
    s = (np.asarray(seed).astype(u) + (n.astype(u) + u(1)) * u(STEP)) & m
    x = ((s ^ (s >> u(15))) * (s | u(1))) & m
    x ^= (x + (((x ^ (x >> u(7))) * (x | u(61))) & m)) & m
    return ((x ^ (x >> u(14))) & m) / 4294967296.0


def draws(seed: pd.Series, n: pd.Series) -> pd.Series:
    """:func:`draw_at` of whole columns, for Arrow batches."""
    return pd.Series(drawn(seed.to_numpy(), n.to_numpy()))
