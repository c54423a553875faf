"""Neighbourhood operators on volumes.

A volume is dealt into cubes of ``TILE`` cells an edge, each with the cells around it that its windows reach.
That is one shuffle with little more than one row a cell, whatever the window; within a task a tile is a dense array
and a window is a sum over shifted views.  Filters of several passes or steps take one such shuffle with a wider rim.
Cells outside the grid or without a row (or with a NULL) drop out of the window; NaN stays NaN.

:func:`taps` is the same neighbourhood as a relational join, for neighbours that are looked up rather than summed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid

Offsets = list[tuple[int, int, int, float]]


# ------------------------------------------------------------------ kernels
def _cube(r: int):
    n = range(-r, r + 1)
    return [(a, b, c) for c in n for b in n for a in n]


def _normal(k: Offsets) -> Offsets:
    s = sum(w for *_, w in k)
    return [(a, b, c, w / s) for a, b, c, w in k]


def box_kernel(r: int) -> Offsets:
    return _normal([(*d, 1.0) for d in _cube(r)])


def gaussian_kernel(sigma: float, r: int | None = None) -> Offsets:
    r = math.ceil(3 * sigma) if r is None else r
    return _normal([(*d, math.exp(-sum(x * x for x in d) / (2 * sigma * sigma))) for d in _cube(r)])


def sphere_kernel(r: float) -> Offsets:
    return _normal([(*d, 1.0) for d in _cube(int(r)) if sum(x * x for x in d) <= r * r])


def laplacian_kernel() -> Offsets:
    return [(0, 0, 0, -6.0), *[(*d, 1.0) for d in _cube(1) if sum(map(abs, d)) == 1]]


def sobel_kernel(axis: int) -> Offsets:
    """Derivative along an axis, smoothed by (1, 2, 1) along the other two."""
    out = []
    for d in _cube(1):
        if d[axis]:
            out.append((*d, float(d[axis] * math.prod(2 - abs(x) for i, x in enumerate(d) if i != axis))))
    return out


def neighbour_offsets(connectivity: int) -> list[tuple[int, int, int]]:
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    return [d for d in _cube(1) if 0 < sum(map(abs, d)) <= most]


def mm_sphere_offsets(grid: Grid, radius: float) -> list[tuple[int, int, int]]:
    """Offsets within ``radius`` mm, by the grid's spacing."""
    r = [int(radius / s) for s in grid.spacing[:3]]
    return [(a, b, c) for c in range(-r[2], r[2] + 1) for b in range(-r[1], r[1] + 1) for a in range(-r[0], r[0] + 1) if sum((x * s) ** 2 for x, s in zip((a, b, c), grid.spacing, strict=False)) <= radius * radius + 1e-9]


# ------------------------------------------------------------------ the neighbour join
def taps(v: DataFrame, grid: Grid, offsets: list[tuple], keep: tuple[str, ...] = ("value",)) -> DataFrame:
    """(idx, tap, w, and the kept columns of the neighbour) for every cell and every neighbour of it within the grid."""
    nx, ny, nz = (int(n) for n in grid.dim[:3])
    i, j, k = grid.axes_of("idx")
    lit = F.array(*[F.struct(F.lit(n).alias("tap"), F.lit(int(o[0])).alias("a"), F.lit(int(o[1])).alias("b"), F.lit(int(o[2])).alias("c"), F.lit(float(o[3]) if len(o) > 3 else 1.0).alias("w")) for n, o in enumerate(offsets)])
    d = v.select(i.alias("i"), j.alias("j"), k.alias("k"), *keep, F.explode(lit).alias("o"))
    # the neighbour at +offset of the centre is this cell: the centre is at -offset
    x, y, z = F.col("i") - F.col("o.a"), F.col("j") - F.col("o.b"), F.col("k") - F.col("o.c")
    ok = x.between(0, nx - 1) & y.between(0, ny - 1) & z.between(0, nz - 1)
    return d.filter(ok).select((x + y * nx + z * (nx * ny)).cast("long").alias("idx"), F.col("o.tap").alias("tap"), F.col("o.w").alias("w"), *keep)


# ------------------------------------------------------------------ tiles
TILE = 32
Arrays = dict[str, np.ndarray]


class Tiles:
    """The tiles of a grid with a rim of ``reach`` cells on each axis; ``near`` are the tiles that a cell ``idx`` is needed in."""

    def __init__(self, grid: Grid, reach: tuple[int, int, int]):
        self.reach, self.n = reach, [int(x) for x in grid.dim[:3]]
        self.edge = [max(TILE, r) for r in reach]
        self.count = [-(-x // y) for x, y in zip(self.n, self.edge, strict=True)]
        near = [F.sequence(F.floor(F.greatest(c - r, F.lit(0)) / y), F.floor(F.least(c + r, F.lit(m - 1)) / y)) for c, r, y, m in zip(grid.axes_of("idx"), reach, self.edge, self.n, strict=True)]
        self.near = F.flatten(F.transform(near[2], lambda z: F.flatten(F.transform(near[1], lambda y: F.transform(near[0], lambda x: self.number(x, y, z))))))

    def number(self, x, y, z):
        """The tile of tile coordinates."""
        return x + y * self.count[0] + z * (self.count[0] * self.count[1])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "near"}  # columns stay on the driver

    def open(self, at: int) -> None:
        """Bounds of a tile (x, y, z), of its rim, and its shape (z, y, x) with it."""
        c = self.count
        self.first = [k * t for k, t in zip((at % c[0], at // c[0] % c[1], at // (c[0] * c[1])), self.edge, strict=True)]
        self.last = [min(a + y, m) for a, y, m in zip(self.first, self.edge, self.n, strict=True)]
        self.low = [max(a - r, 0) for a, r in zip(self.first, self.reach, strict=True)]
        self.shape = tuple(min(z + r, m) - a for a, z, r, m in zip(self.low, self.last, self.reach, self.n, strict=True))[::-1]

    def places(self, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.n
        return idx // (n[0] * n[1]) - self.low[2], idx // n[0] % n[1] - self.low[1], idx % n[0] - self.low[0]


def tiled(v: DataFrame, grid: Grid, reach: tuple[int, int, int], f: Callable[[Arrays, np.ndarray], tuple[np.ndarray, np.ndarray]], keep: tuple[str, ...] = ("value",)) -> DataFrame:
    """(idx, value): ``f`` over tiles of the grid with a rim of ``reach`` cells on each axis.

    ``f`` gets dense arrays (z, y, x) of the kept columns, 0 where there is no cell, and where there are cells; it gives
    where there is a result, and the result.
    """
    tile = Tiles(grid, reach)
    d = v.select(F.col("idx").cast("long").alias("idx"), *[F.col(c).cast("double").alias(c) for c in keep])
    for c in keep:
        d = d.filter(F.col(c).isNotNull())
    d = d.withColumn("__tile", F.explode(tile.near))

    def run(cells: pa.Table) -> pa.Table:  # Arrow, where NaN and NULL differ
        tile.open(cells.column("__tile")[0].as_py())
        cell = tile.places(cells.column("idx").to_numpy())
        there, arrays = np.zeros(tile.shape, bool), {}
        there[cell] = True
        for c in keep:
            arrays[c] = np.zeros(tile.shape)
            arrays[c][cell] = cells.column(c).to_numpy()
        ok, value = f(arrays, there)
        n, first = tile.n, tile.first
        inner = tuple(slice(a - b, z - b) for a, z, b in zip(first, tile.last, tile.low, strict=True))[::-1]
        z, y, x = np.nonzero(ok[inner])
        return pa.table({"idx": x + first[0] + (y + first[1]) * n[0] + (z + first[2]) * (n[0] * n[1]), "value": value[inner][z, y, x].astype(float)})

    return d.groupBy("__tile").applyInArrow(run, "idx long, value double")


def _views(a: np.ndarray, offsets: list[tuple], fill: float | bool = 0.0):
    """For each offset the array of the neighbours there, ``fill`` beyond the array."""
    r = [max(abs(int(o[x])) for o in offsets) for x in range(3)]
    p = np.pad(a, [(x, x) for x in r[::-1]], constant_values=fill)
    for o in offsets:
        yield p[tuple(slice(r[x] + int(o[x]), r[x] + int(o[x]) + a.shape[2 - x]) for x in (2, 1, 0))]


def _reach(offsets: list[tuple]) -> tuple[int, int, int]:
    return tuple(max(abs(int(o[x])) for o in offsets) for x in range(3))


def _sums(a: np.ndarray, there: np.ndarray, kernel: Offsets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where a neighbour is, weighted sum, weight) of a kernel."""
    ok, s, w = np.zeros(a.shape, bool), np.zeros(a.shape), np.zeros(a.shape)
    for (*_, wt), x, m in zip(kernel, _views(a, kernel), _views(there, kernel, False), strict=True):
        s += wt * x
        w += wt * m
        ok |= m
    return ok, s, w


def _correlate(a: np.ndarray, there: np.ndarray, kernel: Offsets) -> tuple[np.ndarray, np.ndarray]:
    ok, s, w = _sums(a, there, kernel)
    small = np.abs(w) < 1e-8
    return ok, np.where(ok, np.where(small, s, s / np.where(small, 1.0, w)), 0.0)


def _axis(axis: int, weights: dict[int, float]) -> Offsets:
    return [(o if axis == 0 else 0, o if axis == 1 else 0, o if axis == 2 else 0, w) for o, w in weights.items()]


def _box_means(columns: list[np.ndarray], there: np.ndarray, r: int) -> list[np.ndarray]:
    """Means over the cube window of what is there, as three one-axis sums."""
    sums = [*columns, there.astype(float)]
    for axis in range(3):
        off = [o[:3] for o in _axis(axis, dict.fromkeys(range(-r, r + 1), 1.0))]
        sums = [sum(_views(x, off)) for x in sums]
    return [x / np.maximum(sums[-1], 1.0) for x in sums[:-1]]


# ------------------------------------------------------------------ filters
def filter_kernel(v: DataFrame, grid: Grid, kernel: Offsets) -> DataFrame:
    """Correlation with a kernel, divided by the weight inside the grid unless that is (nearly) 0."""
    return tiled(v, grid, _reach(kernel), lambda a, there: _correlate(a["value"], there, kernel))


def _passes(v: DataFrame, grid: Grid, kernels: list[Offsets]) -> DataFrame:
    """Kernels one after the other, in one shuffle."""
    reach = tuple(sum(r) for r in zip(*[_reach(k) for k in kernels], strict=True)) if kernels else (0, 0, 0)

    def f(a, there):
        x = a["value"]
        for k in kernels:
            there, x = _correlate(x, there, k)
        return there, x

    return tiled(v, grid, reach, f)


def gaussian_blur(v: DataFrame, grid: Grid, sigma: float | tuple[float, float, float]) -> DataFrame:
    """Separable Gaussian, half-width ceil(3 * the largest sigma) on every axis, weights renormalised at the border."""
    s = (sigma,) * 3 if isinstance(sigma, (int, float)) else sigma
    r = math.ceil(3 * max(s))
    return _passes(v, grid, [_axis(a, {o: math.exp(-o * o / (2 * s[a] ** 2)) for o in range(-r, r + 1)}) for a in range(3) if s[a] > 0])


def box_mean(v: DataFrame, grid: Grid, r: int) -> DataFrame:
    """Mean of the cube window inside the grid; on full grids the three axis means equal it."""
    return _passes(v, grid, [_axis(a, dict.fromkeys(range(-r, r + 1), 1.0)) for a in range(3)])


def guided_filter(v: DataFrame, grid: Grid, radius: float = 2, epsilon: float = 0.01, guide: DataFrame | None = None) -> DataFrame:
    """Edge-preserving guided filter: local linear model of the guide, box means throughout; for full grids."""
    r = max(1, int(math.floor(radius + 0.5)))
    g = (v if guide is None else guide).select("idx", F.col("value").alias("g"))
    axes = [_axis(a, dict.fromkeys(range(-r, r + 1), 1.0)) for a in range(3)]

    def means(columns, there):
        for k in axes:
            done = [_correlate(x, there, k) for x in columns]
            there, columns = done[0][0], [x for _, x in done]
        return there, columns

    def f(a, there):
        near, (mg, mp, gg, gp) = means([a["g"], a["p"], a["g"] * a["g"], a["g"] * a["p"]], there)
        slope = (gp - mg * mp) / (gg - mg * mg + epsilon)
        _, (sa, sb) = means([slope, mp - slope * mg], near)
        return there, sa * a["g"] + sb

    return tiled(v.select("idx", F.col("value").alias("p")).join(g, "idx"), grid, (2 * r,) * 3, f, ("p", "g"))


def masked_box_mean(v: DataFrame, grid: Grid, r: int) -> DataFrame:
    """Box mean over the cells that have a finite value; cells without one stay as they are."""

    def f(a, there):
        x = a["value"]
        ok = there & np.isfinite(x)
        (m,) = _box_means([np.where(ok, x, 0.0)], ok, r)
        return there, np.where(np.isnan(x), x, m)

    return tiled(v, grid, (r,) * 3, f)


def guided_smooth(v: DataFrame, grid: Grid, guide: DataFrame, radius: int = 2, epsilon: float = 0.01) -> DataFrame:
    """Guided filter inside a mask (the cells of ``v``): box means by the cells present, guide z-scored, NaN stays NaN."""
    z = guide.join(v.filter(~F.isnan("value")).select("idx"), "idx", "left_semi")
    stat = z.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    m, s = stat.select("m").scalar(), stat.select("s").scalar()
    d = v.select("idx", F.col("value").alias("p")).join(guide.select("idx", F.when(s > 0, (F.col("value") - m) / F.when(s > 0, s)).otherwise(0.0).alias("g")), "idx", "left")
    d = d.withColumn("g", F.coalesce("g", F.lit(float("nan"))))  # cells that the guide lacks keep their values

    def f(a, there):
        ok = there & ~np.isnan(a["p"]) & ~np.isnan(a["g"])
        p, g = np.where(ok, a["p"], 0.0), np.where(ok, a["g"], 0.0)
        mp, mg, gg, gp = _box_means([p, g, g * g, g * p], ok, radius)
        slope = (gp - mg * mp) / (gg - mg * mg + epsilon)
        sa, sb = _box_means([np.where(ok, slope, 0.0), np.where(ok, mp - slope * mg, 0.0)], ok, radius)
        return there, np.where(ok, sa * g + sb, a["p"])

    return tiled(d, grid, (2 * radius,) * 3, f, ("p", "g"))


def median_filter(v: DataFrame, grid: Grid, r: int = 1) -> DataFrame:
    """Exact median of the cube window inside the grid; NaN counts as the largest value."""
    cube = _cube(r)

    def f(a, there):
        x = np.where(there, a["value"], np.nan)
        n = sum(m.astype(np.int32) for m in _views(there, cube, False))
        out = np.empty(x.shape)
        views = list(_views(x, cube, np.nan))
        for z in range(x.shape[0]):  # a plane at a time; absent cells sort to the end
            window = np.sort(np.stack([w[z] for w in views]), axis=0)
            low, high = (np.take_along_axis(window, np.maximum(k, 0)[None], 0)[0] for k in ((n[z] - 1) // 2, n[z] // 2))
            out[z] = (low + high) / 2
        return n > 0, out

    return tiled(v, grid, (r,) * 3, f)


def _ball(r: float) -> list[tuple[int, int, int]]:
    return [d for d in _cube(int(r)) if sum(x * x for x in d) <= r * r]


def _extremes(v: DataFrame, grid: Grid, r: float, least: list[bool]) -> DataFrame:
    """Minima (true) or maxima over balls, one after the other; a NaN is above all numbers."""
    ball = _ball(r)

    def f(a, there):
        x = a["value"]
        for low in least:
            x = np.where(there, x, np.nan if low else -np.inf)
            new, ok = np.full(x.shape, np.nan if low else -np.inf), np.zeros(x.shape, bool)
            for w, m in zip(_views(x, ball, np.nan if low else -np.inf), _views(there, ball, False), strict=True):
                new = np.fmin(new, w) if low else np.maximum(new, w)
                ok |= m
            x, there = new, ok
        return there, x

    return tiled(v, grid, (int(r) * len(least),) * 3, f)


def erode(v: DataFrame, grid: Grid, r: float = 1) -> DataFrame:
    return _extremes(v, grid, r, [True])


def dilate(v: DataFrame, grid: Grid, r: float = 1) -> DataFrame:
    return _extremes(v, grid, r, [False])


def opening(v: DataFrame, grid: Grid, r: float = 1) -> DataFrame:
    return _extremes(v, grid, r, [True, False])


def closing(v: DataFrame, grid: Grid, r: float = 1) -> DataFrame:
    return _extremes(v, grid, r, [False, True])


def bilateral(v: DataFrame, grid: Grid, spatial: float, intensity: float, window: int = 5) -> DataFrame:
    """Mean of the window weighted by distance and by closeness of value."""
    off = [(*d, math.exp(-sum(x * x for x in d) / (2 * spatial * spatial))) for d in _cube(window // 2)]

    def f(a, there):
        x = a["value"]
        s, w = np.zeros(x.shape), np.zeros(x.shape)
        for (*_, near), y, m in zip(off, _views(x, off), _views(there, off, False), strict=True):
            wt = near * m * np.exp(-((y - x) ** 2) / (2 * intensity * intensity))
            s += wt * y
            w += wt
        return there, s / np.where(there, w, 1.0)

    return tiled(v, grid, (window // 2,) * 3, f)


def diffuse(v: DataFrame, grid: Grid, iterations: int = 5, kappa: float = 30.0, rate: float = 0.1) -> DataFrame:
    """Perona-Malik diffusion over six neighbours, no flux across the border; eight steps take one shuffle."""
    if not 0 <= rate <= 0.25:
        raise ValueError("rate must be in [0, 0.25]")
    near = neighbour_offsets(6)
    while iterations > 0:
        steps = min(iterations, 8)

        def f(a, there, steps=steps):
            x = a["value"]
            for _ in range(steps):
                flow = np.zeros(x.shape)
                for y, m in zip(_views(x, near), _views(there, near, False), strict=True):
                    g = np.where(m, y - x, 0.0)
                    flow += np.exp(-((g / kappa) ** 2)) * g
                x = x + rate * flow
            return there, x

        v, iterations = tiled(v, grid, (steps,) * 3, f), iterations - steps
    return v


def edges(v: DataFrame, grid: Grid, method: str = "sobel") -> DataFrame:
    """Sobel magnitude (all three derivatives in one pass) or Laplacian; canny means sobel."""
    if method == "laplacian":
        return filter_kernel(v, grid, laplacian_kernel())
    kernels, cube = [sobel_kernel(a) for a in range(3)], _cube(1)

    def f(a, there):
        ok = np.logical_or.reduce(list(_views(there, cube, False)))
        return ok, np.sqrt(sum(_sums(a["value"], there, k)[1] ** 2 for k in kernels))

    return tiled(v, grid, (1, 1, 1), f)
