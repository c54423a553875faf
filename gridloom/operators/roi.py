"""Regions of interest and searchlights: tables of cells, joined through fixed offset tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.num import js_round
from gridloom.operators.order import cut as _cut
from gridloom.operators.order import ranked
from gridloom.operators.stencil import _reach, _views, mm_sphere_offsets, tiled
from gridloom.rng import drawn, mulberry32, random_index


def spherical(vol: DataFrame, grid: Grid, center: tuple[int, ...], radius: float, nonzero: bool = False) -> DataFrame:
    """Cells within ``radius`` mm of a cell; an error if none is left."""
    d = sum(((c - int(m)) * (c - int(m)) * float(s * s) for c, m, s in zip(grid.axes_of("idx"), center, grid.spacing, strict=False)), F.lit(0.0))
    out = vol.filter(d <= radius * radius)
    out = out.filter("value <> 0") if nonzero else out
    if not out.limit(1).count():
        raise ValueError("the region is empty")
    return out


def cuboid(vol: DataFrame, grid: Grid, center: tuple[int, ...], surround: int | tuple[int, ...], fixed_axis: int | None = None) -> DataFrame:
    """Box around a cell of the grid, clipped to it; ``fixed_axis`` makes it a square."""
    if not all(0 <= c < n for c, n in zip(center, grid.dim, strict=False)):
        raise ValueError("the centre is outside the grid")
    s = (surround,) * 3 if isinstance(surround, int) else surround
    ok = F.lit(True)
    for a, (c, m) in enumerate(zip(grid.axes_of("idx"), center, strict=True)):
        r = 0 if a == fixed_axis else s[a]
        ok = ok & c.between(m - r, m + r)
    return vol.filter(ok)


def square(vol: DataFrame, grid: Grid, center: tuple[int, ...], surround: int, fixed_axis: int = 2) -> DataFrame:
    return cuboid(vol, grid, center, surround, fixed_axis)


def from_mask(vol: DataFrame, mask: DataFrame) -> DataFrame:
    return vol.join(mask.select("idx"), "idx", "left_semi")


def from_indices(vol: DataFrame, indices: list[int]) -> DataFrame:
    return vol.filter(F.col("idx").isin([int(i) for i in indices]))


def from_coordinates(points: DataFrame, grid: Grid) -> DataFrame:
    return points.select(grid.index_of("i", "j", "k").cast("long").alias("idx"))


def subset(region: DataFrame, keep) -> DataFrame:
    """Rows by cell numbers or by a boolean column."""
    return region.filter(keep) if not isinstance(keep, (list, tuple)) else from_indices(region, list(keep))


def world_coordinates(region: DataFrame, grid: Grid) -> DataFrame:
    return region.withColumns(dict(zip(("x", "y", "z"), grid.world_of_index("idx"), strict=True)))


def centroid(region: DataFrame, grid: Grid) -> DataFrame:
    """Mean world coordinate of a region."""
    return world_coordinates(region, grid).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"))


def features(region: DataFrame, series: DataFrame) -> DataFrame:
    """(idx, features): the series of each cell of a region as an array."""
    s = F.array_sort(F.collect_list(F.struct("t", "value")))
    return series.join(region.select("idx"), "idx", "left_semi").groupBy("idx").agg(s.alias("s")).select("idx", F.transform("s", lambda x: x["value"]).alias("features"))


def searchlight_cells(centers: DataFrame, grid: Grid, radius: float, clip: DataFrame | None = None) -> DataFrame:
    """(center, idx): the cells of the sphere around each centre; ``clip`` keeps cells of a mask."""
    off = mm_sphere_offsets(grid, radius)
    table = F.array(*[F.array(*[F.lit(int(x)) for x in o]) for o in off])
    c = centers.select(F.col("idx").alias("center"), *[x.alias(n) for x, n in zip(grid.axes_of("idx"), "ijk", strict=True)], F.explode(table).alias("o"))
    at = [F.col(n) + F.col("o")[a] for a, n in enumerate("ijk")]
    out = c.filter(grid.inside(*at)).select("center", grid.index_of(*at).cast("long").alias("idx"))
    return out if clip is None else out.join(clip.select("idx"), "idx", "left_semi").select("center", "idx")


def searchlights(mask: DataFrame, grid: Grid, radius: float, nonzero: bool = True, clip: bool | None = None) -> DataFrame:
    """Spheres at every cell of the mask (or of the grid); clipped to the mask by default if centres are."""
    centers = mask if nonzero else grid.cells(mask.sparkSession)
    return searchlight_cells(centers, grid, radius, mask if (nonzero if clip is None else clip) else None)


def searchlight_stat(lights: DataFrame, values: DataFrame, f=F.avg) -> DataFrame:
    """An aggregate of the values under each searchlight."""
    return lights.join(values, "idx").groupBy("center").agg(F.count(F.lit(1)).alias("n"), f("value").alias("value"))


def clustered_searchlights(labels: DataFrame, grid: Grid, radius: float) -> DataFrame:
    """One sphere at the rounded centre of each label above 0."""
    c = grid.with_axes(labels.filter("label > 0")).groupBy("label").agg(*[js_round(F.avg(a)).alias(a) for a in "ijk"])
    s = searchlight_cells(c.select(grid.index_of("i", "j", "k").cast("long").alias("idx")).distinct(), grid, radius)
    return c.select("label", grid.index_of("i", "j", "k").cast("long").alias("center")).join(s, "center").select("label", "idx")


def bootstrap_searchlights(mask: DataFrame, grid: Grid, radius: float = 8.0, n: int = 100, seed: int = 1) -> DataFrame:
    """(draw, idx): spheres at ``n`` centres drawn with replacement; the draws are ranks in the mask."""
    size, draw = mask.count(), mulberry32(seed)
    picks = mask.sparkSession.createDataFrame([(i, random_index(draw, size)) for i in range(n)], "draw int, rank long")
    c = ranked(mask.select("idx"), [F.col("idx")], "rank").join(F.broadcast(picks), "rank").select("draw", "idx")
    s = searchlight_cells(c.select("idx").distinct(), grid, radius, mask)
    return c.withColumnRenamed("idx", "center").join(s, "center").select("draw", "idx")


def random_searchlights(mask: DataFrame, grid: Grid, radius: float, seed: int = 1) -> DataFrame:
    """(center, idx): a random disjoint cover.  In each round the cells of locally least seeded priority become
    centres together and their spheres leave the mask, which is the sequential random pick without its loop.

    A round ships the cells that are left to tiles about once; spheres are views of a tile's dense array.
    """
    wide, near = mm_sphere_offsets(grid, 2 * radius), mm_sphere_offsets(grid, radius)
    reach = tuple(a + b for a, b in zip(_reach(wide), _reach(near), strict=True))

    def covered(arrays, there):
        cell = arrays["cell"]
        p = drawn(seed, cell.ravel()).reshape(cell.shape)
        least, best = np.full(cell.shape, np.inf), np.full(cell.shape, np.inf)
        for u, c, m in zip(_views(p, wide), _views(cell, wide), _views(there, wide, False), strict=True):
            less = m & ((u < least) | ((u == least) & (c < best)))
            least, best = np.where(less, u, least), np.where(less, c, best)
        first, center = there & (best == cell), np.full(cell.shape, np.inf)
        for c, m in zip(_views(cell, near), _views(first, near, False), strict=True):
            center = np.where(m, np.minimum(center, c), center)
        return there, np.where(np.isfinite(center), center, -1.0)

    left, out = _cut(mask.select("idx")), None
    while left.limit(1).count():
        seen = _cut(tiled(left.withColumn("cell", F.col("idx")), grid, reach, covered, ("cell",)))
        got = seen.filter("value >= 0").select(F.col("value").cast("long").alias("center"), "idx")
        out = got if out is None else out.unionByName(got)
        left = seen.filter("value < 0").select("idx")
    return out if out is not None else mask.sparkSession.createDataFrame([], "center long, idx long")
